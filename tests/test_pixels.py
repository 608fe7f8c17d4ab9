"""Frames, codings, grey levels, colour and waveforms."""

import json

import numpy as np
import pytest

from lumenframe.functions import pixeldata as P
from lumenframe.functions import waveformdata as W
from lumenframe.operators import pixels, waveforms
from lumenframe.sources import dicom_json, p10


@pytest.mark.parametrize("bits, stored, signed, samples", [(8, 8, False, 1), (16, 12, False, 1), (16, 12, True, 1), (16, 16, True, 1), (32, 32, False, 1), (8, 8, False, 3), (1, 1, False, 1)])
@pytest.mark.parametrize("syntax", ["1.2.840.10008.1.2.1", P.RLE, P.DEFLATED_FRAME])
def test_encode_and_decode(bits, stored, signed, samples, syntax):
    if bits == 1 and syntax != "1.2.840.10008.1.2.1":
        return
    d = P.Description(7, 5, bits, stored, signed, samples, photometric="RGB" if samples == 3 else "MONOCHROME2")
    rng = np.random.default_rng(1023)
    low, high = (-(2 ** (stored - 1)), 2 ** (stored - 1)) if signed else (0, 2**stored)
    image = rng.integers(low, high, (7, 5, 3) if samples == 3 else (7, 5))
    image[2:5] = image[2, 0]
    assert np.array_equal(P.decode(P.encode(image, d, syntax), d, syntax), image)


def test_bits_across_frames():
    d = P.Description(3, 3, 1, frames=3)
    bits = np.random.default_rng(2).integers(0, 2, 27)
    found = P.native_frames(np.packbits(bits, bitorder="little").tobytes(), d)
    assert [f[1] for f in found] == [0, 1, 2]
    assert np.array_equal(np.concatenate([P.decode(x, d, "1.2.840.10008.1.2.1", o).reshape(-1) for _, o, x in found]), bits)


def test_fragments_by_offsets_and_without():
    parts = [b"ab", b"cd", b"ef"]
    assert P.encapsulated_frames([np.array([0, 20], "<u4").tobytes(), *parts], 2) == [(0, b"abcd"), (1, b"ef")]
    assert P.encapsulated_frames([b"", *parts], 1) == [(0, b"abcdef")]
    assert P.encapsulated_frames([b"", *parts], 3) == [(0, b"ab"), (1, b"cd"), (2, b"ef")]
    assert P.encapsulated_frames([b"", *parts], 2, np.array([0, 10], "<u8").tobytes(), np.array([1, 4], "<u8").tobytes()) == [(0, b"a"), (1, b"cdef")]
    with pytest.raises(P.DecoderError):
        P.encapsulated_frames([b"", *parts], 2)


def test_segments_fall_and_rise():
    assert P.segmented([0, 2, 10, 20, 1, 2, 0, 1, 2, 8]).tolist() == [10, 20, 10, 0, 4, 8]


def test_windows_and_colour():
    x = np.array([0, 50, 100])
    assert P.Window(50.5, 101).apply(x).tolist() == [0.0, 0.5, 1.0]
    assert P.Window(50, 100, "SIGMOID").apply(x)[1] == 0.5
    rgb = np.random.default_rng(3).integers(0, 256, (4, 4, 3)).astype(np.uint8)
    assert np.abs(P.ybr_to_rgb(P.rgb_to_ybr(rgb)).astype(int) - rgb).max() <= 2
    assert P.cut_out(np.arange(12).reshape(3, 4), 1, 1, -1, 0).tolist() == [[5, 6], [9, 10]]


@pytest.mark.parametrize("kind", list(W.TYPES))
def test_waveform_cycle(kind):
    info = np.iinfo(np.dtype(W.TYPES[kind]))
    x = np.random.default_rng(4).integers(max(info.min, -(2**62)), min(info.max, 2**62), (3, 17))
    assert np.array_equal(W.decode(W.encode(x, kind) + b"\1", kind, 3) if np.dtype(W.TYPES[kind]).itemsize > 1 else W.decode(W.encode(x, kind), kind, 3), x)
    if kind in ("SB", "UB"):
        with pytest.raises(ValueError):
            W.encode(np.array([[1000]]), kind)


def _elements(spark, *sets):
    rows = [r for name, text in sets for r in dicom_json.rows(name, dicom_json.read(text))]
    return spark.createDataFrame([tuple(r) for r in rows], dicom_json.DDL)


def _image(values, **more):
    data = np.asarray(values, "<u2")
    head = {"00280010": ("US", [data.shape[1]]), "00280011": ("US", [data.shape[2]]), "00280100": ("US", [16]), "00280101": ("US", [12]), "00280103": ("US", [0]), "00280008": ("IS", [data.shape[0]]), "00020010": ("UI", [p10.EXPLICIT])}
    e = {k: {"vr": vr, "Value": v} for k, (vr, v) in (head | more).items()}
    import base64

    return json.dumps(e | {"7FE00010": {"vr": "OW", "InlineBinary": base64.b64encode(data.tobytes()).decode()}})


def test_frames_over_a_table(spark):
    a = _image([[[0, 1], [2, 4095]], [[7, 7], [7, 7]]])
    df = _elements(spark, ("a", a), ("none", "{}"), ("bad", json.dumps({"00020010": {"vr": "UI", "Value": ["1.2.840.10008.1.2.4.90"]}} | {k: v for k, v in json.loads(a).items() if k != "00020010"})))
    got = {(r.file, r.frame_index): r for r in pixels.stored_values(df).collect()}
    assert got["a", 0].pixels == [0, 1, 2, 4095] and got["a", 1].pixels == [7] * 4
    assert "no decoder" in got["bad", None].error
    assert pixels.frames(df).where("file = 'a'").count() == 2
    ordered = pixels.stored_values(df.coalesce(1).sortWithinPartitions("file", "ordinal"), together=True).collect()
    assert {(r.file, r.frame_index): (r.pixels, r.error) for r in ordered} == {k: (r.pixels, r.error) for k, r in got.items()}
    shown = {r.frame_index: r.pixels for r in pixels.rendered(df, orientation="flip-horizontal").where("file = 'a'").collect()}
    assert shown[0] == [0, 0, 255, 0]
    rle = pixels.transcoded(df, P.RLE).where("file = 'a' and frame_index = 0").collect()[0]
    assert P.decode(bytes(rle.data), P.Description(2, 2, 16, 12), P.RLE).reshape(-1).tolist() == [0, 1, 2, 4095]


def test_waveforms_over_a_table(spark):
    import base64

    x = np.arange(10, dtype="<i2")
    group = {"003A0005": {"vr": "US", "Value": [2]}, "54001006": {"vr": "CS", "Value": ["SS"]}, "54001010": {"vr": "OW", "InlineBinary": base64.b64encode(x.tobytes()).decode()}}
    df = _elements(spark, ("w", json.dumps({"54000100": {"vr": "SQ", "Value": [group, {}, {**group, "54001006": {"vr": "CS", "Value": ["??"]}}]}})))
    rows = waveforms.chunks(df, 3).collect()
    assert {(r.group_ix, r.channel_ix, r.first_sample): r.samples for r in rows if not r.error} == {(0, 0, 0): [0, 2, 4], (0, 0, 3): [6, 8], (0, 1, 0): [1, 3, 5], (0, 1, 3): [7, 9]}
    assert [r.group_ix for r in rows if r.error] == [2]
    assert waveforms.samples(df).count() == 10
    good = waveforms.chunks(df, 3).where("error is null").orderBy("first_sample", ascending=False)
    written = waveforms.encoded(good, "SS")
    assert {(r.group_ix, r.channel_ix, r.first_sample): r.samples for r in waveforms.chunks(written.drop("error"), 3).collect()} == {(0, 0, 0): [0, 2, 4], (0, 0, 3): [6, 8], (0, 1, 0): [1, 3, 5], (0, 1, 3): [7, 9]}
    assert {r.error for r in waveforms.encoded(good.where("first_sample = 3"), "SS").collect()} == {"samples of channel 0 are missing or there twice"}
    wide = spark.createDataFrame([("w", 0, 0, 0, [1, 128]), ("v", 0, 0, 0, [-128, 127])], "file string, group_ix int, channel_ix int, first_sample bigint, samples array<bigint>")
    assert {r.file: r.fits for r in waveforms.in_range(wide, "SB").collect()} == {"w": False, "v": True}
    assert {r.error for r in waveforms.encoded(wide.where("file = 'w'"), "SB").collect()} == {"samples do not fit SB"}


def test_palettes_and_png():
    import struct
    import zlib

    hot, pet = P.standard_palette("HOT_IRON"), P.standard_palette("PET")
    assert hot[[1, 127, 128, 129, 192, 254, 255]].tolist() == [[2, 0, 0], [254, 0, 0], [255, 0, 0], [255, 2, 0], [255, 128, 4], [255, 252, 252], [255, 255, 255]]
    assert pet[[1, 32, 63, 64, 107, 127, 128, 129, 191, 192, 213, 255]].tolist() == [[0, 2, 1], [0, 65, 63], [0, 128, 125], [1, 126, 127], [86, 41, 213], [126, 1, 253], [128, 0, 255], [130, 2, 252], [253, 126, 4], [255, 128, 0], [255, 170, 85], [255, 255, 255]]
    assert P.standard_palette("SUMMER")[[0, 1, 16, 128, 160, 255]].tolist() == [[0, 255, 0], [0, 255, 0], [0, 247, 0], [0, 191, 2], [0, 175, 65], [0, 128, 254]]
    assert P.standard_palette("WINTER")[[0, 128, 192, 255]].tolist() == [[0, 0, 255], [1, 128, 191], [64, 192, 159], [127, 255, 128]]
    assert P.standard_palette("SPRING")[7].tolist() == [255, 7, 248] and P.standard_palette("FALL")[7].tolist() == [255, 248, 0] and P.standard_palette("PET_20_STEP")[[12, 13, 255]].tolist() == [[0, 0, 0], [96, 0, 80], [255, 255, 255]]
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    data = P.png(image)
    at, parts = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        parts[kind] = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + parts[kind])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(2, 13)
    assert not lines[:, 0].any() and np.array_equal(lines[:, 1:].reshape(2, 4, 3), image)


def test_colour_tables_overlays_and_look_up_sequences(spark):
    import base64

    inline = lambda x, t="<u2": base64.b64encode(np.asarray(x, t).tobytes()).decode()
    table = {f"0028110{i}": ("US", [4, 0, 8]) for i in (1, 2, 3)}
    a = json.loads(_image([[[0, 1], [2, 3]]], **table, **{"00280004": ("CS", ["PALETTE COLOR"])}))
    a |= {f"0028120{i}": {"vr": "OW", "InlineBinary": inline([10 * i, 20 * i, 30 * i, 40 * i])} for i in (1, 2, 3)}
    b = json.loads(_image([[[0, 1], [2, 3]]]))
    b |= {"00283000": {"vr": "SQ", "Value": [{"00283002": {"vr": "US", "Value": [4, 0, 16]}, "00283006": {"vr": "US", "Value": [100, 200, 300, 400]}}]}}
    b |= {"00283010": {"vr": "SQ", "Value": [{"00283002": {"vr": "US", "Value": [2, 200, 8]}, "00283006": {"vr": "OW", "InlineBinary": inline([51, 204])}}]}}
    c = json.loads(_image([[[0, 4095], [0, 0]]])) | {"60000010": {"vr": "US", "Value": [1]}, "60000011": {"vr": "US", "Value": [2]}, "60000050": {"vr": "SS", "Value": [2, 1]}, "60003000": {"vr": "OW", "InlineBinary": base64.b64encode(bytes([2, 0])).decode()}}
    df = _elements(spark, *[(n, json.dumps(x)) for n, x in zip("abc", (a, b, c), strict=True)])
    got = {r.file: (r.samples, r.pixels, r.error) for r in pixels.rendered(df, overlays=True).collect()}
    assert got["a"] == (3, [10, 20, 30, 20, 40, 60, 30, 60, 90, 40, 80, 120], None)
    assert got["b"] == (1, [51, 51, 204, 204], None) and got["c"] == (1, [0, 255, 0, 255], None)
    assert {r.file: r.pixels[-3:] for r in pixels.rendered(df.where("file = 'c'"), colours="HOT_IRON").collect()} == {"c": [0, 0, 0]}
    files = pixels.image_files(df).collect()
    assert {r.name for r in files} == {"a.0000.png", "b.0000.png", "c.0000.png"} and all(bytes(r.content[:4]) == b"\x89PNG" for r in files)
    assert {bytes(r.content) for r in pixels.image_files(df.where("file = 'c'"), "raw").collect()} == {np.array([0, 4095, 0, 0], "<u2").tobytes()}


def test_presentation_tables_and_items(spark):
    from lumenframe.operators import modules

    a = json.loads(_image([[[0, 1], [2, 3]]])) | {"00281050": {"vr": "DS", "Value": [1.5]}, "00281051": {"vr": "DS", "Value": [4]}, "00281056": {"vr": "CS", "Value": ["LINEAR"]}}
    a |= {"20500010": {"vr": "SQ", "Value": [{"00283002": {"vr": "US", "Value": [3, 0, 8]}, "00283006": {"vr": "US", "Value": [10, 20, 255]}}]}}
    got = pixels.rendered(_elements(spark, ("a", json.dumps(a)))).first().pixels
    level = np.clip((np.arange(4) - 1.0) / 3 + 0.5, 0, 1)
    assert got == [[10, 20, 255][int(np.floor(x * 2 + 0.5))] for x in level]
    groups = {"54000100": {"vr": "SQ", "Value": [{"003A0005": {"vr": "US", "Value": [2]}}, {}, {"003A001A": {"vr": "DS", "Value": [250.5]}, "54001006": {"vr": "CS"}}]}}
    rows = modules.sequence_items(_elements(spark, ("w", json.dumps(groups)), ("none", "{}")), "54000100").orderBy("item_ix").collect()
    assert [(r.file, r.item_ix, r.n_channels, r.sampling_frequency, r.interpretation) for r in rows] == [("w", 0, 2, None, None), ("w", 2, None, 250.5, None)]


def test_transcoded_data_sets_keep_their_images(spark):
    a = _image([[[0, 1], [2, 4095]], [[7, 7], [7, 9]]])
    bad = json.dumps({"00020010": {"vr": "UI", "Value": ["1.2.840.10008.1.2.4.90"]}} | {k: v for k, v in json.loads(a).items() if k != "00020010"})
    df = _elements(spark, ("a", a), ("bad", bad))
    rle, failed = pixels.transcoded_elements(df, P.RLE)
    assert [(r.file, "no decoder" in r.error) for r in failed.collect()] == [("bad", True)]
    back, _ = pixels.transcoded_elements(rle, p10.EXPLICIT)
    for x in (rle, back):
        got = {r.frame_index: r.pixels for r in pixels.stored_values(x.where("file = 'a'")).collect()}
        assert got == {0: [0, 1, 2, 4095], 1: [7, 7, 7, 9]}
    dark, _ = pixels.transcoded_elements(df.where("file = 'a'"), p10.EXPLICIT, hook=lambda x, i: x // 2 + i)
    assert {r.frame_index: r.pixels for r in pixels.stored_values(dark).collect()} == {0: [0, 0, 1, 2047], 1: [4, 4, 4, 5]}
    assert "size" in pixels.transcoded_elements(df.where("file = 'a'"), P.RLE, hook=lambda x, i: x[:1])[1].first().error
    assert rle.where("file = 'a' and tag = '00020010'").first().values_json == json.dumps([P.RLE]) and rle.where("file = 'bad'").count() == df.where("file = 'bad'").count()
