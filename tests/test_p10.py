"""Part 10 and JSON: round trips, chunk invariance, broken files, the data source."""

import json
import os
import random
import struct

import pytest

from lumenframe.sources import charsets, datasource, dicom_json, p10
from lumenframe.sources import values as V

SAMPLE = json.dumps(
    {
        "00080018": {"vr": "UI", "Value": ["2.25.11"]},
        "00080020": {"vr": "DA", "Value": ["20240229"]},
        "00081140": {"vr": "SQ", "Value": [{"00081150": {"vr": "UI", "Value": ["1.2"]}, "00400275": {"vr": "SQ", "Value": [{}, {"00400007": {"vr": "LO", "Value": ["Tief", "Größe"]}}]}}, {}]},
        "00100010": {"vr": "PN", "Value": [{"Alphabetic": "Müller^Jörg", "Ideographic": "山田^太郎"}]},
        "00101010": {"vr": "AS", "Value": ["045Y"]},
        "00180050": {"vr": "DS", "Value": [1.5, 2]},
        "00200013": {"vr": "IS", "Value": [7]},
        "00280010": {"vr": "US", "Value": [2, 65535]},
        "00280106": {"vr": "SS", "Value": [-5]},
        "00189073": {"vr": "FD", "Value": [0.25]},
        "00091001": {"vr": "SV", "Value": ["-9223372036854775808", 5]},
        "00091002": {"vr": "UV", "Value": ["18446744073709551615"]},
        "00091003": {"vr": "AT", "Value": ["00280010", "7FE00010"]},
        "00091004": {"vr": "UR", "Value": ["http://example.test/x"]},
        "00091005": {"vr": "UC", "Value": ["long", "text"]},
        "00091006": {"vr": "OL", "InlineBinary": "AQIDBA=="},
        "00091007": {"vr": "SQ", "Value": []},
        "00104000": {"vr": "LT"},
        "7FE00010": {"vr": "OW", "InlineBinary": "AAECAwQFBgc="},
    },
    ensure_ascii=False,
)


def canon(text):
    return json.loads(text)


def dictionary():
    return {int(k, 16): e["vr"] for k, e in _flat(json.loads(SAMPLE))}


def _flat(item):
    for k, e in item.items():
        yield k, e
        if e["vr"] == "SQ":
            for x in e.get("Value", []):
                yield from _flat(x)


@pytest.mark.parametrize("syntax", [p10.IMPLICIT, p10.EXPLICIT, p10.BIG, p10.DEFLATED])
def test_json_to_file_and_back(syntax):
    data = p10.write(dicom_json.read(SAMPLE), syntax)
    walker = p10.Walker(data, p10.Config(dictionary=dictionary()))
    found = dicom_json.write(e for e in walker.elements() if e.tag >> 16 != 2)
    assert walker.syntax == syntax
    assert canon(found) == canon(SAMPLE)


def test_any_chunking_reads_the_same():
    data = p10.write(dicom_json.read(SAMPLE), p10.DEFLATED)
    whole = list(p10.Walker(data).elements())
    rnd = random.Random(1)
    for size in (1, 15, None):
        at, parts = 0, []
        while at < len(data):
            n = size or rnd.randint(1, 255)
            parts.append(data[at : at + n])
            at += n
        assert list(p10.Walker(parts).elements()) == whole


def test_wanted_tags_stop_early():
    data = p10.write(dicom_json.read(SAMPLE))
    got = [e.hex for e in p10.Walker(data[: data.index(b"\x10\x00\x20\x00") if b"\x10\x00\x20\x00" in data else len(data)], p10.Config(tags=frozenset([0x00080020]))).elements()]
    assert got == ["00080020"]


def test_encapsulated_fragments_survive():
    e = [p10.Element((), p10.PIXELS, "OB", fragments=[b"", b"abcd", b"xy"])]
    back = [x for x in p10.Walker(p10.write(e)).elements() if x.tag == p10.PIXELS]
    assert back[0].fragments == [b"", b"abcd", b"xy"]
    text = dicom_json.write(back)
    assert [x.fragments for x in dicom_json.read(text)] == [[b"", b"abcd", b"xy"]]


def test_truncated_and_rogue():
    data = p10.write(dicom_json.read(SAMPLE))
    with pytest.raises(p10.P10Error):
        list(p10.Walker(data[:-3]).elements())
    rogue = data + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    assert list(p10.Walker(rogue).elements()) == list(p10.Walker(data).elements())


def test_undefined_length_un_is_read_as_implicit_sequence():
    inner = struct.pack("<HHI", 0x0008, 0x0020, 8) + b"20240101"
    item = struct.pack("<HHI", 0xFFFE, 0xE000, len(inner)) + inner
    body = struct.pack("<HH", 0x0009, 0x1001) + b"UN\0\0" + struct.pack("<I", p10.UNDEFINED) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    head = p10.write([], p10.EXPLICIT)
    got = [e for e in p10.Walker(head + body, p10.Config(dictionary={0x00080020: "DA"})).elements() if e.path]
    assert [(e.path, e.vr, e.value) for e in got] == [((("00091001", 0),), "DA", b"20240101")]


@pytest.mark.parametrize("data, declared, text", [
    (b"M\xfcller", "ISO_IR 100", "Müller"),
    (b"Yamada^Tarou=\x1b$B;3ED\x1b(B^\x1b$BB@O:\x1b(B", "\\ISO 2022 IR 87", "Yamada^Tarou=山田^太郎"),
    (b"Hong^Gildong=\x1b$)C\xfb\xf3^\x1b$)C\xd1\xce\xd4\xd7", "\\ISO 2022 IR 149", "Hong^Gildong=洪^吉洞"),
    (b"\xc4\xcf\xda\xc0\xde^\xc0\xdb\xb3", "ISO_IR 13", "ﾄﾏﾚﾀﾞ^ﾀﾛｳ"),
    ("Größe".encode(), "ISO_IR 192", "Größe"),
    (b"", None, ""),
])
def test_character_sets(data, declared, text):
    assert charsets.decode(data, declared) == text


def test_values_of_decimal_strings_fit():
    for x in (1 / 3, -1e-20 / 7, 123456789012345.678, 0.1, -12345678.123456789):
        assert len(V.from_json([x], "DS").strip()) <= 16


def test_source_reads_writes_and_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for i in range(5):
        with open(f"{folder}/f{i}.dcm", "wb") as f:
            f.write(p10.write(dicom_json.read(SAMPLE)))
    with open(f"{folder}/broken.dcm", "wb") as f:
        f.write(p10.write(dicom_json.read(SAMPLE))[:-3])
    with open(f"{folder}/text.txt", "w") as f:
        f.write("no dicom")
    datasource.register(spark)
    read = spark.read.format("dicom").option("path", folder)
    df = read.load()
    assert df.where("error is null").select("file").distinct().count() == 6
    assert {os.path.basename(r.file): "prefix" in r.error for r in df.where("error is not null").collect()} == {"broken.dcm": False, "text.txt": True}
    pruned = spark.read.format("dicom").option("path", folder).option("tags", "00080020,00080018").load().where("error is null")
    assert {r.tag for r in pruned.select("tag").distinct().collect()} == {"00080020", "00080018"}
    out = str(tmp_path / "out")
    datasource.save(df, out, p10.BIG)
    binary = datasource.parsed(spark.read.format("binaryFile").load(folder), mode="PERMISSIVE")
    assert binary.where("error is null").count() == df.where("error is null").count() and binary.where("error is not null").count() == 2
    again = dicom_json.elements_to_json(spark.read.format("dicom").option("path", out).load().where("tag not like '0002%'")).collect()
    assert len(again) == 5 and all(canon(r.text) == canon(SAMPLE) for r in again)
    stream = spark.readStream.format("dicom").option("path", folder).option("maxFilesPerTrigger", "2").load()
    q = stream.writeStream.format("memory").queryName("dicom_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dicom_rows").count() == df.count()


def test_json_rows_round_trip(spark):
    df = spark.createDataFrame([("a", SAMPLE), ("b", "{broken"), ("c", None)], "file string, text string")
    rows = dicom_json.json_to_elements(df)
    assert [(r.file, r.tag) for r in rows.where("error is not null").collect()] == [("b", None)]
    back = dicom_json.elements_to_json(rows).collect()
    assert [r.file for r in back] == ["a"] and canon(back[0].text) == canon(SAMPLE)


def test_inputs_globs_and_output_names(spark, tmp_path):
    for name in ("a/1.dcm", "b/1.dcm", "b/.hidden", "b/x.tmp"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(p10.write(dicom_json.read(SAMPLE)))
    root = str(tmp_path)
    names = lambda x, **more: [os.path.relpath(f[0], root) for f in datasource.walk(x, **more)]
    assert names(root) == ["a/1.dcm", "b/.hidden", "b/1.dcm"] and names(root, hidden=False) == ["a/1.dcm", "b/1.dcm"] and names(f"{root}/b/*.DCM") == ["b/1.dcm"]
    assert datasource.split_glob("/x/y/*/z?.dcm")[0] == "/x/y" and datasource.split_glob("/x/y") == ("/x/y", None) and names(f"{root}/a/1.dcm\n{root}/b/1.dcm") == ["a/1.dcm", "b/1.dcm"]
    (tmp_path / "list.txt").write_text(f"{root}/b\n\n")
    assert datasource.inputs([f"{root}/a"], f"{root}/list.txt") == [f"{root}/a", f"{root}/b"]
    for wrong in ([f"{root}/a", f"{root}/a/"], [root, f"{root}/b/1.dcm"]):
        with pytest.raises(ValueError, match="twice|lies in"):
            datasource.inputs(wrong)
    datasource.register(spark)
    df = spark.read.format("dicom").option("path", root).option("extension", "dcm").load()
    with pytest.raises(Exception, match="same output name"):
        datasource.save(df, str(tmp_path / "out"))
    assert not [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")]
    datasource.save(df, str(tmp_path / "out"), base=root)
    assert names(str(tmp_path / "out")) == ["out/a/1.dcm", "out/b/1.dcm"]


@pytest.mark.parametrize("step", [1, 7, 100, 10_000])
def test_pushed_bytes_give_the_same_elements(step):
    data = p10.write(dicom_json.read(SAMPLE))
    reader, found = p10.Pushed(), []
    for i in range(0, len(data), step):
        found += reader.push(data[i : i + step])
    found += reader.push(b"", last=True)
    want = list(p10.Walker(data).elements())
    assert found == want
    with pytest.raises(p10.P10Error):
        p10.Pushed().push(data[:-3], last=True)
    tokens = list(p10.Walker(data).tokens(5))
    assert max(len(t[1]) for t in tokens if t[0] == "bytes") <= 5 and b"".join(t[1] for t in tokens if t[0] == "bytes") == b"".join(e.value for e in want)


def test_written_without_header_and_with_a_version():
    bare = p10.write(dicom_json.read(SAMPLE), header=False)
    assert not p10.is_p10(bare) and [e.hex for e in p10.Walker(bare, p10.Config(default_syntax=p10.EXPLICIT)).elements()][0] == "00080005"
    named = {e.tag: e.value for e in p10.Walker(p10.write(dicom_json.read(SAMPLE), version="ENGINE 1")).elements()}
    assert named[0x00020013].strip() == b"ENGINE 1"
    text = dicom_json.write(dicom_json.read('{"00420011": {"vr": "OB", "InlineBinary": "AAE="}, "00090010": {"vr": "OB", "InlineBinary": "AAE="}}'), binary={0x00420011})
    assert json.loads(text) == {"00420011": {"vr": "OB", "InlineBinary": "AAE="}, "00090010": {"vr": "OB"}}


def test_limits_and_representations():
    data = p10.write(dicom_json.read(SAMPLE), p10.IMPLICIT)
    with pytest.raises(p10.P10Error, match="too long"):
        list(p10.Walker(data, p10.Config(max_string=2)).elements())
    assert [p10.settled("US or SS", x) for x in (None, 0, 1)] == ["US", "US", "SS"] and p10.settled("OB or OW", None) == "OW" and p10.settled("LO", 1) == "LO"
