"""JPEG frames against the decoder of the Java library, and lossless ones against a coder of the tests."""

import struct

import numpy as np
import pytest

from lumenframe.functions import jpeg as J
from lumenframe.functions import pixeldata as P


def _java(spark, image, quality_path):
    """(bytes, decoded samples) of an image coded and read by the Java library."""
    jvm = spark._jvm
    grey = image.ndim == 2
    held = jvm.java.awt.image.BufferedImage(image.shape[1], image.shape[0], 10 if grey else 1)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            r, g, b = (int(image[y, x]),) * 3 if grey else map(int, image[y, x])
            if grey:
                held.getRaster().setSample(x, y, 0, r)
            else:
                held.setRGB(x, y, r << 16 | g << 8 | b)
    jvm.javax.imageio.ImageIO.write(held, "jpg", jvm.java.io.File(quality_path))
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(quality_path))
    with open(quality_path, "rb") as f:
        data = f.read()
    if grey:
        return data, np.array([[back.getRaster().getSample(x, y, 0) for x in range(image.shape[1])] for y in range(image.shape[0])])
    rgb = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(image.shape[1])] for y in range(image.shape[0])])
    return data, np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], -1)


def test_sequential_images_as_the_java_library_reads_them(spark, tmp_path):
    y, x = np.mgrid[0:21, 0:34]
    grey = (128 + 90 * np.sin(x / 5) * np.cos(y / 4)).astype(np.uint8)
    data, want = _java(spark, grey, str(tmp_path / "a.jpg"))
    assert np.abs(J.decode(data).astype(int) - want).max() <= 1
    d = P.Description(21, 34, 8)
    assert np.array_equal(P.decode(data, d, "1.2.840.10008.1.2.4.50"), J.decode(data))
    colour = np.stack([grey, np.full_like(grey, 90), 255 - grey], -1)
    data, want = _java(spark, colour, str(tmp_path / "b.jpg"))
    found = P.ybr_to_rgb(J.decode(data)).astype(int)
    assert np.abs(found - want).mean() <= 6  # the colour differences are spread in another way


def _coded(image, precision, predictor, restart_rows=0):
    """A lossless stream with a code of five bits for each of the 17 sizes."""
    n = image.shape[2] if image.ndim == 3 else 1
    samples = image.reshape(image.shape[0], image.shape[1], n).astype(int)
    rows, columns = samples.shape[:2]

    def part(top, bottom):
        bits = ""
        for y in range(top, bottom):
            for x in range(columns):
                for k in range(n):
                    a = samples[y, x - 1, k] if x else None
                    b = samples[y - 1, x, k] if y > top else None
                    c = samples[y - 1, x - 1, k] if x and y > top else None
                    p = 1 << (precision - 1) if a is None and b is None else a if b is None else b if a is None else [0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor]
                    d = int(samples[y, x, k] - p + 32768) % 65536 - 32768
                    size = 16 if d == -32768 else abs(d).bit_length()
                    bits += f"{size:05b}"
                    if 0 < size < 16:
                        bits += f"{d if d > 0 else d + (1 << size) - 1:0{size}b}"
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")

    step = restart_rows or rows
    scans = [part(i, min(rows, i + step)) for i in range(0, rows, step)]
    body = scans[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + s for i, s in enumerate(scans[1:]))
    segment = lambda kind, data: bytes([0xFF, kind]) + struct.pack(">H", len(data) + 2) + data
    head = segment(0xC4, bytes([0]) + bytes([0] * 4 + [17] + [0] * 11) + bytes(range(17)))
    head += segment(0xC3, struct.pack(">BHHB", precision, rows, columns, n) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n)))
    head += segment(0xDD, struct.pack(">H", restart_rows * columns)) if restart_rows else b""
    return b"\xff\xd8" + head + segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([predictor, 0, 0])) + body + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("shape, precision, restart", [((7, 9), 16, 0), ((7, 9), 12, 2), ((5, 4, 3), 8, 0)])
def test_lossless_images_come_back(predictor, shape, precision, restart):
    image = np.random.default_rng(predictor).integers(0, 2**precision, shape)
    assert np.array_equal(J.decode(_coded(image, precision, predictor, restart)), image)


def test_broken_streams_are_told():
    image = np.arange(64).reshape(8, 8)
    data = _coded(image, 8, 1)
    for wrong in (b"", b"\xff\xd8", data[:40], b"\xff\xd8\xff\xc2\0\x0b" + b"\0" * 9, data.replace(b"\xff\xc4", b"\xff\xe1")):
        with pytest.raises(J.JpegError):
            J.decode(wrong)
    with pytest.raises(P.DecoderError):
        P.decode(b"x", P.Description(8, 8, 8), "1.2.840.10008.1.2.4.70")
    signed = P.decode(_coded(np.array([[65535, 1]]), 16, 1), P.Description(1, 2, 16, 16, True), "1.2.840.10008.1.2.4.70")
    assert signed.tolist() == [[-1, 1]]
