import hashlib
import random
import zlib

import numpy as np
import pytest

from glossa.llm import jpeg

rng = random.Random(1)
PAYLOADS = [b"", b"a", bytes(rng.randrange(256) for _ in range(1000)), b"\xff" * 576, b"\x00\xff" * 5000, bytes(rng.randrange(256) for _ in range(300_000)), "héllo wörld ".encode() * 77]


class Bits:
    """A one-bit-at-a-time reader, for an independent decoder."""

    def __init__(self, data: bytes):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def take(self, n: int) -> int:
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)


def slow_decode(file: bytes) -> list[int]:
    """DC samples of a grey baseline image, as the standard describes, bit by bit."""
    at, tables, interval = 2, {}, 0
    while True:
        marker, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            tables[body[0]] = {code: s for s, code in jpeg.huffman_codes(tuple(body[1:17]), tuple(body[17:])).items()}
        if marker == 0xDB:
            q = body[1]
        if marker == 0xDD:
            interval = int.from_bytes(body, "big")
        if marker == 0xDA:
            break
    scan, out = file[at:-2], []
    pieces, now, k = [], bytearray(), 0
    while k < len(scan):
        if scan[k] == 255:
            if scan[k + 1] == 0:
                now.append(255)
            else:
                pieces.append(bytes(now))
                now = bytearray()
            k += 2
        else:
            now.append(scan[k])
            k += 1
    for piece in [*pieces, bytes(now)]:
        reader, dc = Bits(piece), 0

        def symbol(table):
            code = ""
            while True:
                code += str(reader.take(1))
                found = table.get((int(code, 2), len(code)))
                if found is not None:
                    return found

        for _ in range(interval):
            n = symbol(tables[0])
            v = reader.take(n)
            dc += v - ((1 << n) - 1 if n and v < 1 << (n - 1) else 0)
            assert symbol(tables[16]) == 0
            out.append(dc * q // 8 + 128)
    return out


def test_round_trip():
    padded = [jpeg.pad(p) for p in PAYLOADS]
    assert all(len(p) % 576 == 0 and p for p in padded)
    files = jpeg.encode(padded)
    for p, images in zip(padded, jpeg.thumbnails(files)):
        assert b"".join(i.thumbnail.tobytes() for i in images) == p
    assert len(jpeg.thumbnails([files[5]])[0]) == 2  # longer than one image may be tall
    assert bytes(slow_decode(files[2])) == padded[2]


def test_long_payloads_image_by_image():
    rng = np.random.default_rng(2)
    payload = jpeg.pad(rng.integers(0, 255, 3_000_000, dtype=np.uint8).tobytes())
    small = jpeg.pad(b"small")
    files = jpeg.encode([small, payload, small])
    images = jpeg.thumbnails(files)
    assert [b"".join(i.thumbnail.tobytes() for i in x) for x in images] == [small, payload, small] and len(images[1]) == 16


def peak_mb(size: int) -> float:
    """Of storing a text of so many bytes and reading it back, in a process of its own."""
    import subprocess
    import sys

    code = f"""
import resource, numpy as np
from glossa.llm import jpeg
p = jpeg.pad((b"some words of a text, " * ({size} // 22)))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
file = jpeg.encode([p])[0]
images = jpeg.thumbnails([file])[0]
assert b"".join(i.thumbnail.tobytes() for i in images) == p
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    return float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)


def test_memory_of_long_texts():
    assert peak_mb(30_000_000) < 700


def test_components_in_several_scans_and_no_end():
    """Luminance in a scan of its own, after one of the colours, with other tables in between; the end marker is cut off."""
    values = np.array([[60, 200], [90, 128]])
    dc, ac = jpeg.huffman_codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS), jpeg.huffman_codes(jpeg.AC_COUNTS, jpeg.AC_SYMBOLS)[0]

    def scan(samples):
        bits, last = "", 0
        for v in samples:
            d, last = v - last, v
            n = abs(d).bit_length()
            bits += f"{dc[n][0]:0{dc[n][1]}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + f"{ac[0]:0{ac[1]}b}"
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    seg = jpeg._segment
    tables = seg(0xC4, bytes([0x00, *jpeg.DC_COUNTS, *jpeg.DC_SYMBOLS])) + seg(0xC4, bytes([0x10, *jpeg.AC_COUNTS, *jpeg.AC_SYMBOLS]))
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + tables
    one = lambda c: seg(0xDA, bytes([1, c, 0, 0, 63, 0]))
    other = seg(0xC4, bytes([0x00, 0, 1, *[0] * 14, 3]))
    file = head + one(2) + scan([3]) + one(1) + scan((values - 128).ravel().tolist()) + other + one(3) + scan([0])
    for media in (file + b"\xff\xd9", file, file + b"\xff"):
        (image,) = jpeg.thumbnails([media])[0]
        assert (image.width, image.height) == (16, 16) and (image.thumbnail == values).all()


def colour_jpeg() -> tuple[bytes, np.ndarray]:
    """A 32x32 image with 2x2 subsampled colours and AC coefficients, and its luminance DC values."""
    values = np.arange(16).reshape(4, 4) * 10 + 50
    dc, ac = jpeg.huffman_codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS), jpeg.huffman_codes((0, 2, 1) + (0,) * 13, (0x00, 0x01, 0xF0))
    bits = ""
    last = [0, 0, 0]

    def block(c, v, extra):
        nonlocal bits
        d, last[c] = v - last[c], v
        n = abs(d).bit_length()
        bits += f"{dc[n][0]:0{dc[n][1]}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")
        for s in extra:
            code, size = ac[s]
            bits += f"{code:0{size}b}" + "1" * (s & 15)
        bits += f"{ac[0][0]:0{ac[0][1]}b}"

    for my in range(2):
        for mx in range(2):
            for y in range(2):
                for x in range(2):
                    block(0, int(values[2 * my + y, 2 * mx + x]) - 128, [0x01, 0xF0, 0x01])
            block(1, 3, [])
            block(2, -4, [0x01])
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    file = (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xC0, bytes([8, 0, 32, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + seg(0xC4, bytes([0x00, *jpeg.DC_COUNTS, *jpeg.DC_SYMBOLS])) + seg(0xC4, bytes([0x10, 0, 2, 1, *[0] * 13, 0x00, 0x01, 0xF0])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )
    return file, values


def test_colour_images_with_ac_coefficients():
    file, values = colour_jpeg()
    (image,) = jpeg.thumbnails([file])[0]
    assert (image.width, image.height) == (32, 32) and (image.thumbnail == values).all()


@pytest.mark.parametrize("bad", [None, b"", b"xx", b"\xff\xd8\xff\xd9", jpeg.encode([jpeg.pad(b"abc")])[0][:120], b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"])
def test_broken_media(bad):
    good = jpeg.encode([jpeg.pad(b"abc")])[0]
    found = jpeg.thumbnails([good, bad, good])
    assert found[1] is None and found[0] and found[2]


def test_query_rows(docs, corpus, nothing):
    rows = jpeg.describe_media(jpeg.store_text(docs)).collect()
    assert len(rows) == len(corpus)
    want = {}
    for i, t, *_ in corpus:
        p = jpeg.pad((t or "").encode())
        want.setdefault((i, len((t or "").encode())), set()).add((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    for r in rows:
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"], r["n_bytes"]]
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert jpeg.describe_media(jpeg.store_text(nothing)).count() == 0
