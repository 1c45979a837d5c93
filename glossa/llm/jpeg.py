"""Media columns as baseline JPEG: lossless storage in DC samples, DC-only thumbnails, thumbnail hashes.

Reading: markers are parsed, scans are split at restart markers, and the restart intervals of all images of a batch that
share tables are Huffman-decoded in lockstep by numpy: one lane for each interval. AC coefficients are decoded to be stepped over; the
DC coefficients of the luminance component make a thumbnail of one sample for each 8x8 block.
Writing: bytes become the constant 8x8 blocks of a grey image 24 blocks wide. With a DC quantizer of 8 a block's DC
coefficient is its sample less 128, so every byte comes back exactly. One restart interval is a row of 24 blocks. Payloads
longer than a JPEG's largest height go to several images, one after the other.

Components may come in one scan or in several; a file whose end marker is missing is read as far as it goes. A long payload or file is
worked on image by image, so memory grows with it by a small factor only.

Null text: empty, stored as 576 bytes of 255. Null or broken media: null dimensions, thumbnail and hash. A null id stays null, one that is
no number becomes null. Other columns are not read, whatever their names. Equal texts give equal media. Repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import chunks

#: Blocks in a row of a stored image, and rows of one at most (a JPEG's height is below 65,536 samples).
WIDE, TALLEST = 24, 8184
UNIT = WIDE * WIDE
#: Bytes of payload, or of scans, that numpy holds at once, about.
AT_ONCE = 1 << 20
#: Huffman codes of a stored image: codes of each length 1 to 16, then the symbols in order of their codes.
DC_COUNTS, DC_SYMBOLS = (0, 2, 2, 1, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (5, 6, 4, 7, 3, 2, 0, 1, 8)
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)
MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def huffman_codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Symbol: its code and the code's length, by the canonical rule."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts, symbols) -> np.ndarray:
    """For the next 16 bits: code length + 32 * symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in huffman_codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length + 32 * symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """All that comes before the samples of a stored image of so many rows of blocks."""
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([8] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDE * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))
        + _segment(0xDD, struct.pack(">H", WIDE)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference + 255: the bits (size code, value, end of block) and how many."""
    dc, ac = huffman_codes(DC_COUNTS, DC_SYMBOLS), huffman_codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = dc[n]
        value = d if d >= 0 else d + (1 << n) - 1
        bits[d + 255] = ((code << n | value) << ac[1]) | ac[0]
        sizes[d + 255] = length + n + ac[1]
    return bits, sizes


BITS, SIZES = _difference_codes()


def pad(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % UNIT or (0 if text else UNIT))


def encode(payloads: list[bytes]) -> list[bytes]:
    """JPEG files of padded payloads, at most AT_ONCE bytes in numpy at a time: a longer payload is encoded image by image."""
    out: list[bytes] = []
    batch: list[bytes] = []
    for p in payloads:
        if batch and sum(map(len, batch)) + len(p) > AT_ONCE:
            out += _encode(batch)
            batch = []
        if len(p) > AT_ONCE:
            step = WIDE * TALLEST
            out.append(b"".join(_encode([p[k : k + step]])[0] for k in range(0, len(p), step)))
        else:
            batch.append(p)
    return out + _encode(batch)


def _encode(payloads: list[bytes]) -> list[bytes]:
    if not payloads:
        return []
    frames: list[tuple[int, int, int]] = []  # payload, first row, rows
    at = 0
    for k, p in enumerate(payloads):
        rows = len(p) // WIDE
        for first in range(0, rows, TALLEST):
            n = min(TALLEST, rows - first)
            frames.append((k, at, n))
            at += n
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDE).astype(np.int16)
    diffs = np.empty_like(samples)
    diffs[:, 0] = samples[:, 0] - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=diffs[:, 1:])
    diffs += 255
    bits = np.empty((len(samples), WIDE + 1), np.uint64)
    sizes = np.empty((len(samples), WIDE + 1), np.int64)
    bits[:, :WIDE], sizes[:, :WIDE] = BITS[diffs], SIZES[diffs]
    used = sizes[:, :WIDE].sum(axis=1)
    fill = -used % 8
    bits[:, WIDE], sizes[:, WIDE] = (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1), fill
    row_bytes = (used + fill) // 8
    sizes = sizes.ravel()
    ends = np.cumsum(sizes)
    begin = ends - sizes
    word = begin >> 5
    shifted = bits.ravel() << (64 - (begin & 31) - sizes).clip(0, 63).astype(np.uint64)
    if not sizes[-1]:
        shifted[-1] = 0
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[starts]] = np.add.reduceat(shifted >> np.uint64(32), starts)
    words[word[starts] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), starts)
    stream = words.astype(">u4").view(np.uint8)[: int(row_bytes.sum())]
    # a zero byte follows each 255; a restart marker follows each row
    row_end = np.cumsum(row_bytes)
    stuffed = (stream == 255).astype(np.int64)
    shift = np.cumsum(stuffed) - stuffed
    spot = np.arange(len(stream)) + shift + 2 * np.repeat(np.arange(len(samples)), row_bytes)
    total = len(stream) + int(stuffed.sum()) + 2 * len(samples)
    out = np.zeros(total, np.uint8)
    out[spot] = stream
    mark = spot[row_end - 1] + 1 + stuffed[row_end - 1]
    out[mark] = 255
    counts = np.concatenate([np.arange(n) for _, _, n in frames])
    out[mark + 1] = 0xD0 + counts % 8
    data = out.tobytes()
    files: list[list[bytes]] = [[] for _ in payloads]
    for k, first, n in frames:
        begin_at = int(mark[first - 1]) + 2 if first else 0
        files[k] += [header(n), data[begin_at : int(mark[first + n - 1])], b"\xff\xd9"]
    return [b"".join(f) for f in files]


class Frame:
    """One parsed image: its tables, components and entropy-coded bytes."""

    def __init__(self):
        self.tables: dict[int, tuple] = {}
        self.quant: dict[int, int] = {}
        self.interval = self.every = 0
        self.components: list[tuple[int, int, int, int]] = []  # id, across, down, quantizer
        self.scan: list[tuple[int, tuple, tuple]] = []  # component, DC and AC table of the scan that holds the first component
        self.data = b""


def parse(media: bytes) -> list[Frame]:
    """The baseline images in a file, one after the other. Raises ValueError for anything else."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, frame = at + 2, Frame()
        while True:
            if at >= len(media) - 1 and frame.scan:  # a file whose end marker is cut off
                at = len(media)
                break
            if at + 2 > len(media) or media[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = media[at + 1]
            at += 2
            if marker == 0xFF:
                at -= 1
                continue
            if marker == 0xD9:
                break
            if at + 2 > len(media):
                raise ValueError("a segment is cut off")
            size = struct.unpack_from(">H", media, at)[0]
            body = media[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide, which = body[k] >> 4, body[k] & 15
                    frame.quant[which] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    frame.tables[body[k]] = (tuple(body[k + 1 : k + 17]), tuple(body[k + 17 : k + 17 + n]))
                    k += 17 + n
            elif marker in (0xC0, 0xC1):
                bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not frame.height or not frame.width:
                    raise ValueError("not 8-bit samples of a known size")
                frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                frame.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if not frame.components or not body[0]:
                    raise ValueError("a scan of nothing")
                number = {c[0]: k for k, c in enumerate(frame.components)}
                scan = [(number[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
                end = MARKER.search(media, at)
                upto = end.start() if end else len(media)
                if not frame.scan and any(k == 0 for k, _ in scan):
                    # only the first component's samples are looked at; tables may be defined anew after its scan
                    frame.scan = [(k, frame.tables[t >> 4], frame.tables[16 + (t & 15)]) for k, t in scan]
                    frame.data, frame.every = media[at:upto], frame.interval
                at = upto
        if not frame.scan:
            raise ValueError("no scan")
        out.append(frame)
    if not out:
        raise ValueError("empty")
    return out


def _layout(frame: Frame) -> tuple:
    """What frames that are decoded together share: for each block of an MCU its component and tables."""
    blocks = []
    for k, dc, ac in frame.scan:
        _, across, down, _ = frame.components[k]
        blocks += [(k, dc, ac)] * (1 if len(frame.scan) == 1 else across * down)
    return tuple(blocks)


def _size(frame: Frame) -> tuple[int, int]:
    """The first component's samples across and down."""
    _, h, v, _ = frame.components[0]
    return -(-frame.width * h // max(c[1] for c in frame.components)), -(-frame.height * v // max(c[2] for c in frame.components))


def _mcus(frame: Frame) -> tuple[int, int]:
    """MCUs across and down: single blocks where the scan has one component only."""
    if len(frame.scan) == 1:
        wide, tall = _size(frame)
        return -(-wide // 8), -(-tall // 8)
    most = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    return -(-frame.width // (8 * most[0])), -(-frame.height // (8 * most[1]))


def _decode_group(frames: list[Frame], layout: tuple) -> list[np.ndarray]:
    """Quantized DC coefficients of the first component, in order of coding, of frames with one layout."""
    raw = np.frombuffer(b"".join(f.data + b"\xff\xd0" for f in frames), np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    keep[restart] = keep[restart + 1] = False
    new_at = np.cumsum(keep) - keep
    lane_end = new_at[restart]
    lane_start = np.concatenate([[0], lane_end[:-1]])
    clean = raw[keep]
    frame_end = np.cumsum([len(f.data) + 2 for f in frames])
    lanes_of = np.searchsorted(restart, frame_end, "left")
    counts: list[np.ndarray] = []
    before = 0
    for f, upto in zip(frames, lanes_of.tolist()):
        across, down = _mcus(f)
        total, n = across * down, upto - before
        each = f.every or total
        if n != -(-total // each):
            raise ValueError("restart markers are missing")
        c = np.full(n, each, np.int64)
        c[-1] = total - each * (n - 1)
        counts.append(c)
        before = upto
    mcus = np.concatenate(counts)
    order = np.argsort(-mcus, kind="stable")
    sorted_mcus = mcus[order]
    wide = np.zeros(len(clean) + 8, np.uint64)
    wide[: len(clean)] = clean
    window = wide[:-4].copy()  # the 40 bits from each byte on
    for k in range(1, 5):
        window = (window << np.uint64(8)) | wide[k : len(wide) - 4 + k]
    window = window.view(np.int64)
    tables = {t: lookup(*t) for _, dc, ac in layout for t in (dc, ac)}
    first = [k for k, (c, _, _) in enumerate(layout) if c == 0]
    out = np.zeros((len(mcus), int(sorted_mcus[0]) * len(first)), np.int16)
    place = lane_start[order] * 8
    last = lane_end[order] * 8
    pred = np.zeros((max(c for c, _, _ in layout) + 1, len(mcus)), np.int64)
    for m in range(int(sorted_mcus[0])):
        live = int(np.searchsorted(-sorted_mcus, -m, side="left"))
        for k, (component, dc, ac) in enumerate(layout):
            p = place[:live]
            w, s = window[p >> 3], p & 7
            entry = tables[dc][(w >> (24 - s)) & 0xFFFF]
            length, size = entry & 31, entry >> 5
            value = (w >> (40 - s - length - size)) & ((1 << size) - 1)
            value -= np.where((value << 1) < (1 << size), (1 << size) - 1, 0)
            if (length == 0).any():
                raise ValueError("no such code")
            pred[component, :live] += value
            if component == 0:
                out[:live, m * len(first) + first.index(k)] = pred[0, :live]
            p += length + size
            lanes, at = None, np.ones(live, np.int64)
            q = p
            while True:
                w, s = window[q >> 3], q & 7
                entry = tables[ac][(w >> (24 - s)) & 0xFFFF]
                length, symbol = entry & 31, entry >> 5
                size = symbol & 15
                step = length + size
                if (length == 0).any():
                    raise ValueError("no such code")
                q = q + step
                at = at + (symbol >> 4) + 1
                done = (symbol == 0) | (at > 63)
                if lanes is None:
                    place[:live] = q
                else:
                    place[lanes] = q
                if done.all():
                    break
                lanes = np.flatnonzero(~done) if lanes is None else lanes[~done]
                q, at = q[~done], at[~done]
            if (place[:live] > last[:live]).any():
                raise ValueError("a scan is cut off")
    back = np.empty_like(out)
    back[order] = out
    found, before = [], 0
    for c in counts:
        part = back[before : before + len(c)]
        found.append(part.ravel()[: int(c.sum()) * len(first)] if (c == c[0]).all() else np.concatenate([part[i, : int(n) * len(first)] for i, n in enumerate(c)]))
        before += len(c)
    return found


def _thumbnail(frame: Frame, dc: np.ndarray) -> np.ndarray:
    """The luminance samples, one for each 8x8 block."""
    across, down = _mcus(frame)
    _, h, v, q = frame.components[0]
    if len(frame.scan) == 1:
        h = v = 1
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    wide, tall = _size(frame)
    samples = grid[: -(-tall // 8), : -(-wide // 8)].astype(np.int32) * frame.quant[q] / 8 + 128
    return np.clip(np.rint(samples), 0, 255).astype(np.uint8)


class Image(NamedTuple):
    """An image's dimensions and its thumbnail."""

    width: int
    height: int
    thumbnail: np.ndarray


def _portions(members: list[int], frames: list) -> Iterator[list[int]]:
    """Members whose scans have AT_ONCE bytes together, about."""
    part, size = [], 0
    for i in members:
        if part and size + len(frames[i][1].data) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(frames[i][1].data)
    yield part


def thumbnails(files: list[bytes | None]) -> list[list[Image] | None]:
    """For each file its images; None where it isn't baseline JPEG."""
    frames: list[tuple[int, Frame]] = []
    out: list[list | None] = []
    groups: dict[tuple, list[int]] = {}
    for k, media in enumerate(files):
        try:
            own = parse(media or b"")
            layouts = [_layout(f) for f in own]
            out.append([])
        except (ValueError, IndexError, KeyError, struct.error):
            out.append(None)
            continue
        for f, layout in zip(own, layouts):
            groups.setdefault(layout, []).append(len(frames))
            frames.append((k, f))
    found: dict[int, np.ndarray] = {}
    for layout, members in ((x, part) for x, every in groups.items() for part in _portions(every, frames)):
        try:
            found |= zip(members, _decode_group([frames[i][1] for i in members], layout))
        except (ValueError, IndexError):
            for i in members:  # one of them is broken: each alone
                try:
                    found[i] = _decode_group([frames[i][1]], layout)[0]
                except (ValueError, IndexError):
                    out[frames[i][0]] = None
    for i, (k, f) in enumerate(frames):
        if out[k] is not None:
            out[k].append(Image(f.width, f.height, _thumbnail(f, found[i])))
    return out


def average_hash(image: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid are lighter than the mean of all."""
    def edges(n: int) -> np.ndarray:
        return (np.arange(8) * n) // 8

    rows = np.add.reduceat(image.astype(np.int64), edges(image.shape[0]), axis=0) if image.shape[0] >= 8 else image[edges(image.shape[0])].astype(np.int64)
    cells = np.add.reduceat(rows, edges(image.shape[1]), axis=1) if image.shape[1] >= 8 else rows[:, edges(image.shape[1])]
    return np.packbits(cells * cells.size > cells.sum()).tobytes().hex()


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the text's media column."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", 1 << 20):
            media = encode([pad(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.large_binary())], schema=schema)

    return docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Reads a media column: the kept columns, width, height, images, thumbnail (its bytes), sizes, digests and the feature."""
    rows = media.select(*keep, F.col(media_col).alias("media"))
    added = "width int, height int, images int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    fields = [rows.schema[c] for c in keep]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in chunks(batches, "media", 3 << 19):
            nulls = batch.column(len(keep)).is_null().to_pylist()
            out: dict[str, list] = {k: [] for k in ("width", "height", "images", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for file, null, images in zip(files, nulls, thumbnails(files)):
                if images is None:
                    row = (None,) * 6 + (None if null else len(file), None if null else hashlib.sha256(file).hexdigest(), None)
                else:
                    payload = b"".join(i.thumbnail.tobytes() for i in images)
                    sizes = "+".join(f"{i.width}x{i.height}:{average_hash(i.thumbnail)}" for i in images)
                    row = (images[0].width, sum(i.height for i in images), len(images), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), sizes)
                for k, value in zip(out, row):
                    out[k].append(value)
            types = dict(width=pa.int32(), height=pa.int32(), images=pa.int32(), payload_bytes=pa.int64(), tail_crc32=pa.int64(), media_bytes=pa.int64())
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(v, types.get(k, pa.string())) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *out])

    from pyspark.sql.types import StructType

    return rows.mapInArrow(read, StructType([*fields, *StructType.fromDDL(added).fields]))


def op2_jpeg_media(spark, sf_dir):
    """All documents stored as JPEG and read back."""
    return describe_media(store_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "images")


QUERIES = {"op2_jpeg_media": op2_jpeg_media}
SQL: dict[str, str] = {}
