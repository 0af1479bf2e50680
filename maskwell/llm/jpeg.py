"""Media columns: baseline JPEG with DC-only luminance thumbnails.

A payload is stored as the DC coefficients of a grey image, one byte for each
8x8 block: at quantiser 8 a DC step is one grey level, so the image of block
means (the thumbnail) is the payload, without loss. The Huffman tables of the
files written here give every block 16 bits; the reader is a general baseline
decoder that knows nothing of this but decodes equally long blocks at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm._shared import free_name

ROW = 192
MOST_ROWS = 65_535 // 8
SIZE = 12  # bits of a DC category's code and its extra bits
END_OF_BLOCK = 4  # bits


class JpegError(ValueError):
    """Not a baseline JPEG, or a damaged one."""


@dataclass
class Huffman:
    """Symbol and code length for each 16-bit window; length 0: no code."""

    symbol: np.ndarray
    length: np.ndarray


@lru_cache(64)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = at = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            lo, hi = code << (16 - bits), (code + 1) << (16 - bits)
            if hi > 1 << 16 or at >= len(symbols):
                raise JpegError("Huffman table overflows")
            symbol[lo:hi], length[lo:hi] = symbols[at], bits
            code, at = code + 1, at + 1
        code <<= 1
    return Huffman(symbol, length)


@lru_cache(64)
def _flat_blocks(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """DC difference and bits of a block without AC terms, for each 16-bit
    window; bits 0 where the block has AC terms or more than 16 bits."""
    dc_table, ac_table = huffman(*dc), huffman(*ac)
    window = np.arange(1 << 16, dtype=np.int64)
    size, used = dc_table.symbol.astype(np.int64), dc_table.length.astype(np.int64)
    ok = (used > 0) & (used + size < 16)
    size, used = np.where(ok, size, 0), np.where(ok, used, 0)
    extra = (window >> (16 - used - size)) & ((1 << size) - 1)
    diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
    rest = (window << (used + size)) & 0xFFFF
    used = used + size + ac_table.length[rest]
    ok &= (ac_table.symbol[rest] == 0) & (ac_table.length[rest] > 0) & (used <= 16)
    return diff.astype(np.int32), np.where(ok, used, 0).astype(np.uint8)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quantiser: int
    dc: tuple[bytes, bytes] | None = None
    ac: tuple[bytes, bytes] | None = None


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, int]
    restart: int = 0
    thumbnail: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.uint8))


def _uniform(data: bytes, frame: Frame, part: Component) -> np.ndarray | None:
    """DC differences of a one-component scan whose blocks are all flat and
    equally long; None where that isn't so."""
    blocks = -(-frame.width // 8) * -(-frame.height // 8)
    bits = len(data) * 8 // blocks
    if not 1 <= bits <= 16 or len(data) * 8 - bits * blocks >= 8:
        return None
    diff, used = _flat_blocks(part.dc, part.ac)
    if bits == 16:
        windows = np.frombuffer(data, ">u2", blocks)
    else:
        raw = np.frombuffer(data + b"\xff\xff\xff", np.uint8)
        at = np.arange(blocks, dtype=np.int64) * bits
        byte = at >> 3
        word = (raw[byte].astype(np.int64) << 16) | (raw[byte + 1].astype(np.int64) << 8) | raw[byte + 2]
        windows = (word >> (8 - (at & 7))) & 0xFFFF
    if not (used[windows] == bits).all():
        return None
    return diff[windows]


def _sequential(data: bytes, frame: Frame, parts: list[Component]) -> np.ndarray:
    """DC values of the first component's blocks, block by block."""
    luma = parts[0]
    single = len(parts) == 1
    h_most, v_most = max(c.h for c in frame.components), max(c.v for c in frame.components)
    wide, high = -(-frame.width // (8 * h_most)), -(-frame.height // (8 * v_most))
    if single:
        columns = -(-(-(-frame.width * luma.h // h_most)) // 8)
        rows = -(-(-(-frame.height * luma.v // v_most)) // 8)
        wide, high = columns, rows
    else:
        columns, rows = wide * luma.h, high * luma.v
    out = np.zeros((rows, columns), np.int64)
    mcu, total = 0, wide * high
    for piece in _intervals(data):
        bits, at = len(piece) * 8, 0
        padded = piece + b"\xff\xff\xff\xff"
        last = [0] * len(parts)

        def peek(p: int) -> int:
            b = p >> 3
            return (((padded[b] << 16) | (padded[b + 1] << 8) | padded[b + 2]) >> (8 - (p & 7))) & 0xFFFF

        todo = min(frame.restart or total, total - mcu)
        for _ in range(todo):
            y, x = divmod(mcu, wide)
            for i, c in enumerate(parts):
                dc, ac = huffman(*c.dc), huffman(*c.ac)
                for v in range(1 if single else c.v):
                    for h in range(1 if single else c.h):
                        if at >= bits:
                            raise JpegError("the scan ends early")
                        w = peek(at)
                        n, size = int(dc.length[w]), int(dc.symbol[w])
                        if not n or size > 11:
                            raise JpegError("no such DC code")
                        at += n
                        if size:
                            extra = peek(at) >> (16 - size) if at + size <= bits + 8 else 0
                            at += size
                            last[i] += extra if extra >> (size - 1) else extra - (1 << size) + 1
                        k = 1
                        while k < 64:
                            if at >= bits:
                                raise JpegError("the scan ends early")
                            w = peek(at)
                            n, symbol = int(ac.length[w]), int(ac.symbol[w])
                            if not n:
                                raise JpegError("no such AC code")
                            at += n + (symbol & 15)
                            if symbol == 0:
                                break
                            k += 16 if symbol == 0xF0 else (symbol >> 4) + 1
                        if i == 0:
                            out[(y if single else y * c.v + v), (x if single else x * c.h + h)] = last[0]
            mcu += 1
    if mcu < total:
        raise JpegError("blocks are missing")
    return out


def _intervals(data: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers, stuffing removed."""
    out, at, start = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    out.append(data[start:])
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _scan_end(data: bytes, at: int) -> int:
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise JpegError("no end of image")
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def decode(data: bytes) -> list[Frame]:
    """All baseline images that follow each other in ``data``, with luminance
    thumbnails of one sample for each 8x8 block."""
    frames: list[Frame] = []
    at, n, frame = 0, len(data), None
    quantisers: dict[int, int] = {}
    tables: dict[int, tuple[bytes, bytes]] = {}
    restart = 0
    if n < 4:
        raise JpegError("too short")
    while at < n:
        if data[at] != 0xFF or at + 1 >= n:
            raise JpegError(f"no marker at byte {at}")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        at += 2
        if kind == 0xD8:
            quantisers, tables, restart, frame = {}, {}, 0, None
            continue
        if kind == 0xD9:
            if frame is None or not frame.thumbnail.size:
                raise JpegError("an image without a scan")
            frames.append(frame)
            continue
        if at + 2 > n or (length := int.from_bytes(data[at : at + 2], "big")) < 2 or at + length > n:
            raise JpegError("a segment is cut off")
        body = data[at + 2 : at + length]
        at += length
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quantisers[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                i += 65 + 64 * wide
        elif kind == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                symbols = body[i + 17 : i + 17 + sum(counts)]
                tables[body[i]] = (counts, symbols)
                i += 17 + sum(counts)
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xC0:
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise JpegError("not 8 bits a sample")
            parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            frame = Frame(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts, quantisers)
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise JpegError("only baseline images are supported")
        elif kind == 0xDA:
            if frame is None or not frame.width or not frame.height:
                raise JpegError("a scan without a frame")
            known = {c.ident: c for c in frame.components}
            chosen = []
            for i in range(1, 1 + 2 * body[0], 2):
                c = known[body[i]]
                try:
                    c.dc, c.ac = tables[body[i + 1] >> 4], tables[0x10 | body[i + 1] & 15]
                except KeyError as e:
                    raise JpegError("a Huffman table is missing") from e
                chosen.append(c)
            end = _scan_end(data, at)
            if chosen[0] is frame.components[0]:
                frame.restart = restart
                coded, flat = data[at:end], None
                if len(chosen) == 1 and not restart and len(frame.components) == 1:
                    flat = _uniform(coded.replace(b"\xff\x00", b"\xff"), frame, chosen[0])
                columns = -(-frame.width // 8)
                levels = np.cumsum(flat).reshape(-1, columns) if flat is not None else _sequential(coded, frame, chosen)
                step = quantisers[chosen[0].quantiser]
                means = (levels * step + 4 >> 3) + 128 if step != 8 else levels + 128
                frame.thumbnail = np.clip(means, 0, 255).astype(np.uint8)
            at = end
    if not frames:
        raise JpegError("no image")
    return frames


def _canonical() -> tuple[bytes, bytes, np.ndarray]:
    """The writer's DC table (one code of SIZE - c bits for category c) and the
    16 bits of a block for each DC difference from -255 to 255."""
    counts, symbols, codes, code = bytearray(16), bytearray(), {}, 0
    for bits in range(SIZE - 8, SIZE + 1):
        counts[bits - 1] = 1
        symbols.append(SIZE - bits)
        codes[SIZE - bits] = code
        code = (code + 1) << 1
    blocks = np.zeros(511, np.uint16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        blocks[diff + 255] = ((codes[size] << size) | extra) << END_OF_BLOCK
    return bytes(counts), bytes(symbols), blocks.astype(">u2")


_COUNTS, _SYMBOLS, _BLOCKS = _canonical()


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    _segment(0xDB, b"\0" + bytes([8] * 64))
    + _segment(0xC4, b"\0" + _COUNTS + _SYMBOLS)
    + _segment(0xC4, b"\x10" + bytes([0] * (END_OF_BLOCK - 1) + [1] + [0] * (16 - END_OF_BLOCK)) + b"\0")
)


def encode(payload: bytes, row: int = ROW) -> bytes:
    """Baseline JPEG files, one after the other, whose thumbnails' samples are
    ``payload``; its length is a positive multiple of ``row``. One file holds
    up to 8191 rows."""
    if not payload or len(payload) % row:
        raise ValueError(f"the payload must fill rows of {row} bytes")
    out, most = [], row * MOST_ROWS
    for i in range(0, len(payload), most):
        samples = np.frombuffer(payload[i : i + most], np.uint8).astype(np.int16)
        diff = np.empty_like(samples)
        diff[0], diff[1:] = samples[0] - 128, samples[1:] - samples[:-1]
        frame = b"\x08" + (len(samples) // row * 8).to_bytes(2, "big") + (row * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"
        # no byte of a block's code is 0xFF: the first begins, the second ends with zero bits
        out += [b"\xff\xd8", _TABLES, _segment(0xC0, frame), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"), _BLOCKS[diff + 255].tobytes(), b"\xff\xd9"]
    return b"".join(out)


def average_hash(thumbnail: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 reduction are lighter than their mean."""
    rows, columns = thumbnail.shape
    y, x = np.arange(8) * rows // 8, np.arange(8) * columns // 8
    if rows >= 8 and columns >= 8:
        cells = np.add.reduceat(np.add.reduceat(thumbnail, y, axis=0, dtype=np.int64), x, axis=1)
        cells = cells / (np.diff(np.append(y, rows))[:, None] * np.diff(np.append(x, columns)))
    else:
        cells = thumbnail[np.ix_(y, x)].astype(float)
    return int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), "big")


def feature(frames: list[Frame]) -> str:
    return "+".join(f"{f.width}x{f.height}:{average_hash(f.thumbnail):016x}" for f in frames)


def pad(raw: bytes, row: int = ROW) -> bytes:
    return raw + b" " * (-len(raw) % row if raw else row)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_and_describe(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``(doc_id, text): what is read back from its stored form.

    Text as UTF-8 (null: empty), padded with spaces to a positive multiple of
    192 bytes. A task holds one media value at a time; none is shuffled or sent
    on. Null ids, repeated rows: a row each. Empty table: no rows.
    """

    def describe(raw: bytes) -> tuple:
        media = encode(pad(raw))
        frames = decode(media)
        back = b"".join(f.thumbnail.tobytes() for f in frames)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            if batch.num_rows:
                rows = [describe(x.as_py() or b"") for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("raw")).mapInArrow(run, SCHEMA)


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with width, height and thumb_hash of a binary JPEG column (the first
    image's), and error; null or undecodable media has nulls and the reason."""
    names = [free_name(df, x) for x in ("width", "height", "thumb_hash", "error")]

    @F.pandas_udf("width int, height int, thumb_hash string, error string")
    def read(values):
        import pandas as pd

        def one(value):
            if value is None:
                return None, None, None, "no media"
            try:
                f = decode(bytes(value))[0]
                return f.width, f.height, f"{average_hash(f.thumbnail):016x}", None
            except (JpegError, KeyError, IndexError) as e:
                return None, None, None, str(e) or "damaged"

        rows = [one(v) for v in values]
        out = pd.DataFrame(rows, columns=["width", "height", "thumb_hash", "error"])
        return out.astype({"width": "Int32", "height": "Int32"})

    held = free_name(df, "read")
    out = df.withColumn(held, read(F.col(media)))
    return out.select(*df.columns, *[F.col(f"{held}.{x}").alias(y) for x, y in zip(("width", "height", "thumb_hash", "error"), names, strict=True)])
