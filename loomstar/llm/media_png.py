"""Media columns: PNG files in binary columns, written and read chunk by chunk, with low-frequency cosine hashes.

encode_png() makes the chunks with zlib and their CRCs, decode_png() tests every CRC and the order of chunks, inflates no
more than the header announces (and nothing if that is more than LARGEST or than the data can hold), and undoes the five row filters with numpy: the average and Paeth filters along
diagonals, on which no sample needs another. Samples of 1 to 16 bits, palettes and interlaced pictures are read. A hash is the sign pattern of the lowest 8 x 8 frequencies (but the mean) of the grey picture
shrunk to 32 x 32.

Edge cases: a null or empty text is a payload of 192 spaces; a broken file raises ValueError in decode_png() and gives
a null row of features with the reason in read_images(); equal payloads give equal files and hashes; repeated rows
stay; an empty table gives an empty result. Further columns are ignored, or kept by name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstar.llm import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type (3 is a palette's index), and the bits that each may have.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: The seven passes of an interlaced picture: first column and row, steps between columns and rows.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Bytes of samples that a file may announce, and those that a byte of deflated data can give at most.
LARGEST, MOST_INFLATED = 1 << 28, 1032
WIDTH, LEVEL, SIDE, LOW = 64, 4, 32, 8
#: Files that are in memory at once, but for those of Arrow's own batches.
CHUNK = 64
ROW = WIDTH * 3
_k = np.arange(LOW)[:, None]
COSINE = np.cos(np.pi * _k * (2 * np.arange(SIDE)[None] + 1) / (2 * SIDE)) * np.where(_k, np.sqrt(2 / SIDE), np.sqrt(1 / SIDE))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray, step: int) -> np.ndarray:
    """Each row with the filter none, sub or up, whichever has the least sum of signed sizes, after its type byte."""
    left = np.zeros_like(rows)
    left[:, step:] = rows[:, :-step]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    tried = np.stack([rows, rows - left, rows - above])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2)
    best = cost.argmin(0)
    return np.hstack([best[:, None].astype(np.uint8), tried[best, np.arange(len(rows))]])


def encode_png(pixels: np.ndarray) -> bytes:
    """pixels: height x width x samples (1 to 4) of uint8."""
    height, width, n = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    body = zlib.compress(filtered(pixels.reshape(height, width * n), n).tobytes(), LEVEL)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def unfiltered(data: np.ndarray, step: int) -> np.ndarray:
    """data: rows of a type byte and the filtered bytes. Runs of rows with one of the types none, sub and up go together, or with the others."""
    kinds, rows = data[:, 0], data[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    cuts = [0, *(np.flatnonzero(np.diff(np.minimum(kinds, 3))) + 1).tolist(), len(kinds)]
    zero = np.zeros(rows.shape[1], np.uint8)
    for a, b in zip(cuts, cuts[1:], strict=False):
        kind, above = kinds[a], rows[a - 1] if a else zero
        if kind == 1:
            block = rows[a:b].reshape(b - a, -1, step)
            np.cumsum(block, axis=1, dtype=np.uint8, out=block)
        elif kind == 2:
            rows[a] += above
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=rows[a:b])
        elif kind > 2:
            waved(rows, kinds, a, b, step)
    return rows


def waved(rows: np.ndarray, kinds: np.ndarray, a: int, b: int, step: int) -> None:
    """Undoes the filters average (3) and Paeth (4) of the rows from a to b, all pixels of a diagonal at once."""
    height, width = b - a, rows.shape[1] // step
    done = np.zeros((height + 1, width + 1, step), np.int16)  # with a border above and on the left
    if a:
        done[0, 1:] = rows[a - 1].reshape(width, step)
    raw, paeth = rows[a:b].reshape(height, width, step), (kinds[a:b] == 4)[:, None]
    for d in range(width + height - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - r
        left, up, corner = done[r + 1, x], done[r, x + 1], done[r, x]
        da, db, dc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        done[r + 1, x + 1] = (raw[r, x] + np.where(paeth[r], nearest, (left + up) >> 1)) & 255
    rows[a:b] = done[1:, 1:].reshape(height, -1)


def chunks_of(data: bytes) -> tuple[tuple, bytes | None, bytes]:
    """The header's fields, the palette if there is one, and the compressed samples. Raises ValueError as decode_png() does."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, palette, body, ended, last = 8, None, None, [], False, b""
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or at + 12 + n > len(data):
            raise ValueError("cut chunk")
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"checksum of {kind!r}")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("the header isn't the first chunk alone")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("length of the header")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            if body and last != b"IDAT":
                raise ValueError("data chunks apart")
            body.append(part)
        elif kind == b"PLTE":
            if palette is not None or body or n % 3 or not 0 < n <= 768:
                raise ValueError("palette out of place or of a wrong length")
            palette = part
        elif kind != b"IEND" and not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        last, ended, at = kind, kind == b"IEND", at + 12 + n
    if head is None or not ended:
        raise ValueError("no header or no end")
    return head, palette, b"".join(body)


def unpacked(rows: np.ndarray, width: int, n: int, bits: int) -> np.ndarray:
    """Rows of bytes as height x width x n samples of 1 to 16 bits."""
    if bits == 16:
        return rows.copy().view(">u2").reshape(len(rows), width, n).astype(np.uint16)
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)[:, : width * n]
        rows = np.packbits(each, axis=2)[:, :, 0] >> (8 - bits)
    return rows.reshape(len(rows), width, n)


def decode_png(data: bytes, largest: int = LARGEST) -> np.ndarray:
    """Height x width x samples, of 16 bits as uint16, else as uint8; a palette's indices as the colours that they stand for.

    Raises ValueError where a signature, length, checksum, order, method or size is wrong, and before anything is inflated
    where the header announces more bytes than largest or than its data can hold.
    """
    (width, height, bits, colour, packed, filters, interlaced), palette, body = chunks_of(data)
    if bits not in DEPTHS.get(colour, ()) or interlaced > 1 or packed or filters:
        raise ValueError("unknown samples or methods")
    if (colour == 3) != (palette is not None) and colour in (0, 3, 4):
        raise ValueError("palette missing or not allowed")
    n = SAMPLES[colour]
    parts = [(x, y, dx, dy) for x, y, dx, dy in (PASSES if interlaced else [(0, 0, 1, 1)]) if x < width and y < height]
    shapes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for x, y, dx, dy in parts]
    size = sum(h * (1 + (w * n * bits + 7) // 8) for h, w in shapes)
    if not width or not height or size > min(largest, MOST_INFLATED * len(body) + 64):
        raise ValueError("wrong size")
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(body, size + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(raw) != size or not inflate.eof:
        raise ValueError("wrong size")
    pixels, at = np.zeros((height, width, n), np.uint16 if bits == 16 else np.uint8), 0
    for (x, y, dx, dy), (h, w) in zip(parts, shapes, strict=True):
        line = 1 + (w * n * bits + 7) // 8
        rows = unfiltered(np.frombuffer(raw, np.uint8, h * line, at).reshape(h, line), max(1, n * bits // 8))
        pixels[y::dy, x::dx] = unpacked(rows, w, n, bits)
        at += h * line
    if colour == 3:
        colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if pixels.max() >= len(colours):
            raise ValueError("colour beyond the palette")
        pixels = colours[pixels[:, :, 0]]
    return pixels


def shrunk(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means of side x side areas; smaller pictures repeat their samples."""
    for axis in (0, 1):
        n = grey.shape[axis]
        edges = np.arange(side + 1) * n // side
        starts = np.minimum(edges[:-1], n - 1)
        width = np.maximum(np.diff(edges), 1)
        total = np.concatenate([np.zeros_like(np.take(grey, [0], axis)), np.cumsum(grey, axis)], axis)
        part = np.take(total, starts + width, axis) - np.take(total, starts, axis)
        grey = part / (width[:, None] if axis == 0 else width[None])
    return grey


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: which of the lowest 8 x 8 frequencies lie over their median; the mean's bit is 0."""
    low = (COSINE @ shrunk(pixels.astype(np.float64).mean(2)) @ COSINE.T).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" "), len(raw)


def write_images(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_bytes of the text, and media: the padded text as the RGB samples of a PNG 64 wide."""
    own = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, CHUNK):
            made = [payload(t) for t in b.column("_text").to_pylist()]
            media = [encode_png(np.frombuffer(p, np.uint8).reshape(-1, WIDTH, 3)) for p, _ in made]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in keep)
    return own.mapInArrow(run, f"{kinds}, n_bytes long, media binary")


def read_images(images: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep; of the samples read back: their number, SHA-256, CRC-32 of the last 16; of the file: size, SHA-256; the hash; error (null if sound)."""
    own = images.select(*[F.col(c) for c in keep], F.col("media").alias("_media"))
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def features(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6 + ("null",)
        own = (len(media), hashlib.sha256(media).hexdigest())
        try:
            pixels = decode_png(media)
        except ValueError as e:
            return (None, None, None, *own, None, str(e))
        raw = pixels.tobytes()
        return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), *own, cosine_hash(pixels), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, CHUNK):
            columns = list(zip(*map(features, b.column("_media").to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*keep, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in keep)
    return own.mapInArrow(run, f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
