"""Media columns: PNG pictures in binary columns, decoded with numpy, and low-frequency cosine-transform hashes.

Writer and reader speak 8-bit non-interlaced PNG. The writer gives every row the one of the five filters that leaves the
least sum of absolute differences, as the format's specification advises; for text a filter must cut the raw row's sum
to a quarter (``gain``), as text deflates to half the size unfiltered. The reader walks the chunks, tests every
checksum, inflates the IDAT data and undoes the filters: a pixel needs its left, upper and upper left neighbours, so
all pixels of one anti-diagonal, in all pictures of a batch that are equally wide, are restored at once.

Bytes are stored as an RGB picture 64 pixels wide: 192 bytes a row, the last row padded with bytes 32. Null text
counts as empty and makes one row. Equal texts give equal pictures and features. Extra columns are ignored,
repeated rows keep a row each, an empty table gives no rows. A broken picture raises ValueError. Batches are cut by bytes;
a longer text is a picture by itself, whose memory is a few times its size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
ROW = 192


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(raw: np.ndarray, first: np.ndarray, c: int, kind: int | None = None, gain: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(filter of each row, filtered rows) of the stacked rows of pictures with c channels; ``first`` marks where a picture
    begins. Each row gets the filter of the least sum of absolute differences (of equals the first), or the given one; a
    filter's sum counts ``gain`` times, the raw row's once."""
    here = raw.astype(np.int16)
    up = np.zeros_like(here)
    up[1:] = here[:-1]
    up[first] = 0
    left, corner = np.zeros_like(here), np.zeros_like(here)
    left[:, c:], corner[:, c:] = here[:, :-c], up[:, :-c]
    guesses = [np.zeros_like(here), left, up, (left + up) >> 1, _paeth(left, up, corner)]
    if kind is not None:
        return np.full(len(raw), kind, np.uint8), (here - guesses[kind]).astype(np.uint8)
    best, kinds, out = np.full(len(raw), np.iinfo(np.int64).max), np.zeros(len(raw), np.uint8), np.empty_like(raw)
    for k, guess in enumerate(guesses):
        rest = (here - guess).astype(np.uint8)
        cost = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) * (gain if k else 1)
        less = cost < best
        best[less], kinds[less], out[less] = cost[less], k, rest[less]
    return kinds, out


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour nearest to left + up - corner; of equally near ones the first in that order."""
    a, b = up - corner, left - corner
    c = np.abs(a + b)
    a, b = np.abs(a), np.abs(b)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def pack_png(kinds: np.ndarray, rows: np.ndarray, c: int, level: int = 6) -> bytes:
    """The PNG of filtered rows."""
    data = zlib.compress(np.concatenate([kinds[:, None], rows], axis=1).tobytes(), level)
    head = struct.pack(">IIBBBBB", rows.shape[1] // c, len(rows), 8, {1: 0, 3: 2, 2: 4, 4: 6}[c], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[i : i + (1 << 20)]) for i in range(0, len(data), 1 << 20)) + _chunk(b"IEND", b"")


def encode_png(pixels: np.ndarray, level: int = 6, filters: int | None = None) -> bytes:
    """PNG of (height, width, channels) uint8; ``filters`` forces one filter for all rows."""
    h, w, c = pixels.shape
    return pack_png(*filtered(np.ascontiguousarray(pixels).reshape(h, w * c), np.arange(h) == 0, c, filters), c, level)


def unpack_png(blob: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(filter of each row, filtered rows, channels) of an 8-bit non-interlaced PNG."""
    if blob[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, head, ended = 8, [], None, False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise ValueError("a chunk is cut short")
        (n,), kind = struct.unpack_from(">I", blob, at), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", blob, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"the checksum of chunk {kind!r} doesn't fit")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("only 8-bit non-interlaced grey and true-colour pictures are read")
    c = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if lines.size != h * (w * c + 1):
        raise ValueError("the picture's size doesn't fit its data")
    lines = lines.reshape(h, w * c + 1)
    return lines[:, 0], lines[:, 1:], c


def decode_png(blob: bytes) -> np.ndarray:
    """(height, width, channels) uint8 of an 8-bit non-interlaced PNG."""
    kinds, rows, c = unpack_png(blob)
    return unfilter(kinds, rows, c).reshape(len(rows), -1, c)


def unfilter(kinds: np.ndarray, rows: np.ndarray, c: int, heights: list[int] | None = None) -> np.ndarray:
    """Undo the row filters of pictures of one width whose rows are stacked (``heights`` rows each; one picture if not
    given), anti-diagonal by anti-diagonal over all of them."""
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown row filter")
    n, w = len(rows), rows.shape[1] // c
    size = np.asarray(heights if heights is not None else [n], np.int64)
    if not n:
        return rows.copy()
    # a row of zeros above each picture and a pixel of zeros left of each row
    own = np.repeat(np.arange(len(size)), size)
    y = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    place = np.arange(n) + own + 1
    grid = np.zeros((n + len(size), w + 1, c), np.int16)
    grid[place, 1:] = rows.reshape(n, w, c)
    grid = grid.reshape(-1, c)
    wide = w + 1
    # the start of each row's stretch, by where in the diagonals it begins
    order = np.argsort(y, kind="stable")
    start, kind, y = place[order] * wide + 1, kinds[order], y[order]
    begin, end = np.searchsorted(y, np.arange(int(size.max()) + 1)), len(y)
    for t in range(int(size.max()) + w - 1):
        lo, hi = begin[max(0, t - w + 1)], begin[t + 1] if t + 1 < len(begin) else end
        k = kind[lo:hi]
        at = start[lo:hi] + (t - y[lo:hi])
        some = k > 0
        if not some.all():
            at, k = at[some], k[some]
        left, up, corner = grid[at - 1], grid[at - wide], grid[at - wide - 1]
        k = k[:, None]
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, _paeth(left, up, corner))))
        grid[at] = (grid[at] + guess) & 255
    return grid.reshape(-1, wide, c)[place, 1:].astype(np.uint8).reshape(n, w * c)


@lru_cache(maxsize=8)
def _cosines(low: int, n: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(low)[:, None] * (2 * np.arange(n)[None] + 1) / (2 * n))


def _shrink(plane: np.ndarray, to: int) -> np.ndarray:
    """Means over ``to`` even strips of the first axis; short axes repeat their rows."""
    n = len(plane)
    if n < to:
        return plane[np.arange(to) * n // to]
    edges = np.arange(to + 1) * n // to
    return np.add.reduceat(plane, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(pixels: np.ndarray, side: int = 32, low: int = 8) -> str:
    """64 bits, hex: whether each of the ``low`` x ``low`` lowest frequencies of the grey picture, shrunk to ``side``
    x ``side``, exceeds the median of those without the constant term."""
    grey = pixels.mean(axis=2)
    small = _shrink(_shrink(grey, side).T, side).T
    waves = _cosines(low, side)
    flat = (waves @ small @ waves.T).ravel()
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


def store_bytes(df: DataFrame, key: str, column: str, row: int = ROW, gain: int = 4) -> DataFrame:
    """(key, n_bytes, media): each value of a text column as UTF-8, padded and stored as a PNG."""

    def store(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in common.parts(batch, 1, 500):
                data, offsets = common.utf8_column(part.column(1))
                size = np.diff(offsets)
                heights = np.maximum(1, -(-size // row))
                first = np.cumsum(heights) - heights
                raw = np.full((int(heights.sum()), row), 32, np.uint8)
                raw.reshape(-1)[np.arange(len(data)) + np.repeat(first * row - offsets[:-1], size)] = data
                begins = np.zeros(len(raw), bool)
                begins[first] = True
                kinds, rows = filtered(raw, begins, 3, gain=gain)
                media = [pack_png(kinds[lo : lo + n], rows[lo : lo + n], 3) for lo, n in zip(first.tolist(), heights.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    kind = dict(df.dtypes)[key]
    return df.select(key, column).mapInArrow(store, f"{key} {kind}, n_bytes long, media binary")


def read_features(media: DataFrame, key: str) -> DataFrame:
    """Decode each stored picture and describe it: sizes, digests and the cosine hash."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in common.parts(batch, 2, 500):
                blobs = [x.as_py() for x in part.column(2)]
                unpacked = [unpack_png(blob) for blob in blobs]
                out: list = [None] * len(blobs)
                for shape in {(rows.shape[1], c) for _, rows, c in unpacked}:
                    own = [i for i, (_, rows, c) in enumerate(unpacked) if (rows.shape[1], c) == shape]
                    heights = [len(unpacked[i][1]) for i in own]
                    flat = unfilter(np.concatenate([unpacked[i][0] for i in own]), np.concatenate([unpacked[i][1] for i in own]), shape[1], heights)
                    for i, lo, h in zip(own, np.cumsum(heights) - heights, heights, strict=True):
                        pixels, blob = flat[lo : lo + h], blobs[i]
                        payload = pixels.tobytes()
                        out[i] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), cosine_hash(pixels.reshape(h, -1, shape[1])))
                cols = list(zip(*out, strict=True)) if out else [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(media.dtypes)[key]
    return media.mapInArrow(read, f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    stored = common.materialize(store_bytes(docs, "doc_id", "text"), "media")
    return read_features(stored, "doc_id")
