"""Exact removal of byte strings of at least ``length`` bytes that start in two places, by Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any document. All strings are
judged on the input.

Which strings meet. A task packs documents into chunks, kept as files in the shared folder. Every window of ``length`` bytes
has a smallest hash among the 64-byte strings inside it; neighbouring windows with the same one form a run, and equal
windows, wherever they are, lie in runs of equal hash. A run's context is all bytes of its windows. Packed (hash, context
digest) pairs, once per chunk, meet by hash: contexts that occur twice repeat as a whole; of hashes with several
different contexts one copy of each is sent on; all the rest is settled without moving any text.

How repeats are found. The contexts of many hashes are joined, their rotations sorted by 224 symbols and the
Burrows-Wheeler transform taken. Beginning with the empty string's interval, intervals are extended backwards breadth
first; a string of k + 1 symbols whose interval ends where no common prefix is known yet sets it to k there.
This derives common prefixes by increasing value, and stops at ``length``: places without a value then share at
least that many symbols with their neighbour.

A hash with more than ``most`` different contexts is dealt over several transforms by context digest; the windows of
those contexts also meet as packed 128-bit fingerprints, one for each different window of a transform, so repeats between
the transforms are found too. Nothing is capped. Tasks hold a chunk, a bucket of packed pairs or a bounded batch of
contexts at a time; the number of buckets grows with the bytes of all texts. A long text is a chunk by itself.

Null text is empty. Texts shorter than ``length`` stay. A null doc_id is kept as null; repeated rows repeat each other, so
both lose what they share. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .neardup import mix

GRAM = 64
_B = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_B), -1, 1 << 64))
PACKED_DDL = "bucket int, chunk long, payload binary"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(smallest hash, context digest, first window, end of windows, whether the hash occurs again within the context,
    so that its own windows may repeat) of the runs of each document in a chunk."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    back = _powers(_BACK, n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_B, n), out=sums[1:])
    gram = low = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - length + 1], low[width - span : width - span + n - length + 1])
    size = np.diff(offsets)
    has = size >= length
    edge = np.zeros(n - length + 3, np.int32)
    np.add.at(edge, offsets[:-1][has], 1)
    np.add.at(edge, (offsets[1:] - length + 1)[has], -1)
    valid = np.cumsum(edge[: n - length + 1]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first[offsets[:-1][has]] = True
    lo = np.flatnonzero(first)
    doc = np.searchsorted(offsets, lo, side="right") - 1
    hi = np.minimum(np.r_[lo[1:], n], offsets[doc + 1] - length + 1)
    digest = mix((sums[hi + length - 1] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))
    # a place is where some window has its smallest hash if the largest of its windows' smallest ones is its own
    high, span = np.r_[np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)], 1
    while span * 2 <= width:
        high = np.maximum(high[:-span], high[span:])
        span *= 2
    high = np.maximum(high[: len(gram)], high[width - span : width - span + len(gram)])
    place = np.flatnonzero(high == gram)
    a, b = np.searchsorted(place, lo), np.searchsorted(place, hi + width - 1)
    own = np.repeat(np.arange(len(lo)), b - a)
    near = place[np.arange(len(own)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[own]]
    again = np.bincount(own[gram[near] == low[lo[own]]], minlength=len(lo)) > 1
    return low[lo], digest, lo, hi, again


def repeated(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For contexts data[start : start + size]: which of their windows (flat, context by context) start twice."""
    n = int((sizes + 1).sum())
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols, inner = np.zeros(n, np.int64), np.repeat(starts - begin, sizes + 1) + np.arange(n)
    last = begin + sizes
    keep = np.ones(n, bool)
    keep[last] = False
    symbols[keep] = data[inner[keep]].astype(np.int64) + 1
    # rotations sorted by at least ``length`` + 1 symbols, by doubling
    used, symbols = np.unique(symbols, return_inverse=True)
    each = max(1, 62 // max(1, int(len(used) - 1).bit_length()))
    key = np.zeros(n, np.int64)
    for j in range(each):
        key = key * len(used) + np.roll(symbols, -j)
    depth, ranks = each, 0
    while True:
        order = np.argsort(key)  # equal rotations may come in any order
        key = key[order]
        new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        ranks = int(new[-1]) + 1
        if depth > length or ranks == n:
            break
        key = rank * n + np.roll(rank, -depth)
        depth *= 2
    bwt = symbols[order - 1]
    # counts of each symbol before a place: a bit per place and symbol, and counts per 64 places
    words, k = n // 64 + 1, len(used)
    bits = np.empty((words, k), np.uint64)
    padded = np.full(words * 64, -1, np.int64)
    padded[:n] = bwt
    for c in range(k):
        bits[:, c] = np.packbits(padded == c, bitorder="little").view(np.uint64)
    counts = np.zeros((words, k), np.int32)
    np.cumsum(np.bitwise_count(bits[:-1]), axis=0, out=counts[1:], dtype=np.int32)
    base = np.cumsum(np.bincount(symbols, minlength=k)) - np.bincount(symbols, minlength=k)
    follow = np.empty(n, np.int64)
    follow[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)

    def before(place: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return counts[place >> 6] + np.bitwise_count(bits[place >> 6] & mask[:, None])

    shared = np.full(n + 1, True)  # whether the common prefix with the place before is not known to be short
    shared[[0, n]] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(length):
        if not len(lo):
            break
        one = hi - lo == 1
        step = follow[lo[one]]
        new_lo, new_hi = [step], [step + 1]
        wide_lo, wide_hi = lo[~one], hi[~one]
        for at in range(0, len(wide_lo), 20_000):
            a, b = before(wide_lo[at : at + 20_000]) + base, before(wide_hi[at : at + 20_000]) + base
            some = b > a
            new_lo.append(a[some])
            new_hi.append(b[some])
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = shared[hi]
        lo, hi = lo[fresh], hi[fresh]
        shared[hi] = False
    twice = np.zeros(n, bool)
    twice[order] = shared[:-1] | shared[1:]
    windows = sizes - length + 1
    return twice[np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))]


def _intervals(flags: np.ndarray, windows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, end) of the maximal runs of set flags within each context, moved to the contexts' places."""
    ends = np.cumsum(windows)
    edge = np.zeros(len(flags), bool)
    edge[ends[:-1]] = True
    before = np.r_[False, flags[:-1]] & ~edge if len(flags) else flags
    first = np.flatnonzero(flags & ~before)
    after = np.r_[flags[1:], False]
    after[ends - 1] = False
    last = np.flatnonzero(flags & ~after)
    own = np.searchsorted(ends, first, side="right")
    shift = at[own] - (ends - windows)[own]
    return own, first + shift, last + 1 + shift


def _frame(payloads: list[tuple[int, int, bytes]]):
    import pandas as pd

    return pd.DataFrame({"bucket": pd.array([p[0] for p in payloads], "int32"), "chunk": pd.array([p[1] for p in payloads], "int64"), "payload": [p[2] for p in payloads]})


def _store(docs: DataFrame, folder: str, length: int, buckets: int, chunk_bytes: int) -> DataFrame:
    """Write the chunks; returns their packed pairs, at least a row for each chunk."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        part, seq = TaskContext.get().partitionId(), 0
        ids, pieces, size = [], [], 0

        def close():
            nonlocal ids, pieces, size, seq
            chunk, seq = (part << 24) + seq, seq + 1
            raw = b"".join(pieces)
            offsets = np.cumsum([0] + [len(p) for p in pieces])
            names = np.array([(i or 0, i is None) for i in ids], "<i8")
            common.write_blob(f"{folder}/{chunk}", np.array([len(ids)], "<i8").tobytes(), names.tobytes(), offsets.astype("<i8").tobytes(), zstandard.compress(raw, 3))
            low, digest, _, _, again = runs(np.frombuffer(raw, np.uint8), offsets, length)
            ids, pieces, size = [], [], 0
            order = np.lexsort((digest, low, low % np.uint64(buckets)))
            low, digest, again = low[order], digest[order], again[order]
            new = np.r_[True, (low[1:] != low[:-1]) | (digest[1:] != digest[:-1])] if len(low) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            many = (np.diff(np.r_[at, len(low)]) > 1).astype(np.uint8) | (again[at].astype(np.uint8) << 1)
            low, digest = low[at], digest[at]
            cut = np.searchsorted(low % np.uint64(buckets), np.arange(buckets + 1).astype(np.uint64))
            rows = [(b, chunk, low[lo:hi].tobytes() + digest[lo:hi].tobytes() + many[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
            rows = rows or [(chunk % buckets, chunk, b"")]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "chunk", "payload"])

        for batch in batches:
            for some in common.parts(batch, 1, 500):
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    ids.append(doc_id)
                    pieces.append(raw)
                    size += len(raw)
                    if size >= chunk_bytes:
                        yield close()
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PACKED_DDL)


def _load(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, (doc_id, is null) rows) of a chunk."""
    import zstandard

    raw = common.read_range(f"{folder}/{chunk}")
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    names = np.frombuffer(raw[8 : 8 + 16 * n], "<i8").reshape(n, 2)
    offsets = np.frombuffer(raw[8 + 16 * n : 8 + 16 * n + 8 * (n + 1)], "<i8")
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[16 + 24 * n :], max_output_size=max(1, int(offsets[-1]))), np.uint8), offsets, names


def _pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(payload) // 17
    return np.frombuffer(payload, "<u8", n), np.frombuffer(payload, "<u8", n, 8 * n), np.frombuffer(payload, np.uint8, n, 16 * n)


def _meet(most: int):
    """Of a bucket of pairs: which repeat, which contexts are sent on, and over how many transforms."""

    def run(frame):
        parts = [_pairs(p) for p in frame["payload"]]
        low, digest, many = (np.concatenate([p[i] for p in parts]) for i in range(3))
        row = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        place = np.argsort(frame["chunk"].to_numpy(), kind="stable")
        turn = np.empty(len(parts), np.int64)
        turn[place] = np.arange(len(parts))
        order = np.lexsort((turn[row], digest, low))
        low, digest, many, row = low[order], digest[order], many[order], row[order]
        new_low = np.r_[True, low[1:] != low[:-1]] if len(low) else np.zeros(0, bool)
        new = new_low.copy()
        new[1:] |= digest[1:] != digest[:-1]
        context, group = np.cumsum(new) - 1, np.cumsum(new_low) - 1
        total = np.bincount(context, 1 + (many & 1)) if len(low) else np.zeros(0)
        kinds = np.bincount(group[new]) if len(low) else np.zeros(0, np.int64)
        several = (kinds[group] > 1) | ((many & 2) > 0)
        flag = (total[context] > 1).astype(np.uint8) | ((several & new).astype(np.uint8) << 1)
        salts = np.where(several & new, -(-kinds[group] // most), 0).astype("<u4") if len(low) else np.zeros(0, "<u4")
        some = flag > 0
        low, digest, flag, salts, row = low[some], digest[some], flag[some], salts[some], row[some]
        back = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[back], np.arange(len(parts) + 1))
        out = []
        for i, (chunk, lo, hi) in enumerate(zip(frame["chunk"], cut[:-1], cut[1:], strict=True)):
            own = back[lo:hi]
            out.append((0, chunk, low[own].tobytes() + digest[own].tobytes() + flag[own].tobytes() + salts[own].tobytes()))
        return _frame(out)

    return run


def _gather(folder: str, length: int, buckets: int):
    """Of a chunk: its repeated stretches (bucket -1), and the contexts sent on, packed by bucket and transform."""

    def run(frame):
        import zstandard

        chunk = int(frame["chunk"].iloc[0])
        packed = []
        for p in frame["payload"]:
            n = len(p) // 21
            packed.append((np.frombuffer(p, "<u8", n), np.frombuffer(p, "<u8", n, 8 * n), np.frombuffer(p, np.uint8, n, 16 * n), np.frombuffer(p, "<u4", n, 17 * n)))
        low, digest, flag, salts = (np.concatenate([p[i] for p in packed]) for i in range(4))
        if not len(low):
            return _frame([(-1, chunk, b"")])
        data, offsets, _ = _load(folder, chunk)
        own_low, own_digest, lo, hi, _ = runs(data, offsets, length)
        order = np.lexsort((digest, low))
        low, digest, flag, salts = low[order], digest[order], flag[order], salts[order]
        both = np.lexsort((np.r_[np.zeros(len(low), np.int8), np.ones(len(own_low), np.int8)], np.r_[digest, own_digest], np.r_[low, own_low]))
        source = np.maximum.accumulate(np.where(both < len(low), both, -1))
        at, source = both[both >= len(low)] - len(low), source[both >= len(low)]
        ok = (source >= 0) & (low[source] == own_low[at]) & (digest[source] == own_digest[at])
        at, source = at[ok], source[ok]
        whole = np.sort(at[(flag[source] & 1) > 0])
        out = [(-1, chunk, np.stack([lo[whole], hi[whole]], axis=1).astype("<i8").tobytes())]
        need = (flag[source] & 2) > 0
        source, at = source[need], at[need]
        _, first = np.unique(source, return_index=True)
        source, at = source[first], at[first]
        salt = np.where(salts[source] > 1, digest[source] % np.maximum(salts[source], 1).astype(np.uint64) + np.uint64(1), np.uint64(0))
        bucket = ((low[source] ^ mix(salt + np.uint64(7)) * (salt > 0)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if y > x:
                mine = order[x:y]
                a, z = lo[at[mine]], hi[at[mine]] + length - 1
                text = b"".join(data[i:j].tobytes() for i, j in zip(a, z, strict=True))
                head = np.stack([low[source[mine]].view("<i8"), salt[mine].view("<i8"), a, z - a], axis=1).astype("<i8")
                out.append((b, chunk, np.array([len(mine)], "<i8").tobytes() + head.tobytes() + zstandard.compress(text, 1)))
        return _frame(out)

    return run


def _transform(length: int, buckets: int, batch_bytes: int):
    """Of a bucket of contexts: the windows that repeat (bucket -1), and fingerprints of those of divided hashes."""

    def run(frame):
        import zstandard

        heads, texts, chunks = [], [], []
        for chunk, p in zip(frame["chunk"], frame["payload"], strict=True):
            n = int(np.frombuffer(p, "<i8", 1)[0])
            heads.append(np.frombuffer(p, "<i8", 4 * n, 8).reshape(n, 4))
            texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(p[8 + 32 * n :], max_output_size=int(heads[-1][:, 3].sum())), np.uint8))
            chunks.append(np.full(n, chunk))
        head, data, chunk = np.concatenate(heads), np.concatenate(texts), np.concatenate(chunks)
        start = np.cumsum(head[:, 3]) - head[:, 3]
        order = np.lexsort((start, head[:, 1], head[:, 0]))
        head, start, chunk = head[order], start[order], chunk[order]
        group = np.cumsum(np.r_[True, (head[1:, :2] != head[:-1, :2]).any(axis=1)]) - 1
        edges = np.searchsorted(group, np.arange(group[-1] + 2))
        filled = np.r_[0, np.cumsum(head[:, 3] + 1)][edges]
        out, marks, g = [], [], 0
        while g < len(edges) - 1:
            to = max(g + 1, int(np.searchsorted(filled, filled[g] + batch_bytes, side="right")) - 1)
            own = slice(edges[g], edges[to])
            flags = repeated(data, start[own], head[own, 3], length)
            which, a, b = _intervals(flags, head[own, 3] - length + 1, head[own, 2])
            marks.append((chunk[own][which], a, b))
            divided = np.flatnonzero(head[own, 1] > 0)
            if len(divided):
                out += _fingerprints(data, head[own][divided], start[own][divided], chunk[own][divided], length, buckets)
            g = to
        who, a, b = (np.concatenate([m[i] for m in marks]) for i in range(3))
        for c in np.unique(who):
            out.append((-1, int(c), np.stack([a[who == c], b[who == c]], axis=1).astype("<i8").tobytes()))
        return _frame(out)

    return run


def _fingerprints(data: np.ndarray, head: np.ndarray, start: np.ndarray, chunk: np.ndarray, length: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Packed (two hashes, chunk, place) of each window, by bucket."""
    n = len(data)
    sums = []
    for base in (_B, np.uint64(0xD6E8FEB86659FD93)):
        sums.append((np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n))], _powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1)))
    windows = head[:, 3] - length + 1
    own = np.repeat(np.arange(len(head)), windows)
    rel = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = start[own] + rel
    h1, h2 = (mix((s[at + length] - s[at]) * back[at]) for s, back in sums)
    # what repeats within the transform is marked there; one of each different window stands for them elsewhere
    first = np.lexsort((h2, h1))
    first = first[np.r_[True, (h1[first[1:]] != h1[first[:-1]]) | (h2[first[1:]] != h2[first[:-1]])]]
    own, rel, h1, h2 = own[first], rel[first], h1[first], h2[first]
    bucket = (h1 % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows = np.stack([h1.view(np.int64), h2.view(np.int64), chunk[own], head[own, 2] + rel], axis=1).astype("<i8")[order]
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, -1, rows[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]


def _compare(frame):
    """Windows of divided hashes whose fingerprint occurs twice."""
    rows = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 4) for p in frame["payload"]])
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    rows = rows[np.r_[False, same] | np.r_[same, False]]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2]))]
    cut = np.flatnonzero(np.r_[True, rows[1:, 2] != rows[:-1, 2], True]) if len(rows) else np.zeros(1, np.int64)
    return _frame([(-1, int(rows[x, 2]), np.stack([rows[x:y, 3], rows[x:y, 3] + 1], axis=1).astype("<i8").tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)])


def _cut(folder: str, length: int, texts: bool):
    """Of a chunk: its documents without the repeated bytes."""

    def run(frame):
        import pandas as pd

        data, offsets, names = _load(folder, int(frame["chunk"].iloc[0]))
        edge = np.zeros(len(data) + 1, np.int64)
        for p in frame["payload"]:
            spans = np.frombuffer(p, "<i8").reshape(-1, 2)
            np.add.at(edge, spans[:, 0], 1)
            np.add.at(edge, spans[:, 1] + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for (doc_id, null), lo, hi in zip(names, offsets[:-1], offsets[1:], strict=True):
            own = gone[lo:hi]
            kept = data[lo:hi][~own].tobytes()
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            out.append((None if null else int(doc_id), int(hi - lo), int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])
        return frame.astype({"doc_id": "Int64"})

    return run


def remove_repeats(docs: DataFrame, length: int = 200, texts: bool = False, chunk_bytes: int = 2 << 20, batch_bytes: int = 2 << 20, most: int = 4096, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if wanted, the kept
    bytes. ``length`` must exceed 64."""
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder, buckets = common.work_dir(spark, "chunks"), max(4 * common.partitions(spark), -(-size // bucket_bytes))
    met = _store(docs, folder, length, buckets, chunk_bytes).groupBy("bucket").applyInPandas(_meet(most), PACKED_DDL)
    met = common.materialize(met, "met")
    gathered = common.materialize(met.groupBy("chunk").applyInPandas(_gather(folder, length, buckets), PACKED_DDL), "gathered", [met])
    # a number of its own, as joining small partitions would leave few tasks: their work is in computing
    dealt = gathered.where("bucket >= 0").repartition(max(1, buckets // 2), "bucket")
    compared = common.materialize(dealt.groupBy("bucket").applyInPandas(_transform(length, buckets, batch_bytes), PACKED_DDL), "compared")
    crossed = compared.where("bucket >= 0").groupBy("bucket").applyInPandas(_compare, PACKED_DDL)
    marks = gathered.where("bucket < 0").union(compared.where("bucket < 0")).union(crossed)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return marks.groupBy("chunk").applyInPandas(_cut(folder, length, texts), ddl)


def op8_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents", "doc_id", "text"))
