"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the set of its five-word shingles (lower case, words are what stands between white space; fewer than five
words make one shingle). ProbMinHash draws for every shingle a Poisson process of the rate of its weight: arrivals come at exponential gaps and each falls on a random register, which keeps the
shingle of its earliest arrival. A shingle stops once its next arrival is later than every register of its document. Two
documents agree in a register with the probability Jaccard similarity of their weighted sets. Every shingle weighs 1
here, however often it occurs, so that this is the plain Jaccard similarity that decides: weights by count would hide
pairs of which one text repeats a line.

Registers are joined to bands; documents that share a band are candidates. A candidate pair is linked if the exact Jaccard
similarity of its shingle sets, the measure that the registers estimate, is at least ``threshold``; at 0.8 one pair in
20,000 shares no band. ``signatures`` takes any weights and so draws weighted sets too.
Classes are connected components of links, named by their smallest doc_id.

No bucket is expanded in all pairs. First every member of a bucket is verified against its smallest member, which
joins large groups of copies at once. What is left are pairs between different components within a bucket. A bound rules most of them out: with o(x) shingles of x that no other text of such buckets has, |x & y| <= min(|x| - o(x),
|y| - o(y)) and |x | y| >= max(|x| + o(y), |y| + o(x)). Members that it lets reach no other component are done. The
others meet all members of their bucket in blocks, where products of 0-1 matrices give all intersections at once, and
of whose links only a forest is returned. No bucket is capped and no candidate is dropped.

Equal texts are one node. Documents without a word (null, empty, only what str.split() takes as white space, which
BLANK states for Spark) are a class each. A null doc_id is never a name unless no other is there. Extra columns are
ignored; repeated rows share their class; an empty table gives no rows. Long texts are handled whole: batches are cut by
bytes, and a text's shingles (8 bytes a word) must fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, BANDS, ROWS = 5, 25, 5
#: What str.split() takes as white space; fixed by Python.
BLANK = "\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Sets of a block that may gain links, and sets that they are compared with.
BLOCK = (512, 1024)
#: Nodes whose names (a long, a long and 32 characters each, some 25 MB in all) may be sent to every executor.
BROADCAST_ROWS = 250_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, by one polynomial over their joined bytes."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    c = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    starts = np.r_[0, ends[:-1]]
    sums = np.r_[np.uint64(0), np.cumsum(c * np.cumprod(np.full(len(c), _M1, np.uint64)))]
    back = np.uint64(pow(int(_M1), -1, 1 << 64))
    return mix((sums[ends] - sums[starts]) * back ** starts.astype(np.uint64) + (ends - starts).astype(np.uint64))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the distinct shingles, by document, then hash."""
    seen: dict[str, int] = {}
    lines = [[seen.setdefault(w, len(seen)) for w in (t or "").lower().split()] for t in texts]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = _word_hashes(list(seen))[np.fromiter((i for line in lines for i in line), np.int64, int(size.sum()))]
    padded = np.r_[w, np.zeros(SHINGLE, np.uint64)]
    first = np.cumsum(size) - size
    count = np.where(size > 0, np.maximum(1, size - SHINGLE + 1), 0)
    doc = np.repeat(np.arange(len(lines)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    stop = (first + size)[doc]
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        h = mix(h * _M1 + np.where(at + j < stop, padded[np.minimum(at + j, len(w))], np.uint64(j)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    place = np.flatnonzero(new)
    return doc[place], h[place], np.diff(np.r_[place, len(h)])


def signatures(n: int, doc: np.ndarray, h: np.ndarray, w: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers (documents, registers): the shingle of the earliest arrival on each."""
    times = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    x = np.zeros(len(h))
    step = np.uint64(0)
    while len(h):
        step += np.uint64(1)
        draw = mix(h ^ mix(np.array([step]) * _M1))
        x = x - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / w
        early = x < latest[doc]
        if not early.all():
            doc, h, w, x, draw = doc[early], h[early], w[early], x[early], draw[early]
        slot = doc * registers + (mix(draw + _M1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, slot, x)
        won = times[slot] == x
        owner[slot[won]] = h[won]
        live = np.unique(doc)
        latest[live] = times.reshape(n, registers)[live].max(axis=1)
    return owner.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(documents, bands) signed 64-bit keys that also tell the band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signature), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * _M1 + parts[:, :, r])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def wordy(text):
    """Whether a text has a word, as an expression."""
    return F.coalesce(text.rlike(f"[^{BLANK}]"), F.lit(False))


def _slices(n: int, doc: np.ndarray) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def _sign(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands) of documents with a word; node is the md5 of the text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in common.parts(batch, 2, 500):
                doc, h, _ = shingles(part.column(2).to_pylist())
                some = np.unique(doc)
                keys = band_keys(signatures(part.num_rows, doc, h, np.ones(len(h)))[some])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                kept = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), bands], ["doc_id", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("node"), "text").mapInArrow(common.lean(run), "doc_id long, node string, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are linked."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in common.parts(batch, 2, 400):
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                each = {t: i for i, t in enumerate(dict.fromkeys(left + right))}
                doc, h, _ = shingles(list(each))
                cut = _slices(len(each), doc)
                linked = []
                for t, u in zip(left, right, strict=True):
                    i, j = each[t], each[u]
                    a, b = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
                    linked.append(similarity(h[a], h[b]) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(linked, pa.bool_())), part.column(1).filter(pa.array(linked, pa.bool_()))], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("nid").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(common.lean(run), "a long, b long")


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (nid, label) with the labels of linked nodes (a, b) made one: the smallest. Each round contracts
    every component into its smallest neighbour, so rounds grow with the logarithm of the longest chain."""
    given = labels
    while True:
        a, b = labels.select(F.col("nid").alias("a"), F.col("label").alias("la")), labels.select(F.col("nid").alias("b"), F.col("label").alias("lb"))
        open_ = edges.join(a, "a").join(b, "b").where("la <> lb").select(F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi")).distinct()
        parent = common.materialize(open_.groupBy("hi").agg(F.min("lo").alias("lo")), "parents")
        if parent.isEmpty():
            common.forget(parent)
            return labels
        written = parent
        for _ in range(3):  # grandparents
            up = parent.select(F.col("hi").alias("lo"), F.col("lo").alias("up"))
            parent = parent.join(up, "lo", "left").select("hi", F.coalesce("up", "lo").alias("lo"))
        moved = labels.join(parent.select(F.col("hi").alias("label"), "lo"), "label", "left")
        replaced = [written] if labels is given else [written, labels]
        labels = common.materialize(moved.select("nid", F.coalesce("lo", "label").alias("label")), "labels", replaced)


def _texts(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(nid, text) of the nodes that share a bucket with another, each read from one of its documents. The names of the
    nodes are broadcast where they are few; else both sides are shuffled."""
    need = members.select("nid").distinct().join(nodes.select("nid", F.col("node").alias("_node"), "rep"), "nid")
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    named = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").withColumn("_hash", F.md5("text"))
    found = named.join(need, named["_id"].eqNullSafe(need["rep"]) & (named["_hash"] == need["_node"])).select("nid", "text")
    return common.materialize(found.dropDuplicates(["nid"]), "texts")


def _sets(texts: DataFrame) -> DataFrame:
    """(nid, h): the sorted shingles of each text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in common.parts(batch, 1, 500):
                doc, h, _ = shingles(part.column(1).to_pylist())
                cut = _slices(part.num_rows, doc).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))], ["nid", "h"])

    return common.materialize(texts.select("nid", "text").mapInArrow(common.lean(run), "nid long, h array<long>"), "sets")


def _rarity(sets: DataFrame) -> DataFrame:
    """(nid, size, own): how many shingles a text has, and how many of them no other text here has."""
    lone = sets.select("nid", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("nid")).where("n = 1")
    return sets.select("nid", F.size("h").alias("size")).join(lone.groupBy("nid").agg(F.count(F.lit(1)).alias("own")), "nid", "left").select("nid", "size", F.coalesce("own", F.lit(0)).alias("own"))


def _most(sx: str, ox: str, sy: str, oy: str):
    """Upper bound of the Jaccard similarity of two sets from their sizes and counts of shingles that no other has."""
    both = F.least(F.col(sx) - F.col(ox), F.col(sy) - F.col(oy))
    return both / F.greatest(F.col(sx) + F.col(oy), F.col(sy) + F.col(ox))


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in a with every one in b. Elements of many sets are counted by products of
    0-1 matrices, a few thousand at a time, the others pair by pair."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(a), len(b)), np.float32)
    wide = np.flatnonzero(count >= 24)
    place = np.full(len(count), -1)
    place[wide] = np.arange(len(wide))
    for lo in range(0, len(wide), 4096):
        own = (place[column] >= lo) & (place[column] < lo + 4096)
        m = np.zeros((len(a) + len(b), min(4096, len(wide) - lo)), np.float32)
        m[row[own], place[column[own]] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    rare = (count[column] > 1) & (count[column] < 24)
    order = np.argsort(column[rare], kind="stable")
    row, column = row[rare][order], column[rare][order]
    for step in range(1, 24):  # pairs that lie ``step`` apart in the list of an element's sets
        same = column[step:] == column[:-step] if len(column) > step else np.zeros(0, bool)
        if not same.any():
            break
        x, y = row[:-step][same], row[step:][same]
        ok = (x < len(a)) & (y >= len(a))
        np.add.at(out, (x[ok], y[ok] - len(a)), 1)
    return out


def _blocks(open_: DataFrame, sets: DataFrame, threshold: float, some: int | None = None, all_: int | None = None) -> DataFrame:
    """Links (a, b) between the components of buckets that have several.

    Members outside a bucket's main component that the bound lets reach no other component are done; the bound is
    compared with the bucket's few distinct (size, own) values. The others meet all members of their bucket in blocks of
    about ``some`` by ``all_`` sets; what leaves a block is a forest of its links, at most a row per set.
    """
    some, all_ = some or BLOCK[0], all_ or BLOCK[1]
    stats = common.materialize(_rarity(sets), "rarity")
    h = common.materialize(open_.join(stats, "nid"), "bounded")
    kinds = h.groupBy("band", F.col("size").alias("sy"), F.col("own").alias("oy")).agg(F.min("label").alias("l1"), F.max("label").alias("l2"))
    able = h.where("label <> main").join(kinds, "band").where((F.col("l1") != F.col("label")) | (F.col("l2") != F.col("label"))).where(_most("size", "own", "sy", "oy") >= threshold)
    able = common.materialize(able.select("band", "nid", "label", "n").distinct(), "able")
    cuts = able.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / some).cast("int").alias("v"), F.ceil(F.max("n") / all_).cast("int").alias("y"))
    deal = lambda parts: F.pmod(F.xxhash64("nid"), F.col(parts)).cast("int")
    range_ = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = able.join(cuts, "band").select("band", deal("v").alias("i"), range_("y").alias("j"), "nid", "label", F.lit(True).alias("left"))
    right = h.select("band", "nid", "label").join(cuts, "band").select("band", range_("v").alias("i"), deal("y").alias("j"), "nid", "label", F.lit(False).alias("left"))
    rows = left.unionByName(right).join(sets, "nid").select("band", "i", "j", "nid", "label", "left", "h")

    def run(frame):
        import pandas as pd

        x, y = frame[frame["left"]], frame[~frame["left"]]
        links = []
        if len(x) and len(y):
            both = intersections(list(x["h"]), list(y["h"]))
            size = lambda f: f["h"].map(len).to_numpy()
            union = size(x)[:, None] + size(y)[None] - both
            lx, ly = x["label"].to_numpy(), y["label"].to_numpy()
            parent: dict[int, int] = {}

            def root(n: int) -> int:
                while n in parent:
                    n = parent[n]
                return n

            for i, j in np.argwhere((both >= threshold * union - 1e-6) & (lx[:, None] != ly[None])).tolist():
                a, b = root(int(lx[i])), root(int(ly[j]))
                if a != b:
                    parent[a] = b
                    links.append((int(x["nid"].iloc[i]), int(y["nid"].iloc[j])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return rows.groupBy("band", "i", "j").applyInPandas(run, "a long, b long")


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, node, class_id, keep): the class of every document; keep marks the one that names its class."""
    signed = common.materialize(_sign(docs), "signed")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = common.materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("nid", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("nid").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.materialize(rows.join(buckets, "band"), "members")
    texts = _texts(docs, nodes, members)
    tested = common.materialize(members.where("nid <> b").select(F.col("nid").alias("a"), "b").distinct(), "pairs")
    links = common.materialize(_verify(tested, texts, threshold), "links", [tested])
    labels = components(links, nodes.select("nid", F.col("nid").alias("label")))
    placed = members.select("band", "nid").join(labels, "nid")
    each = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = each.groupBy("band").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = common.materialize(placed.join(mixed.drop("parts"), "band"), "open", [links, members])
    if not open_.isEmpty():
        sets = _sets(texts.join(open_.select("nid").distinct(), "nid"))
        more = common.materialize(_blocks(open_, sets, threshold), "links", [sets])
        labels = components(more, labels)
        common.forget(more)
    common.forget(open_, texts)
    named = nodes.select("nid", "node", "rep").join(labels, "nid")
    first = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("first"))
    named = named.join(first, "label").select("node", F.col("first.rep").alias("class_id"), F.col("first.node").alias("first_node"))
    found = signed.select("doc_id", "node").join(named, "node")
    found = found.select("doc_id", "node", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first_node"))).alias("keep"))
    alone = docs.where(~wordy(F.col("text"))).select(F.col("doc_id").cast("long"), F.md5("text").alias("node"), F.col("doc_id").cast("long").alias("class_id"), F.lit(True).alias("keep"))
    return found.union(alone)


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each class; of repeated rows of that document one stays. Wordless rows all stay."""
    columns = docs.columns
    keep = classes(docs, threshold).where("keep").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct()
    named = docs.withColumn("_hash", F.md5("text"))
    kept = named.where(wordy(F.col("text"))).join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_node")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*columns).union(docs.where(~wordy(F.col("text"))))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id")
