"""Language identification by a linear-chain conditional random field over words.

A word is what stands between white space, in lower case; characters that are no letters count as word ends. Its
features are its lexicon entry (the whole word), its affixes (first and last two and three letters) and its letter
bi- and trigrams, all hashed into one weight table. Transitions between the languages of neighbouring words are learned
from training sequences that splice stretches of differently labelled documents, so code-switched text is labelled
word by word. A document's language has the largest mean marginal (forward-backward), which is its score.

Long documents are cut in windows of ``CORE`` words that see ``CONTEXT`` words to either side: all words count
once, and memory stays bounded whatever a text's length.

A model may learn one more label, ``OTHER``, from words with shuffled letters, random letters and letters of random
scripts. It is never predicted; its mean marginal, the share of a text's words that are of no learned language, is the
column ``other``.

Null text and text without a letter give ``und`` and score 0; so does every text if nothing was there to learn from.
Ties go to the language that sorts first. Extra columns pass through; ``lang_pred``, ``score`` and ``other`` are replaced if
there. Repeated rows keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CORE, CONTEXT = 128, 32
BITS = 17
OTHER = "\U0010ffff"  # sorts behind all languages


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2 ** BITS, labels)
    moves: np.ndarray  # (labels, labels), from the row to the column
    words: int = 0  # different words that it learned from


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed feature, word, weight of the feature) for words in lower case, and which words hold a letter."""
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = c == 32
    letter = _letters()[c]
    x = np.where(letter, c, 1).astype(np.uint64)
    at = np.flatnonzero(space)
    word = np.cumsum(space) - 1
    end = np.r_[at[1:], len(c)][np.minimum(word, len(at) - 1)]
    i = np.arange(len(c))
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - BITS)
    out, owner, weight = [], [], []
    has = np.zeros(len(at), bool)
    has[word[letter]] = True
    length = np.maximum(1, np.diff(np.r_[at, len(c)]) - 1)
    g2 = x[:-1] * m2 + x[1:] * m1
    g3 = (g2[:-1] ^ (g2[:-1] >> np.uint64(29))) * m3 + x[2:] * m2
    for g, n in ((g2, 2), (g3, 3)):
        ok = i[: len(g)] + n - 1 <= end[: len(g)]
        ok &= letter[: len(g)] | letter[n - 1 :]
        out.append(((g[ok] * m1) >> shift).astype(np.int64))
        owner.append(word[: len(g)][ok])
        weight.append((3.0 / np.sqrt(length[owner[-1]])).astype(np.float32))
    powers = np.cumprod(np.full(len(c), m1, np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(x * powers)]
    first, last = at[:-1] + 1, at[1:]
    full = (sums[last] - sums[first]) * np.uint64(pow(int(m1), -1, 1 << 64)) ** first.astype(np.uint64)
    salt = [(np.uint64(s), np.uint64(s * int(m3) % (1 << 64))) for s in (11, 13, 17, 19, 23)]
    lead, tail = np.minimum(first + 1, last), np.maximum(last - 2, first)
    for (s, add), value in zip(salt, (full, x[np.minimum(first, last)] * m2 + x[lead], g3[np.minimum(first, len(g3) - 1)], x[np.maximum(last - 1, first)] * m3 + x[tail], g3[np.maximum(np.minimum(last - 3, len(g3) - 1), 0)]), strict=True):
        out.append((((value ^ s) * m2 + add) * m1 >> shift).astype(np.int64))
        owner.append(np.arange(len(first)))
        weight.append(np.ones(len(first), np.float32))
    return np.concatenate(out), np.concatenate(owner), np.concatenate(weight), has[: len(words)]


def emissions(words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each label, whether the word holds a letter) per word."""
    feature, owner, weight, has = features(words)
    out = np.stack([np.bincount(owner, weights[feature, k] * weight, len(words)) for k in range(weights.shape[1])], axis=1)
    return out[: len(words)], has


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals (sequences, steps, labels); steps beyond a sequence's length hold no meaning."""
    n, steps, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(moves)
    forward = np.empty_like(e)
    a = np.full((n, k), 1.0 / k)
    for s in range(steps):
        a = (a @ t if s else a) * e[:, s]
        a /= a.sum(axis=1, keepdims=True)
        forward[:, s] = a
    b = np.ones((n, k))
    for s in range(steps - 1, -1, -1):
        forward[:, s] *= b
        if s:
            b = (e[:, s] * b) @ t.T
            b /= b.sum(axis=1, keepdims=True)
            b = np.where((s < lengths)[:, None], b, 1.0)
    forward /= forward.sum(axis=2, keepdims=True)
    return forward


def document_marginals(words: np.ndarray, offsets: np.ndarray, scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Mean marginals (documents, labels) for flat word indexes into scores; documents without words get zeros."""
    k, n = scores.shape[1], np.diff(offsets)
    segments = -(-n // CORE)
    doc = np.repeat(np.arange(len(n)), segments)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments)
    lo, hi = offsets[doc] + nth * CORE, np.minimum(offsets[doc] + (nth + 1) * CORE, offsets[doc + 1])
    start, stop = np.maximum(lo - CONTEXT, offsets[doc]), np.minimum(hi + CONTEXT, offsets[doc + 1])
    total = np.zeros((len(n), k))
    order = np.argsort(stop - start, kind="stable")
    for at in range(0, len(order), 512):
        own = order[at : at + 512]
        steps = int((stop - start)[own].max())
        place = start[own][:, None] + np.arange(steps)[None]
        g = forward_backward(scores[words[np.minimum(place, len(words) - 1)]], (stop - start)[own], moves)
        core = (place >= lo[own][:, None]) & (place < hi[own][:, None])
        np.add.at(total, doc[own], (g * core[:, :, None]).sum(axis=1))
    return total / np.maximum(n, 1)[:, None]


def strange(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words of no language: with shuffled letters, of random Latin letters, or of random letters of one script."""
    out, kind = [], rng.random()
    start, size = ((0x61, 26), (0x61, 26), (0x370, 80), (0x400, 250), (0x5D0, 27), (0x620, 42), (0x904, 54), (0x10D0, 43), (0x3041, 180), (0x4E00, 20000), (0xAC00, 11000), (0x100, 128))[int(rng.integers(12))]
    for w in words:
        if kind < 0.5 and len(set(w)) > 2:
            out.append("".join(rng.permutation(list(w))))
        else:
            out.append("".join(chr(start + int(c)) for c in rng.integers(0, size, int(rng.integers(3, 10)))).lower())
    return out


def train(texts: list[str], langs: list[str], other: bool = False, sequences: int = 2400, steps: int = 64, epochs: int = 3, seed: int = 7, rate: float = 0.35) -> Model | None:
    """Fit weights and transitions by gradient ascent (Adagrad) on spliced sequences."""
    labels = sorted(set(langs))
    pools: dict[str, list[list[str]]] = {name: [] for name in labels}
    vocabulary: dict[str, int] = {}
    for text, lang in zip(texts, langs, strict=True):
        if words := [w for w in text.lower().split() if any(map(str.isalpha, w))]:
            pools[lang].append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
    pools = {name: pool for name, pool in pools.items() if pool}
    labels = sorted(pools)
    if not labels:
        return None
    rng, names = np.random.default_rng(seed), list(vocabulary)
    if other:
        pools[OTHER] = [[vocabulary.setdefault(w, len(vocabulary)) for w in strange([names[int(i)] for i in rng.integers(0, len(names), 30)], rng)] for _ in range(300)]
        labels.append(OTHER)
    k = len(labels)
    ids, gold = np.zeros((sequences, steps), np.int64), np.zeros((sequences, steps), np.int64)
    for row in range(sequences):
        at = 0
        while at < steps:
            y = int(rng.integers(k))
            pool = pools[labels[y]]
            words = pool[int(rng.integers(len(pool)))]
            take = min(int(rng.geometric(1 / 20)), steps - at)
            lo = int(rng.integers(max(1, len(words) - take + 1)))
            part = words[lo : lo + take]
            ids[row, at : at + len(part)], gold[row, at : at + len(part)] = part, y
            at += len(part)
    feature, owner, weight, _ = features(list(vocabulary))
    order = np.argsort(owner, kind="stable")
    feature, weight = feature[order], weight[order]
    begin = np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))
    w, m = np.zeros((1 << BITS, k)), np.zeros((k, k))
    wg, mg = np.full_like(w, 1e-2), np.full_like(m, 1e-2)
    lengths = np.full(64, steps)
    for _ in range(epochs):
        for rows in np.split(rng.permutation(sequences), range(64, sequences, 64)):
            used, where = np.unique(ids[rows], return_inverse=True)
            where = where.reshape(len(rows), steps)
            count = begin[used + 1] - begin[used]
            pick = np.repeat(begin[used] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            f, wt, own = feature[pick], weight[pick], np.repeat(np.arange(len(used)), count)
            table = np.stack([np.bincount(own, w[f, j] * wt, len(used)) for j in range(k)], axis=1)
            scores = table[where]
            g = forward_backward(scores, lengths[: len(rows)], m)
            y = np.eye(k)[gold[rows]]
            residual = np.stack([np.bincount(where.ravel(), (y - g)[:, :, j].ravel(), len(used)) for j in range(k)], axis=1) / len(rows)
            for j in range(k):
                grad = np.bincount(f, residual[own, j] * wt, 1 << BITS) - 1e-6 * w[:, j]
                wg[:, j] += grad * grad
                w[:, j] += rate * grad / np.sqrt(wg[:, j])
            e = np.exp(scores - scores.max(axis=2, keepdims=True))
            both = g[:, :-1, :, None] / np.maximum(1e-12, (e[:, 1:] @ np.exp(m).T))[:, :, :, None] * np.exp(m)[None, None] * e[:, 1:, None, :]
            both *= g[:, 1:, None, :] / np.maximum(1e-12, both.sum(axis=2, keepdims=True))
            grad = np.einsum("bsi,bsj->ij", y[:, :-1], y[:, 1:]) - both.sum(axis=(0, 1))
            grad /= len(rows)
            mg += grad * grad
            m += rate * grad / np.sqrt(mg)
    return Model(labels, w.astype(np.float32), m, len(names))


def sample(docs: DataFrame, per_lang: int = 300, chars: int = 3000) -> tuple[list[str], list[str]]:
    """About ``per_lang`` labelled rows of each language (at most twice as many), chosen by a hash of doc_id, with at
    most ``chars`` characters each: the bounded sample that the model is fitted on."""
    known = docs.where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    texts, langs = [], []
    if counts:
        every = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, max(1, n // per_lang))])
        for r in known.where(F.pmod(F.xxhash64("doc_id"), every[F.col("lang")]) == 0).select("lang", F.substring("text", 1, chars).alias("text")).limit(2 * per_lang * len(counts)).collect():
            texts.append(r.text)
            langs.append(r.lang)
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    return [texts[i] for i in order], [langs[i] for i in order]


def fit(docs: DataFrame, other: bool = False, **options) -> Model | None:
    return train(*sample(docs, **options), other=other)


def annotate(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score, and with ``other`` if the model knows it."""
    from pyspark.sql import types as T

    df = df.drop("lang_pred", "score", "other")
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    place, labels = df.columns.index(text), [x for x in model.labels if x != OTHER]
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("other", T.DoubleType())] * (OTHER in model.labels)]

    def label(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in common.parts(batch, place, 500):
                seen: dict[str, int] = {}
                lines = [[seen.setdefault(w, len(seen)) for w in (t or "").lower().split()] for t in part.column(place).to_pylist()]
                means, known = np.zeros((len(lines), len(model.labels))), np.zeros(len(lines), bool)
                if seen:
                    scores, has = emissions(list(seen), model.weights)
                    flat = np.fromiter((w for line in lines for w in line), np.int64)
                    keep = has[flat]
                    ends = np.cumsum([0] + [len(line) for line in lines])
                    offsets = np.r_[0, np.cumsum(keep)][ends]
                    known = np.diff(offsets) > 0
                    if keep.any():
                        means = document_marginals(flat[keep], offsets, scores, model.moves)
                own = np.clip(means[:, : len(labels)], 0, 1)
                names = [labels[b] if ok else "und" for b, ok in zip(own.argmax(axis=1), known, strict=True)]
                columns = [pa.array(names, pa.string()), pa.array(np.where(known, own.max(axis=1), 0.0), pa.float64()), pa.array(np.clip(means[:, -1], 0, 1), pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns[: len(new)]], [*part.schema.names, *(f.name for f in new)])

    return df.mapInArrow(common.lean(label), T.StructType([*df.schema.fields, *new]))


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that a model may learn from: crc32 of doc_id as text, mod 4, is not 2."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    model = fit(learnable(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")))
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = annotate(docs, model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
