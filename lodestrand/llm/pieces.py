"""SentencePiece encoding and decoding by suffix-array matching.

For a batch of words the texts are joined, their suffixes sorted by their first 16 characters (no piece is longer than
the model's longest, which sets that depth), and every piece whose symbols occur is binary-searched for the range of
suffixes that it starts. The occurrences, edges from a start to an end, are sorted by position and relaxed from left to
right: ``last[end]`` is the last piece of the encoding of the word up to ``end``.

The models read are BPE models (as the 32k file is), for which the encoding of every prefix is unique: an edge is taken if
its piece may follow ``last[start]``, that is if no merge across the border of the two comes before the merges that form
them. That is decided by undoing their merges from the last to the first, for all pairs of a step at once. The result
equals the library's.

Words are cut where a run of spaces begins; a model in which some piece has a space after another character is
refused, as such cuts would not be exact. Characters without a piece become bytes. The normaliser is identity with a
space put in front, as in the model file used here; other normalisers are refused by a probe. Unbroken words of more than
``LONG`` characters are matched in overlapping stretches and relaxed in one pass over their characters, so that time is
linear and memory bounded whatever a word's or a text's length; batches are cut by bytes of text.

Null text counts as empty and gives no pieces. A literal U+2581 is a space to SentencePiece, so decoding gives a
space for it. Extra columns pass through ``encode_column``, but columns named as its results are replaced; repeated rows
keep a row each; there are no ties, as the encoding is unique. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACE = "▁"
#: Words beyond this many characters are relaxed by themselves; characters that are matched at a time.
LONG, BLOCK = 256, 200_000
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    """The pieces of a SentencePiece model and how BPE joins them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        self.score = {p: model.get_score(i) for i, p in self.piece.items()}
        self.id = {p: i for i, p in self.piece.items()}
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(self.size) if model.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.piece.values()) or len(self.byte) != 256:
            raise ValueError("only models with spaces in front of words and byte fallback are read")
        if [model.id_to_piece(i) for i in model.encode("ﬁ  x ")] != [SPACE, "ﬁ", SPACE, SPACE + "x", SPACE] and model.decode(model.encode("ﬁ  x ")) != "ﬁ  x ":
            raise ValueError("only identity normalisers are read")
        self.depth = max(map(len, self.piece.values()))
        self.raw = [b""] * self.size
        for i, p in self.piece.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.ids = np.array(plain)
        self.length = np.zeros(self.size, np.int64)
        self.length[self.ids] = [len(self.piece[i]) for i in plain]
        self.codes = np.zeros((len(plain), self.depth), np.uint32)
        for row, i in enumerate(plain):
            self.codes[row, : len(self.piece[i])] = np.frombuffer(self.piece[i].encode("utf-32-le"), np.uint32)
        self._learn_merges()

    def halves(self, text: str) -> list[str]:
        """BPE in merge order, the best-scored neighbouring pair first, the leftmost of equals: the two parts that are
        merged last, or more if the text does not become one piece."""
        parts, score = list(text), self.score
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _learn_merges(self) -> None:
        """How each piece is formed, and the scores of all pairs that merge."""
        self.formed = np.full(self.size, np.inf)  # single characters were there from the start
        self.head, self.tail = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.alone = np.zeros(self.size, bool)
        pairs: dict[int, float] = {}
        for i, p in self.piece.items():
            if any(c not in self.id for c in p):
                raise ValueError("a piece holds a character that is no piece")
            parts = self.halves(p)
            self.alone[i] = len(parts) <= 2
            if len(parts) == 2:
                self.formed[i], self.head[i], self.tail[i] = self.score[p], self.id[parts[0]], self.id[parts[1]]
            for at in range(1, len(p)):
                if (a := self.id.get(p[:at])) is not None and (b := self.id.get(p[at:])) is not None:
                    pairs[a * self.size + b] = self.score[p]
        made = self.alone & np.isfinite(self.formed)
        if (np.minimum(self.formed[self.head], self.formed[self.tail]) < self.formed)[made].any():
            raise ValueError("a piece would be formed before its parts")
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_score = np.array([pairs[k] for k in self.pair.tolist()])
        self.met, self.met_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b, side by side, stay apart. From the last merge back to the first, the two pieces at
        the border must not merge before the next merge that takes one of them away (at equal scores the left goes first)."""
        ok, row = np.ones(len(a), bool), np.arange(len(a))
        limit, at_limit = np.full(len(a), -np.inf), np.zeros(len(a), bool)
        while len(row):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            score = np.where(self.pair[place] == key, self.pair_score[place], -np.inf)
            merged = (score > limit) | (at_limit & (score == limit))
            ok[row[merged]] = False
            by_a, by_b = self.formed[a], self.formed[b]
            go = ~merged & (np.isfinite(by_a) | np.isfinite(by_b))
            row, a, b, by_a, by_b = row[go], a[go], b[go], by_a[go], by_b[go]
            at_limit = by_b <= by_a
            limit = np.where(at_limit, by_b, by_a)
            a, b = np.where(at_limit, a, self.tail[a]), np.where(at_limit, self.head[b], b)
        return ok

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``apart``, with the pairs met last kept in a table of fixed size."""
        slot = lambda k: ((k * 0x9E3779B1) >> 11) & (len(self.met) - 1)
        key = left * self.size + right
        place = slot(key)
        out, miss = self.met_ok[place], np.flatnonzero(self.met[place] != key)
        if len(miss):
            fresh, where = np.unique(key[miss], return_inverse=True)
            ok = self.apart(fresh // self.size, fresh % self.size)
            out[miss] = ok[where]
            place = slot(fresh)
            self.met[place], self.met_ok[place] = fresh, ok
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _keys(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of symbols below 2 ** bits as few big-endian words."""
    each = 64 // bits
    out = []
    for lo in range(0, codes.shape[1], each):
        key = np.zeros(len(codes), np.uint64)
        for j in range(lo, lo + each):
            key = (key << np.uint64(bits)) | (codes[:, j] if j < codes.shape[1] else np.uint64(0))
        out.append(key)
    return out


def _search(table: list[np.ndarray], keys: list[np.ndarray], after: bool) -> np.ndarray:
    """For each key the first place in the sorted table that is not below it (after: that is above it)."""
    lo, hi = (np.searchsorted(table[0], keys[0], side) for side in ("left", "right"))
    if len(table) == 1:
        return hi if after else lo
    while len(rows := np.flatnonzero(lo < hi)):
        mid = (lo[rows] + hi[rows]) >> 1
        below, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for t, k in zip(table[1:], keys[1:], strict=True):
            x, y = t[mid], k[rows]
            below |= equal & (x < y)
            equal &= x == y
        go = below | equal if after else below
        lo[rows], hi[rows] = np.where(go, mid + 1, lo[rows]), np.where(go, hi[rows], mid)
    return lo


def occurrences(words: list[str], v: Vocabulary) -> tuple[np.ndarray, ...]:
    """(start, end, piece id) of every piece in the joined words, and the words' starts and all code points."""
    joined = "\0".join(words) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    symbols = np.unique(c)
    symbols = symbols[symbols > 0]
    bits = next(b for b in (8, 16, 32) if len(symbols) < (1 << b) - 1)
    each = 64 // bits
    key = (np.searchsorted(symbols, c) + 1).astype(np.uint64)
    key[begin + size] = 0
    left = np.repeat(begin + size, size + 1) - np.arange(len(c))  # characters up to the word's end
    at = np.flatnonzero(left > 0)
    width = 1
    while width < each:  # words of ``each`` symbols by doubling
        key = (key << np.uint64(bits * width)) | np.r_[key[width:], np.zeros(min(width, len(key)), np.uint64)]
        width *= 2
    # symbols beyond a word's end are dropped, so that a suffix ends with its word
    mask = np.array([((1 << bits * n) - 1) << bits * (each - n) for n in range(each + 1)], np.uint64)
    key = np.r_[key, np.zeros(v.depth, np.uint64)]
    suffix = [key[at + lo] & mask[np.clip(left[at] - lo, 0, each)] for lo in range(0, v.depth, each)]
    order = np.lexsort(suffix[::-1])
    table, at = [k[order] for k in suffix], at[order]
    place = np.minimum(np.searchsorted(symbols, v.codes), max(0, len(symbols) - 1))
    known = ((v.codes == 0) | (symbols[place] == v.codes)).all(axis=1) if len(symbols) else np.zeros(len(v.codes), bool)
    codes = np.where(v.codes[known] == 0, 0, place[known] + 1).astype(np.uint64)
    first = _search(table, _keys(codes, bits), False)
    top = np.where(v.codes[known] == 0, (1 << bits) - 1, codes).astype(np.uint64)
    last = _search(table, _keys(top, bits), True)
    count, ids = last - first, v.ids[known]
    pick = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    start, piece = at[pick], np.repeat(ids, count)
    return start, start + v.length[piece], piece, begin, c


def edges_of(words: list[str], v: Vocabulary) -> tuple[np.ndarray, ...]:
    """``occurrences`` of pieces that can be an encoding by themselves, and an edge with the id ``size`` + code point for
    each character without a piece; also each position's word."""
    start, end, piece, begin, c = occurrences(words, v)
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size + 1)
    covered = np.zeros(len(c), bool)
    covered[start[v.length[piece] == 1]] = True
    covered[begin + size] = True
    lone, ok = np.flatnonzero(~covered), v.alone[piece]
    return np.r_[start[ok], lone], np.r_[end[ok], lone + 1], np.r_[piece[ok], v.size + c[lone].astype(np.int64)], begin, owner


def spelled(ids: np.ndarray, v: Vocabulary) -> bytes:
    """Little-endian uint32 ids, with the bytes of characters without a piece."""
    if (ids >= v.size).any():
        flat: list[int] = []
        for i in ids.tolist():
            flat += [i] if i < v.size else [v.byte[b] for b in chr(i - v.size).encode("utf-8", "surrogatepass")]
        ids = np.asarray(flat)
    return ids.astype("<u4").tobytes()


def encode_words(words: list[str], v: Vocabulary) -> list[bytes]:
    """The ids of each word, as little-endian uint32."""
    if not words:
        return []
    start, end, piece, begin, owner = edges_of(words, v)
    size = np.fromiter(map(len, words), np.int64, len(words))
    level = (end - begin[owner[start]]).astype(np.int32)
    order = np.argsort(level, kind="stable")
    start, end, piece, level = start[order], end[order], piece[order], level[order]
    cut = np.searchsorted(level, np.arange(1, (level.max() if len(level) else 0) + 2))
    last = np.full(len(owner) + 1, -1, np.int64)
    width = np.zeros(len(owner) + 1, np.int64)
    inner = np.ones(len(owner) + 1, bool)
    inner[begin] = False
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
        before = last[s]
        ok = np.ones(hi - lo, bool)
        both = np.flatnonzero(inner[s] & (before < v.size) & (p < v.size))
        ok[both] = v.may_follow(before[both], p[both])
        last[e[ok]], width[e[ok]] = p[ok], (e - s)[ok]
    at, own, parts = begin + size, np.arange(len(words)), []
    live = size > 0
    at, own = at[live], own[live]
    step = 0
    while len(own):
        if (width[at] == 0).any():
            raise ValueError("a prefix has no encoding")
        parts.append((own, np.full(len(own), step), last[at]))
        at = at - width[at]
        live = at > begin[own]
        at, own, step = at[live], own[live], step + 1
    if not parts:
        return [b""] * len(words)
    own, step, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((-step, own))
    own, ids = own[order], ids[order]
    edges = np.searchsorted(own, np.arange(len(words) + 1))
    raw = ids.astype("<u4").tobytes()
    out = [raw[4 * lo : 4 * hi] for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    for n in np.unique(own[ids >= v.size]).tolist():
        out[n] = spelled(ids[edges[n] : edges[n + 1]], v)
    return out


def encode_long(word: str, v: Vocabulary, stretch: int = 20_000) -> bytes:
    """The ids of one long word: stretches that overlap by the longest piece are matched one after another, and the edges
    relaxed in the order of their starts."""
    last, width = np.full(len(word) + 1, -1, np.int64).tolist(), [0] * (len(word) + 1)
    ending: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for lo in range(0, len(word), stretch):
        start, end, piece, _, _ = edges_of([word[lo : lo + stretch + v.depth]], v)
        own = start < stretch
        start, end, piece = start[own] + lo, end[own] + lo, piece[own]
        order = np.argsort(start, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        # which pieces may follow which, for all edges that meet
        into, by = np.r_[ending[0], end], np.r_[ending[1], piece]
        first, count = np.searchsorted(start, into), np.searchsorted(start, into, side="right") - np.searchsorted(start, into)
        right = piece[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        left = np.repeat(by, count)
        both = (left < v.size) & (right < v.size)
        pairs = np.unique(left[both] * v.size + right[both])
        good = set(pairs[v.may_follow(pairs // v.size, pairs % v.size)].tolist())
        for s, e, p in zip(start.tolist(), end.tolist(), piece.tolist(), strict=True):
            b = last[s]
            if not s or b >= v.size or p >= v.size or b * v.size + p in good:
                last[e], width[e] = p, e - s
        late = end >= lo + stretch
        ending = end[late], piece[late]
    out, at = [], len(word)
    while at:
        if not width[at]:
            raise ValueError("a prefix has no encoding")
        out.append(last[at])
        at -= width[at]
    return spelled(np.asarray(out[::-1], np.int64), v)


def encode_all(words: list[str], v: Vocabulary) -> list[bytes]:
    """The ids of words of any length, in blocks of bounded size."""
    out: list[bytes] = [b""] * len(words)
    block: list[int] = []
    held = 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if len(words[i]) > LONG:
            out[i] = encode_long(words[i], v)
            continue
        block.append(i)
        held += len(words[i]) + 1
        if held >= BLOCK:
            for n, ids in zip(block, encode_words([words[n] for n in block], v), strict=True):
                out[n] = ids
            block, held = [], 0
    for n, ids in zip(block, encode_words([words[n] for n in block], v), strict=True):
        out[n] = ids
    return out


class Encoder:
    """Encodes and decodes batches of texts; words met before are remembered up to a bound on memory."""

    def __init__(self, path: str, remembered: int = 300_000):
        self.v, self.known, self.bound = vocabulary(path), {}, remembered

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = []
        for t in texts:
            parts = t.replace(SPACE, " ").split(" ") if t else []
            if "" in parts or "\0" in t:
                parts = [w[1:] for w in _RUNS.findall((SPACE + t).replace(" ", SPACE))]
            split.append(parts)
        distinct = set(chain.from_iterable(split))
        fresh = [w for w in distinct if w not in self.known]
        plain, odd = [w for w in fresh if "\0" not in w], [w for w in fresh if "\0" in w]
        found = dict(zip(plain, encode_all([SPACE + w for w in plain], self.v), strict=True))
        zero = np.asarray([self.v.byte[0]], "<u4").tobytes()
        for w in odd:  # the separator itself: it never joins a piece, so the word falls apart there
            found[w] = zero.join(encode_all((SPACE + w).split("\0"), self.v))
        if (room := self.bound - len(self.known)) > 0:
            self.known.update(islice(((w, ids) for w, ids in found.items() if len(w) <= LONG), room))
        get = (found | {w: self.known[w] for w in distinct if w in self.known}).__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), "<u4") for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = 20_000) -> Encoder:
    return Encoder(path, remembered)


common.keeps("pieces", lambda: (encoder.cache_clear(), vocabulary.cache_clear()))


def encode_column(df: DataFrame, path: str, text: str = "text", ids: bool = True, large: int = 1, spare: int = 1, remembered: int = 20_000, size: int = 512 << 10) -> DataFrame:
    """df with n_pieces, ids_crc32 (of the little-endian unsigned 32-bit ids), round_trip (whether decoding gives the
    text back, U+2581 being a space) and, if wanted, the array of ids. ``large`` and ``spare`` are those of common.lean,
    ``remembered`` bounds the words that a worker keeps, ``size`` the bytes of text that it encodes at once."""
    new = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), *[T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] * ids]
    df = df.drop(*(f.name for f in new))
    place = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        work = encoder(path, remembered)
        for batch in batches:
            for part in common.parts(batch, place, 500, size):
                texts = [t or "" for t in part.column(place).to_pylist()]
                found = work.encode(texts)
                more = [pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([work.decode(x) == t.replace(SPACE, " ") for x, t in zip(found, texts, strict=True)], pa.bool_())]
                if ids:
                    offsets = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
                    more.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *(f.name for f in new)])

    return df.mapInArrow(common.lean(run, "pieces", large, spare), T.StructType([*df.schema.fields, *new]))


def decode_column(df: DataFrame, path: str, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """df with the text of an array of ids; null ids give null."""
    df = df.drop(text)
    place = df.columns.index(ids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        work = encoder(path)
        for batch in batches:
            found = [None if x is None else work.decode(np.asarray(x, np.int64)) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_column(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False, large=8, spare=64, remembered=300_000, size=2 << 20).drop("text")
