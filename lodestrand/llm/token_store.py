"""Token ids in dictionary-compressed shard files with an offset index.

A shard file holds documents in ascending doc_id order:

    MAGIC (8) | sha256 of the zstandard dictionary (32)
    one zstandard frame per document: its ids as little-endian uint16 (uint32 for vocabularies over 65,536)
    index: rows of INDEX (doc_id, flags, offset, length, n_tokens)
    offset of the index (8) | rows (8) | bytes per id (8) | MAGIC (8)

The dictionary is trained once on serialized id arrays of a bounded sample (``sample_docs``) and stored beside the
shards; a reader refuses a shard whose hash names another dictionary. A single document is read with two range
reads (index, frame), so short documents cost neither the shard nor the ids of their neighbours.

Null text is the empty text (only the end id is stored). A null doc_id sorts first and is flagged in the index;
repeated doc_ids keep a row each, in no fixed order among themselves. An empty table gives no shard. Extra columns are
ignored. Batches are cut by bytes of text; a longer text is a batch by itself and one frame, whose memory is a few times
its size.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"LODETOK1"
INDEX = np.dtype([("doc_id", "<i8"), ("flags", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("n_tokens", "<i8")])
_GAP = r" (?:[\s\x0b\x1c-\x1f\x{85}\pZ]|\z)|\x00"
_HEAD = r"(?s)^( ?\pL*[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([\n!-@\[-`{-~].*)$"
INDEX_DDL = "part int, seq int, file string, doc_id long, before long, n_tokens long, offset long, length long"


@lru_cache(maxsize=4)
def word_encoder(path: str, cached: int = 600_000) -> Callable:
    """Encoder of Arrow string arrays by the tokenizers library: gives all ids and where each text's begin.

    A byte-level tokenizer never joins a space to what stands before it, so a text may be cut before every single
    space; and a run of letters ends its pre-token, so a word may be cut behind its leading letters (here: where a
    Latin letter meets an ASCII sign). The library meets each piece once a batch; texts with runs of white
    space, and texts that hold the string of a special or added token, go to it uncut, so that every id is the one the
    library gives for the whole text. ``cached`` pieces are kept between batches, which bounds memory, not the result.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    code = "H" if kind.itemsize == 2 else "I"
    known: dict[str, bytes] = {}

    def split(values, sign: str):
        """(distinct parts, index of the part of each place, first place of each value)."""
        parts = pc.split_pattern(values, sign)
        flat = parts.flatten().dictionary_encode()
        return flat.dictionary, flat.indices.to_numpy(), parts.offsets.to_numpy()

    def spread(flat: np.ndarray, begin: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the picked stretches of flat one after another, where each begins)."""
        size, out, ends = (begin[1:] - begin[:-1]).astype(np.int32), [], [np.zeros(1, np.int64)]
        for lo in range(0, len(picked), 1_000_000):  # bounds what the indexes take
            own = picked[lo : lo + 1_000_000]
            count = size[own]
            end = np.cumsum(count, dtype=np.int64)
            at = np.repeat(begin[own] - (end - count), count)
            at += np.arange(len(at))
            out.append(flat[at])
            ends.append(end + ends[-1][-1])
        return np.concatenate(out) if out else flat[:0], np.concatenate(ends)

    def look_up(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = list(map(known.get, pieces))
        fresh = [i for i, x in enumerate(raw) if x is None]
        for at in range(0, len(fresh), 4096):
            block = fresh[at : at + 4096]
            for i, hit in zip(block, tokenizer.encode_batch_fast([pieces[i] for i in block], add_special_tokens=False), strict=True):
                raw[i] = array(code, hit.ids).tobytes()
        if len(known) < cached:
            known.update((pieces[i], raw[i]) for i in fresh)
        return np.frombuffer(b"".join(raw), kind), np.cumsum(np.r_[0, np.fromiter(map(len, raw), np.int64, len(raw)) // kind.itemsize])

    def encode(texts) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, _GAP)
        for content in added:
            whole = pc.or_(whole, pc.match_substring(texts, content))
        words, word, first = split(pc.if_else(whole, texts, pc.replace_substring(texts, " ", "\0 ")), "\0")
        odd = np.zeros(len(words), bool)
        if pc.any(whole).as_py():  # texts that hold the sign themselves came apart at it: put them together again
            rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            words = pa.concat_arrays([words, texts.take(pa.array(rows))])
            keep, size = np.ones(len(word), bool), np.diff(first)
            for i, r in enumerate(rows):
                keep[first[r] + 1 : first[r + 1]] = False
                word = word.copy() if i == 0 else word
                word[first[r]] = len(odd) + i
                size[r] = 1
            word, first, odd = word[keep], np.r_[0, np.cumsum(size)], np.r_[odd, np.ones(len(rows), bool)]
        cut = pc.if_else(pa.array(odd), words, pc.replace_substring_regex(words, _HEAD, "\\1\0\\2")) if not odd.all() else words
        plain = np.flatnonzero(~odd)
        pieces, piece, begin = split(cut.take(pa.array(plain)), "\0")
        names = pieces.to_pylist() + words.take(pa.array(np.flatnonzero(odd))).to_pylist()
        piece = np.r_[piece, len(pieces) + np.arange(odd.sum())]
        begin = np.r_[begin, begin[-1] + 1 + np.arange(odd.sum())]
        order = np.empty(len(words), np.int64)
        order[np.r_[plain, np.flatnonzero(odd)]] = np.arange(len(words))
        ids, at = look_up(names)
        ids, at = spread(ids, at, piece)
        at = at[begin]
        ids, at = spread(ids, at, order[word])
        return ids, at[first]

    encode.dtype = kind
    return encode


common.keeps("tokens", word_encoder.cache_clear)


def train_dictionary(docs: DataFrame, encode_path: str, size: int = 65_536, sample_docs: int = 500, sample_chars: int = 20_000) -> bytes:
    """Dictionary trained on the serialized ids of about ``sample_docs`` documents (at most twice as many), at most
    ``sample_chars`` characters of each: a fitted model on a bounded sample, whatever the size of the table."""
    import zstandard

    total = docs.count()
    if not total:
        return b""
    every = max(1, total // sample_docs)
    rows = (
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        .select(F.substring("text", 1, sample_chars).alias("text"))
        .where(F.length("text") > 0).limit(2 * sample_docs).collect()
    )
    import pyarrow as pa

    ids, begin = word_encoder(encode_path)(pa.array([r.text for r in rows], pa.string()))
    samples = [ids[lo:hi].tobytes() for lo, hi in zip(begin[:-1], begin[1:], strict=True)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the ids themselves serve as the dictionary
        return b"".join(samples)[:size]


def _codec(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, dictionary: bytes = b"", level: int = 3, shard_bytes: int = 16 << 20, batch_bytes: int = 16 << 20) -> DataFrame:
    """Write all texts below ``folder`` in ascending doc_id order; returns the stored index (INDEX_DDL).

    Partitions are ranges of doc_id; a task writes its shards under names that depend on the partition alone, whole
    files at a time, so a repeated task replaces them by equal ones.
    """
    spark = docs.sparkSession
    common.write_blob(f"{folder}/dictionary", dictionary)

    def write(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        encode, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        shared = _codec(dictionary)
        if shared is not None:
            shared.precompute_compress(level=level)  # else it is digested again for every document
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        head = MAGIC + hashlib.sha256(dictionary).digest()
        end = np.asarray([end_id], encode.dtype)
        frames, rows, size, seq, before = [], [], len(head), 0, 0

        def close():
            nonlocal frames, rows, size, seq
            name = f"{folder}/shard-{part:06d}-{seq:05d}"
            index = np.array([(r[0] or 0, r[0] is None, r[3], r[4], r[2]) for r in rows], INDEX)
            tail = np.asarray([size, len(rows), encode.dtype.itemsize], "<i8").tobytes() + MAGIC
            common.write_blob(name, head, *frames, index.tobytes(), tail)
            out = pd.DataFrame({"part": part, "seq": seq, "file": name, "doc_id": pd.array([r[0] for r in rows], "Int64"), "before": [r[1] for r in rows], "n_tokens": [r[2] for r in rows], "offset": [r[3] for r in rows], "length": [r[4] for r in rows]})
            frames, rows, size, seq = [], [], len(head), seq + 1
            return pa.RecordBatch.from_pandas(out, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]), preserve_index=False)

        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = batch.column(1)
            sizes = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)])
            at = 0
            while at < len(names):
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + batch_bytes, side="right")) - 1)
                every, begin = encode(texts.slice(at, to - at))
                for doc_id, lo, hi in zip(names[at:to], begin[:-1], begin[1:], strict=True):
                    ids = every[lo:hi]
                    frame = packer.compress(np.append(ids, end).tobytes())
                    rows.append((doc_id, before, len(ids) + 1, size, len(frame)))
                    frames.append(frame)
                    size += len(frame)
                    before += len(ids) + 1
                    if size >= shard_bytes:
                        yield close()
                at = to
        if rows:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(common.partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return common.materialize(ordered.mapInArrow(common.lean(write, "tokens"), INDEX_DDL), "token-index")


def open_shard(uri: str, dictionary: bytes) -> tuple[np.ndarray, np.dtype]:
    """(index rows, dtype of ids) of a shard, after its dictionary hash was checked."""
    fs, path = common.file_system(uri)
    with fs.open_input_file(path) as f:
        head, tail = f.read_at(40, 0), f.read_at(32, f.size() - 32)
        if head[:8] != MAGIC or tail[-8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        at, n, width = np.frombuffer(tail[:24], "<i8")
        return np.frombuffer(f.read_at(int(n) * INDEX.itemsize, int(at)), INDEX), np.dtype(f"<u{width}")


def read_document(uri: str, dictionary: bytes, doc_id: int) -> np.ndarray:
    """The ids of one document, by range reads of the index and of its frame alone."""
    import zstandard

    index, kind = open_shard(uri, dictionary)
    at = np.flatnonzero((index["doc_id"] == doc_id) & (index["flags"] == 0))
    if not len(at):
        raise KeyError(doc_id)
    row = index[at[0]]
    frame = common.read_range(uri, int(row["offset"]), int(row["length"]))
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_codec(dictionary)).decompress(frame), kind)


def read_shards(index: DataFrame, dictionary: bytes, range_bytes: int = 4 << 20) -> DataFrame:
    """Read every indexed document back: doc_id, start, n_tokens, ids_crc32, n_bytes (of its frame).

    ``start`` needs the totals of earlier partitions only: a row per partition, summed in order and broadcast (as
    many rows as write partitions). Frames that lie side by side are fetched by one read of up to ``range_bytes``.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        opened: dict[str, np.dtype] = {}
        unpack = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))
        for batch in batches:
            part, file, doc_id, before, n, offset, length = (batch.column(i) for i in range(7))
            file, offset, length, n_np = file.to_pylist(), offset.to_numpy(), length.to_numpy(), n.to_numpy()
            crc, at = np.zeros(len(file), np.int64), 0
            while at < len(file):
                to = at + 1
                while to < len(file) and file[to] == file[at] and offset[to] == offset[to - 1] + length[to - 1] and offset[to] + length[to] - offset[at] <= range_bytes:
                    to += 1
                if file[at] not in opened:
                    opened = {file[at]: open_shard(file[at], dictionary)[1]}
                data = common.read_range(file[at], int(offset[at]), int(offset[to - 1] + length[to - 1] - offset[at]))
                for i in range(at, to):
                    ids = np.frombuffer(unpack.decompress(data[offset[i] - offset[at] : offset[i] - offset[at] + length[i]]), opened[file[at]])
                    if len(ids) != n_np[i]:
                        raise ValueError(f"{file[at]}: a document has {len(ids)} ids, its index says {n_np[i]}")
                    crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                at = to
            yield pa.RecordBatch.from_arrays([part, doc_id, before, n, pa.array(crc), batch.column(6)], ["part", "doc_id", "before", "n_tokens", "ids_crc32", "n_bytes"])

    rows = index.select("part", "file", "doc_id", "before", "n_tokens", "offset", "length").mapInArrow(read, "part int, doc_id long, before long, n_tokens long, ids_crc32 long, n_bytes long")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "n_bytes")


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    dictionary = train_dictionary(docs, path)
    index = write_shards(docs, common.work_dir(spark, "tokens"), path, dictionary=dictionary)
    return read_shards(index, dictionary)
