"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector is scaled to unit length and turned by a random orthogonal matrix; its code is the sign of every
coordinate, and its correction scalar the inner product of vector and code. With both, the inner product with a
query is estimated without bias, and the error stays within ``epsilon * sqrt((1 - s^2) / s^2) / sqrt(d - 1)`` but for
a tail that falls with epsilon. In a block of vectors each query keeps those whose upper bound reaches the k-th
largest lower bound; only these are reranked, by cosine in double precision on the original vectors.

Vectors are packed in blocks (codes, scalars, ids, originals). A block of queries meets every block of vectors once: it is
copied to each group of blocks, of which there are two for each full block of vectors, but not more than partitions. What
leaves a pair of blocks is at most k rows per query.

Vectors that are null, zero, of another length than the most frequent one (of equally frequent ones the longest), or hold
null or non-finite components take no part, nor do rows with a null id. Rows of one id count as one candidate with its best score, and never as its own
neighbour. Ties go to the smaller id. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vectors import met
from . import common

BLOCK_DDL = "block long, ids binary, codes binary, scalars binary, vectors binary"


@lru_cache(maxsize=4)
def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, inner products of unit vectors and their unit codes)."""
    turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def usable(df: DataFrame, dim: int | None = None) -> DataFrame:
    big = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)
    own = F.lit(True) if dim is None else F.size("embedding") == dim
    return df.where(F.col("vec_id").isNotNull() & own & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))


def pack(df: DataFrame, dim: int, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors, cut within partitions."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                own = batch.slice(lo, rows)
                vectors = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                codes, scalars = encode(vectors)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), *(pa.array([x.tobytes()], pa.binary()) for x in (own.column(0).to_numpy().astype("<i8"), codes, scalars, vectors))], ["block", "ids", "codes", "scalars", "vectors"])
                seq += 1

    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, BLOCK_DDL)


def _sum_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last: one result for equal rows, everywhere."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def search_block(ids, codes, scalars, vectors, query_ids, queries, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec_id, score) of the k best found in a block for each query, by estimate, bound and rerank."""
    n, d = vectors.shape
    signs = (np.unpackbits(codes, axis=1)[:, :d].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    wide = (epsilon * np.sqrt(np.maximum(0, 1 - scalars**2)) / scalars / np.sqrt(max(1, d - 1))).astype(np.float32)
    spread = k * int(np.unique(ids, return_counts=True)[1].max())
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    goals = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    turned = (goals @ rotation(d)).astype(np.float32)
    who, what = [], []
    for lo in range(0, len(queries), 256):
        guess = (turned[lo : lo + 256] @ signs.T) / scalars.astype(np.float32)
        guess[query_ids[lo : lo + 256][:, None] == ids[None]] = -np.inf
        lower = guess - wide
        floor = np.partition(lower, max(0, n - spread), axis=1)[:, max(0, n - spread)]
        keep = (guess + wide >= floor[:, None]) & (guess > -np.inf)
        for row in range(len(keep)):
            near = np.flatnonzero(keep[row])
            if not len(near):
                continue
            score = (units[near] * goals[lo + row]).sum(axis=1)
            if len(near) > spread:
                near = near[score >= np.partition(score, len(near) - spread)[len(near) - spread] - 1e-9]
            who.append(np.full(len(near), lo + row))
            what.append(near)
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, what = np.concatenate(who), np.concatenate(what)
    score = np.empty(len(who))
    for lo in range(0, len(who), 100_000):
        a, b = queries[who[lo : lo + 100_000]], vectors[what[lo : lo + 100_000]]
        score[lo : lo + 100_000] = np.clip(_sum_in_order(a, b) / np.sqrt(_sum_in_order(a, a) * _sum_in_order(b, b)), -1, 1)
    order = np.lexsort((ids[what], -score, who))
    who, found, score = who[order], ids[what][order], score[order]
    once = np.ones(len(who), bool)
    pairs = np.lexsort((np.arange(len(who)), found, who))
    once[pairs[1:]] = (found[pairs[1:]] != found[pairs[:-1]]) | (who[pairs[1:]] != who[pairs[:-1]])
    who, found, score = who[once], found[once], score[once]
    first = np.r_[True, who[1:] != who[:-1]]
    rank = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
    return query_ids[who[rank < k]], found[rank < k], score[rank < k]


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = 2.0, rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of df found for each row of queries, nearest first."""
    spark = df.sparkSession
    sizes = usable(df).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes.dim if sizes else 0
    if dim < 1:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    groups = max(min(common.partitions(spark), -(-2 * sizes["count"] // rows)), -(-sizes["count"] // 65536))
    blocks = pack(usable(df, dim), dim, rows).withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).drop("block")
    asked = usable(queries, dim).select("vec_id", "embedding")
    n = asked.count()
    asked = pack(asked.repartition(max(1, -(-n // query_rows)), "vec_id"), dim, query_rows)
    asked = asked.select(F.col("ids").alias("q_ids"), "vectors", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def load(kept: list, row: dict) -> None:
        ids = np.frombuffer(row["ids"].as_buffer(), "<i8")
        kept.append((ids, np.frombuffer(row["codes"].as_buffer(), np.uint8).reshape(len(ids), -1), np.frombuffer(row["scalars"].as_buffer()), np.frombuffer(row["vectors"].as_buffer()).reshape(-1, dim)))

    def pair(kept: list, row: dict) -> Iterator:
        import pyarrow as pa

        q_ids, q = np.frombuffer(row["q_ids"].as_buffer(), "<i8"), np.frombuffer(row["vectors"].as_buffer()).reshape(-1, dim)
        for block in kept:
            found = search_block(*block, q_ids, q, k, epsilon)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    found = met(blocks, asked, ["g"], "q_ids", load, pair, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP2_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS "rank", vec_id, score FROM r WHERE n <= 5
"""
