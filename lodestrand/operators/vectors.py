"""Exact nearest vectors in blocks: unit vectors are packed once, blocks meet in the cells of a grid, and a matrix product gives
all cosines of a pair of blocks. What leaves a pair is at most the k best of each query (and ties), so no pair is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def met(right: DataFrame, left: DataFrame, cell: list[str], asked: str, load: Callable, pair: Callable, out: T.StructType | str) -> DataFrame:
    """What ``pair(kept, row)`` yields for each row of left, ``kept`` being what ``load(kept, row)`` made of the right rows of
    its cell. A cell's rows go to one task, right ones (those where ``asked`` is null) first; only these are held there. This
    is no join, as a planner that doesn't see how often rows are repeated would send a whole side through the driver."""
    groups = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = right.unionByName(left, allowMissingColumns=True)
    names = [*cell, asked, *(c for c in both.columns if c not in (*cell, asked))]

    def run(batches: Iterator) -> Iterator:
        now, kept = None, []
        for batch in batches:
            place = {name: batch.column(i) for i, name in enumerate(names)}
            for i in range(batch.num_rows):
                row = {name: column[i] for name, column in place.items()}
                if (own := repr([row[c].as_py() for c in cell])) != now:
                    now, kept = own, []
                if row[asked].is_valid:
                    yield from pair(kept, row)
                else:
                    load(kept, row)

    return both.select(*names).repartition(groups, *cell).sortWithinPartitions(*cell, F.col(asked).isNotNull()).mapInArrow(run, out)


def packed(df: DataFrame, key: str, kind: str | None, vector: str, rows: int) -> DataFrame:
    """(kind, dim, ids, vectors): blocks of at most ``rows`` unit vectors of one kind and length, cut within partitions, so
    that a hot kind is many blocks. Null vectors are left out; a zero vector stays zero."""
    own = df.select(F.col(key).alias("id"), (F.col(kind) if kind else F.lit(0)).alias("kind"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    kinds = dict((f.name, f.dataType) for f in own.schema)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            code = batch.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[True, (size[1:] != size[:-1]) | (code[1:] != code[:-1])]) if len(size) else np.zeros(0, int)
            for first, last in zip(new, np.r_[new[1:], len(size)], strict=True):
                for lo in range(int(first), int(last), rows):
                    part = batch.slice(lo, min(rows, int(last) - lo))
                    x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([part.column(1).slice(0, 1), pa.array([x.shape[1]], pa.int32()), ids, pa.array([x.tobytes()], pa.binary())], ["kind", "dim", "ids", "vectors"])

    out = T.StructType([T.StructField("kind", kinds["kind"]), T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("vectors", T.BinaryType())])
    return own.sortWithinPartitions("kind", F.size("v")).mapInArrow(run, out)


def _sides(df: DataFrame, kind: str | None, vector: str, count: str) -> DataFrame:
    """(kind, dim, count) of the rows that packed keeps."""
    own = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    return own.groupBy((F.col(kind) if kind else F.lit(0)).alias("kind"), F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias(count))


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, qid: str, query: str, k: int, kind: str | None = None, rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """(qid, doc, score): for each query at least its k rows of the largest cosine, of its own kind if one is named.
    Candidates for a rank: ties at the k-th place are all there. Rows equal to the query's id count; drop them behind.

    The rows and the queries of a kind are dealt over a grid by blocks, and each cell is a part of the work: a row is copied
    once for each column of the grid, a query once for each line. Either side has a part for a block's rows, but not more
    than the root of the number of partitions, unless parts would exceed 65,536 rows; kinds of one block aren't copied."""
    right, left = packed(df, key, kind, vector, rows), packed(queries, qid, kind, query, query_rows).withColumnRenamed("ids", "q_ids")
    sides = _sides(df, kind, vector, "n").join(_sides(queries, kind, query, "m"), ["kind", "dim"])
    most = isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1
    share = lambda n, rows: F.least(F.ceil(F.col(n) / rows), F.greatest(F.lit(most), F.ceil(F.col(n) / 65536))).cast("int")
    large = F.broadcast(sides.where((F.col("n") > rows) | (F.col("m") > query_rows)).select("kind", "dim", share("n", rows).alias("n_r"), share("m", query_rows).alias("n_c")))
    place = lambda ids, n: F.pmod(F.xxhash64(F.element_at(ids, 1)), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    right = right.join(large, ["kind", "dim"], "left").select("kind", "dim", "ids", "vectors", place("ids", "n_r").alias("r"), every("n_c").alias("c")).where("kind is not null")
    left = left.join(large, ["kind", "dim"], "left").select("kind", "dim", "q_ids", "vectors", place("q_ids", "n_c").alias("c"), every("n_r").alias("r")).where("kind is not null")
    kinds = queries.schema[qid].dataType, df.schema[key].dataType

    def load(kept: list, row: dict) -> None:
        import numpy as np
        import pyarrow as pa

        ids, v = row["ids"].values, np.frombuffer(row["vectors"].as_buffer()).reshape(-1, row["dim"].as_py())
        if kept and len(kept[-1][0]) + len(ids) <= rows:
            ids, v = pa.concat_arrays([kept[-1][0], ids]), np.concatenate([kept.pop()[1], v])
        kept.append((ids, v))

    def pair(kept: list, row: dict) -> Iterator:
        import numpy as np
        import pyarrow as pa

        q_ids, q = row["q_ids"].values, np.frombuffer(row["vectors"].as_buffer()).reshape(-1, row["dim"].as_py())
        for ids, v in kept:
            score = q @ v.T
            near = np.ones(score.shape, bool)
            if score.shape[1] > k:
                near = score >= np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None] - 1e-9
            who, what = np.nonzero(near & ~np.isnan(score))
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(who)), ids.take(pa.array(what)), pa.array(score[who, what])], ["qid", "doc", "score"])

    out = T.StructType([T.StructField("qid", kinds[0]), T.StructField("doc", kinds[1]), T.StructField("score", T.DoubleType())])
    return met(right, left, ["kind", "dim", "r", "c"], "q_ids", load, pair, out)
