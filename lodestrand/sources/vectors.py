"""A cache of vectors keyed by content: hits are joined, only misses are encoded, results are appended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists

Encoder = Callable[[list[str]], np.ndarray]
SCHEMA = "model string, revision string, strategy string, content_sha256 string, vector array<float>"


def hashing_encoder(dim: int = 64) -> Encoder:
    """Default encoder: signed feature hashing of lower-case words, unit length. It needs no model and claims no quality."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 - 2 * (h >> 31)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def cached_vectors(spark: SparkSession, texts: DataFrame, path: str, encoder: Encoder, model: str, revision: str = "", strategy: str = "whole") -> DataFrame:
    """texts (id, text) with their vectors; encodes what the cache at path lacks and appends it there."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    wanted = texts.withColumn("content_sha256", key)
    cache = spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)
    own = cache.where((F.col("model") == model) & (F.col("revision") == revision) & (F.col("strategy") == strategy)).select("content_sha256", "vector")
    misses = wanted.select("content_sha256", "text").dropDuplicates(["content_sha256"]).join(own, "content_sha256", "left_anti")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            vectors = encoder([t or "" for t in frame["text"]])
            yield pd.DataFrame({"model": model, "revision": revision, "strategy": strategy, "content_sha256": frame["content_sha256"], "vector": list(vectors)})

    misses.mapInPandas(run, SCHEMA).write.mode("append").parquet(path)
    fresh = spark.read.schema(SCHEMA).parquet(path).where((F.col("model") == model) & (F.col("revision") == revision) & (F.col("strategy") == strategy)).select("content_sha256", "vector").dropDuplicates(["content_sha256"])
    return wanted.join(fresh, "content_sha256")
