"""Word windows over texts: overlapping chunks, pages to passages, encoder windows and pooled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import passage_id, words


def window_starts(n: Column, size: int, overlap: int, early_stop: bool = True) -> Column:
    """Starts 0, step, 2 step, ... below n; with early_stop none behind a window that reaches the end."""
    size = max(1, size)
    step = size - min(max(0, overlap), size - 1)
    all_ = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(all_, lambda s: (s == 0) | (s - step + size < n)) if early_stop else all_


def chunks(df: DataFrame, text: str, size: int, overlap: int, early_stop: bool = True) -> DataFrame:
    """A row per window: chunk_index, start and chunk_text beside the other columns. Empty texts give none."""
    size, step = max(1, size), max(1, size) - min(max(0, overlap), max(1, size) - 1)
    split = df.withColumn("_w", words(text))
    out = split.withColumn("start", F.explode(window_starts(F.size("_w"), size, overlap, early_stop)))
    out = out.withColumns({"chunk_index": (F.col("start") / step).cast("int"), "chunk_text": F.array_join(F.slice("_w", F.col("start") + 1, F.lit(size)), " ")})
    return out.drop("_w")


def encoder_windows(df: DataFrame, text: str, size: int) -> DataFrame:
    """Windows that overlap by min(64, size // 4), to the end of the text; one window where it fits, blank ones dropped."""
    fits = F.size(words(text)) <= size
    long_ = chunks(df.where(~fits), text, size, min(64, size // 4), early_stop=False)
    short = df.where(fits & (F.size(words(text)) > 0)).withColumns({"start": F.lit(0), "chunk_index": F.lit(0), "chunk_text": F.array_join(words(text), " ")})
    return long_.unionByName(short).where(F.trim("chunk_text") != "")


def passages(pages: DataFrame, paper: str, page: str, text: str, size: int, overlap: int) -> DataFrame:
    """Chunks of each page with page_chunk_index, the paper-wide chunk_index and a content id."""
    cut = chunks(pages, text, size, overlap).withColumnRenamed("chunk_index", "page_chunk_index")
    order = Window.partitionBy(paper).orderBy(page, "start")
    cut = cut.withColumn("chunk_index", F.row_number().over(order) - 1)
    return cut.withColumn("id", passage_id(F.col(paper).cast("string"), F.col(page), F.col("chunk_index"), F.col("chunk_text")))


def pooled(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, value): the unit-length mean of each key's vectors; averaging combines map-side by (key, dim)."""
    each = vectors.select(key, F.posexplode(vector).alias("dim", "v")).groupBy(key, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    norm = each.groupBy(key).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return each.join(norm, key).select(key, "dim", (F.col("mean") / F.greatest("norm", F.lit(1e-12))).alias("value"))
