"""Question records and their paragraphs: normal form, supporting ids, flattening with duplicates merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(records: DataFrame) -> DataFrame:
    """(qid, supports, hop_count) of records (qid, decomposition, paragraphs): supports are those that the steps of the
    decomposition name, each once and in order, else the paragraphs marked as supporting; hops are the steps, else the
    supports. A record without a hop, or with a support that is no paragraph, fails."""
    steps = F.coalesce("decomposition", F.array().cast("array<struct<support:array<bigint>>>"))
    named = F.array_distinct(F.flatten(F.transform(steps, lambda d: d["support"])))
    marked = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: p["idx"])
    supports = F.when(F.size(steps) > 0, named).otherwise(marked)
    out = records.select("qid", supports.alias("supports"), steps.alias("_steps"), F.transform("paragraphs", lambda p: p["idx"]).alias("_known"))
    hops = F.when(F.size("_steps") > 0, F.size("_steps")).otherwise(F.size("supports"))
    bad = (hops < 1) | (F.size(F.array_except("supports", "_known")) > 0)
    failed = F.raise_error(F.concat(F.lit("no support, or no such paragraph: "), F.col("qid").cast("string"))).cast("int")
    return out.select("qid", "supports", F.when(bad, failed).otherwise(hops).alias("hop_count"))


def supporting_ids(paragraphs: Column, passages: Column) -> Column:
    """The paragraph ids, else the passage ids, each once, as strings."""
    return F.array_distinct(F.coalesce(paragraphs.cast("array<string>"), passages.cast("array<string>")))


def track(questions: DataFrame, passages: str = "supporting_passage_ids") -> DataFrame:
    """(track): domain if any question names passages, else public."""
    return questions.agg(F.when(F.coalesce(F.bool_or(F.col(passages).isNotNull()), F.lit(False)), "domain").otherwise("public").alias("track"))


def flattened(records: DataFrame, content_id: Column) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, supports) of records (qid, paragraphs): each content once, from the question and place that come first; and
    for which questions it is a support, a row each, as a common paragraph may support any number."""
    rows = records.select("qid", F.posexplode("paragraphs").alias("pos", "p")).select("qid", "pos", "p.*").withColumn("id", content_id)
    first = rows.groupBy("id").agg(F.min(F.struct("qid", "pos")).alias("f")).select("id", F.col("f.qid").alias("qid"), F.col("f.pos").alias("pos"))
    return first, rows.where("is_supporting").select("id", "qid").distinct()
