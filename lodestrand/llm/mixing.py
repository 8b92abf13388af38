"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated probability.

Documents fall in cells of source, language and topic. The cells' token counts are raked: each sweep scales them to the
target tokens of every source, then of every language, then of every topic. A document's ratio is its cell's raked over
its counted tokens. It is kept with probability min(1, share * ratio), by a hash of its id, and carries as weight what
the cap cuts off (share * ratio / probability), so that weighted tokens of the sample meet the targets in expectation.
Where no weight is carried on, copies stand for it: the whole part of share * ratio, and one more with the rest as
probability, so that plain tokens meet the targets.

Sweeps end when every marginal is
within a ten-thousandth of its target. All of it is DataFrame expressions: sums meet by partial aggregation, marginals join the cells, and no step gathers
documents of a cell. Targets default to the tempered shares of the table itself (``temper`` = 0 makes them equal, 1
leaves them); categories without a given target keep their own.

Null source, language and topic are the category ``unknown``; texts without a word are no tokens, belong to cells as they
are and follow their ratio (1 if their whole cell is empty). Repeated rows share their fate. Extra columns pass through;
the result columns are replaced if there. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^ \t\n\r]+"
#: Sweeps end once every marginal is this near to its target, or after so many where empty cells keep them from it.
TOLERANCE, SWEEPS = 1e-4, 200
#: Topic rules over the text, the first that fits: fixed here for the registered query; any column can be raked instead.
TOPICS = (("legal", r"[Ll]icen[sc]ed? |[Cc]opyright"), ("config", r"token = |key = "), ("records", r"[0-9]"))


def topic_of(text: Column) -> Column:
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def described(docs: DataFrame, text: str = "text", topic: Column | None = None) -> DataFrame:
    """docs with the cell columns _source, _lang, _topic and _tokens."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return docs.withColumns({"_source": known(F.col("source")), "_lang": known(F.col("lang")), "_topic": known(topic_of(F.col(text)) if topic is None else topic), "_tokens": tokens_of(F.col(text))})


def targets(cells: DataFrame, dimension: str, temper: float = 0.5, given: dict[str, float] | None = None) -> DataFrame:
    """(dimension, target): the tokens that each category is to weigh. ``given`` are shares by category."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("own"))
    share = F.when(F.col("own") > 0, F.pow(F.col("own"), F.lit(temper))).otherwise(0.0)
    if given:
        named = F.create_map(*[F.lit(x) for pair in sorted(given.items()) for x in pair])
        total = sums.agg(F.sum("own").alias("all"))
        return sums.join(F.broadcast(total)).select(dimension, F.coalesce(named[F.col(dimension)] * F.col("all"), F.col("own")).alias("target"))
    sums = sums.withColumn("part", share)
    total = sums.agg(F.sum("own").alias("all"), F.sum("part").alias("parts"))
    return sums.join(F.broadcast(total)).select(dimension, (F.col("part") / F.col("parts") * F.col("all")).alias("target"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float = TOLERANCE, most: int = SWEEPS) -> DataFrame:
    """cells (…, tokens) with w, raked to the goals; written out once a sweep. Sweeps end once no marginal is off its
    target by more than ``tolerance`` of it, or after ``most`` where empty cells leave the targets out of reach."""
    columns = [*cells.columns, "w"]
    for dimension, goal in goals.items():
        cells = cells.join(goal.withColumnRenamed("target", f"t{dimension}"), dimension)
    cells = common.materialize(cells.withColumn("w", F.col("tokens").cast("double")), "raked")
    for _ in range(most):
        before = cells
        for dimension in goals:
            sums = cells.groupBy(dimension).agg(F.sum("w").alias("mass"))
            cells = cells.join(sums, dimension).withColumn("w", F.col("w") * F.when(F.col("mass") > 0, F.col(f"t{dimension}") / F.col("mass")).otherwise(0.0)).drop("mass")
        cells = common.materialize(cells, "raked", [before])
        off = [cells.groupBy(d).agg(F.sum("w").alias("mass"), F.first(f"t{d}").alias("goal")).where("mass > 0").select(F.abs(F.col("mass") / F.col("goal") - 1).alias("off")) for d in list(goals)[:-1]]
        off = reduce(DataFrame.union, off).agg(F.max("off")).first()[0] if off else 0.0
        if off is None or off <= tolerance:
            break
    return cells.select(*columns)


def weigh(docs: DataFrame, share: float = 0.5, temper: float = 0.5, seed: str = "mix", given: dict[str, dict[str, float]] | None = None, text: str = "text", wide: DataFrame | None = None) -> DataFrame:
    """docs (as described) with weight, probability, kept and copies. ``wide`` is what gets the columns, if not docs."""
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = common.materialize(docs.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), "cells")
    goals = {f"_{d}": common.materialize(targets(cells, f"_{d}", temper, (given or {}).get(d)), "goal") for d in DIMENSIONS}
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)
    raked = rake(cells, goals).select(*keys, (F.lit(share) * ratio).alias("_rate"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    probability = F.least(F.lit(1.0), F.col("_rate"))
    wide = docs if wide is None else wide
    out = wide.join(raked, keys)
    return out.withColumns({"weight": F.when(probability > 0, F.col("_rate") / probability).otherwise(0.0), "probability": probability, "kept": draw < probability, "copies": (F.floor("_rate") + (draw < F.col("_rate") - F.floor("_rate")).cast("int")).cast("int")}).drop("_rate")


def sampled(docs: DataFrame, repeated: bool = False, **options) -> DataFrame:
    """The documents that sampling keeps, with their own columns; ``repeated`` gives as many rows of each as its copies."""
    row = F.struct(*docs.columns).alias("_row")
    full = described(docs.select(row, "doc_id", "text", "source", "lang"))
    slim = common.materialize(full.select("_source", "_lang", "_topic", "_tokens"), "described")
    out = weigh(slim, wide=full, **options)
    if repeated:
        return out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
    return out.where("kept").select("_row.*")


def op9_mixture(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    slim = common.materialize(described(docs).select("doc_id", "_source", "_lang", "_topic", "_tokens"), "described")
    out = weigh(slim)
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def _sql(share: float = 0.5, temper: float = 0.5, seed: str = "mix") -> str:
    topic = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  coalesce(CASE WHEN text IS NULL THEN NULL {topic} ELSE 'prose' END, 'unknown') AS topic,
  CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for x in DIMENSIONS:
        parts.append(f"g_{x} AS (SELECT {x}, CASE WHEN own > 0 THEN pow(own, {temper}) ELSE 0 END / sum(CASE WHEN own > 0 THEN pow(own, {temper}) ELSE 0 END) OVER () * sum(own) OVER () AS t_{x} FROM (SELECT {x}, sum(tokens) AS own FROM c GROUP BY 1))")
    goals = ", ".join(f"t_{x}" for x in DIMENSIONS)
    inner = "(SELECT * FROM r WHERE off > {0} AND k < {1})".format(TOLERANCE, SWEEPS)
    for x in DIMENSIONS:
        inner = f"(SELECT * REPLACE (CASE WHEN mass > 0 THEN w * t_{x} / mass ELSE 0 END AS w) FROM (SELECT k, source, lang, topic, tokens, {goals}, off, w, sum(w) OVER (PARTITION BY {x}) AS mass FROM {inner}))"
    off = "greatest(" + ", ".join(f"CASE WHEN m_{x} > 0 THEN abs(m_{x} / t_{x} - 1) ELSE 0 END" for x in DIMENSIONS[:-1]) + ")"
    sums = ", ".join(f"sum(w) OVER (PARTITION BY {x}) AS m_{x}" for x in DIMENSIONS[:-1])
    sweep = f"SELECT k + 1, source, lang, topic, tokens, {goals}, max({off}) OVER () AS off, w FROM (SELECT *, {sums} FROM {inner})"
    return f"""WITH RECURSIVE {", ".join(parts)},
r AS (SELECT 0 AS k, source, lang, topic, tokens, {goals}, CAST(1e9 AS DOUBLE) AS off, tokens AS w
  FROM c {" ".join(f"JOIN g_{x} USING ({x})" for x in DIMENSIONS)}
  UNION ALL {sweep}),
f AS (SELECT * FROM r WHERE k = (SELECT max(k) FROM r)),
p AS (SELECT d.*, {share} * CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS rate,
  CAST(('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS draw
  FROM d JOIN f USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN rate > 0 THEN rate / least(1.0, rate) ELSE 0 END, 6) AS weight,
  round(least(1.0, rate), 6) AS probability, draw < least(1.0, rate) AS kept FROM p"""


OP9_SQL = _sql()
