"""Ranked retrieval: lexical (BM25), dense (cosine), reciprocal-rank fusion and same-kind neighbours.

Rankings are rows (qid, doc, score, rank). Scores are rounded to nine places before they are ordered, so that the
order doesn't hang on the order of additions; ties go to the id in string order, in fusion to the corpus position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from . import vectors as blocks


def check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def postings(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, term, tf)."""
    return docs.select(F.col(doc).alias("doc"), F.explode(terms(text)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.size(terms(text)).cast("long").alias("len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, doc: str, text: Column, questions: DataFrame, qid: str, question: Column, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best documents of each question by Okapi BM25; scores must be positive.

    Questions are a set of terms. Only postings of question terms are kept, before they are aggregated, by a join on the
    term; document frequencies come from the same postings. Corpus size and mean length cover every document.
    """
    check(k1 > 0, "k1 must be positive")
    check(0 <= b <= 1, "b must lie in [0, 1]")
    check(k >= 1, "top_k must be at least 1")
    asked = questions.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(terms(question))).alias("term"))
    wanted = asked.select("term").distinct()
    tokens = docs.select(F.col(doc).alias("doc"), terms(text).alias("t"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"))
    stats = stats.select("n", F.coalesce(F.nullif("mean", F.lit(0.0)), F.lit(1.0)).alias("mean"))
    posts = tokens.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).join(wanted, "term").groupBy("doc", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    freq = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(freq, "term").join(F.broadcast(stats)).select("qid", "term", "mean", idf(F.col("n"), F.col("df")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = posts.join(known, "term").groupBy("qid", "doc").agg(F.sum(part).alias("score")).where("score > 0")
    return best(scored, k)


def best(scored: DataFrame, k: int, group: str = "qid") -> DataFrame:
    """Rank by rounded score, ties by the id in string order, and keep k of each group."""
    order = Window.partitionBy(group).orderBy(F.round("score", 9).desc(), F.col("doc").cast("string"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def dense(vectors: DataFrame, doc: str, vector: str, queries: DataFrame, qid: str, query: str, k: int) -> DataFrame:
    """The k nearest vectors of each query by cosine; no threshold. Queries are a stated batch that meets all rows in
    blocks; vectors of another length than the query's are not near it."""
    check(k >= 1, "top_k must be at least 1")
    return best(blocks.nearest(vectors, doc, vector, queries, qid, query, k), k)


def fuse(rankings: list[DataFrame], k: int = 60, doc: str = "doc") -> DataFrame:
    """(qid, doc, score, rank): reciprocal ranks summed over rankings, none cut; ties by position as a number."""
    check(k >= 1, "rrf_k must be at least 1")
    every = rankings[0].select("qid", doc, "rank")
    for other in rankings[1:]:
        every = every.unionByName(other.select("qid", doc, "rank"))
    summed = every.groupBy("qid", doc).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.col(doc))
    return summed.withColumn("rank", F.row_number().over(order).cast("long"))


def neighbour_pairs(entities: DataFrame, entity: str, kind: str, vector: str, k: int, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of one kind where either is among the other's k nearest and the cosine reaches the
    threshold. All entities of a kind meet in blocks, as exact neighbours ask for; a hot kind is dealt over many tasks, and
    only the best of each pair of blocks is shuffled on."""
    check(k >= 1, "neighbour count must be at least 1")
    check(0 <= threshold <= 1, "threshold must lie in [0, 1]")
    near = blocks.nearest(entities, entity, vector, entities, entity, vector, k + 1, kind)  # one place is the entity's own
    near = best(near.where("qid <> doc"), k)
    near = near.where(F.round("score", 9) >= threshold)
    return near.groupBy(F.least("qid", "doc").alias("a"), F.greatest("qid", "doc").alias("b")).agg(F.max("score").alias("similarity"))


def external_seeds(given: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(qid, doc, score, rank): given ids by position, known ones only, each once, scored 1 / rank."""
    check(limit >= 1, "seed_limit must be at least 1")
    first = given.groupBy("qid", "doc").agg(F.min("pos").alias("pos")).join(known, "doc", "left_semi")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("pos")).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "doc", (1.0 / F.col("rank")).alias("score"), "rank")
