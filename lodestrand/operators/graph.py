"""Bounded expansion over a property graph, level by level.

A queue that admits neighbours in the order (predicate, neighbour, edge) under a cap is the same as whole levels ordered by
(parent's position, predicate, neighbour, edge): the cap only cuts the admission sequence. Hops are few, so the loop over
levels is on the driver; every level is one join of the frontier with the adjacency, written to the checkpoint folder, so
that the next one neither repeats it nor the search for seeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .ranking import check


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of (edge_id, subject_id, predicate, object_id, confidence): v, predicate, u, edge_id, conf."""
    conf = F.coalesce("confidence", F.lit(1.0)).alias("conf")
    out = edges.select(F.col("subject_id").alias("v"), "predicate", F.col("object_id").alias("u"), "edge_id", conf)
    return out.unionByName(edges.select(F.col("object_id").alias("v"), "predicate", F.col("subject_id").alias("u"), "edge_id", conf))


def expand(seeds: DataFrame, adjacent: DataFrame, hops: int = 2, max_nodes: int = 100) -> DataFrame:
    """(qid, v, depth, score, pos): nodes admitted from seeds (qid, doc, score, rank), in admission order.

    A neighbour enters if its score, half the parent's times the edge's confidence, is positive, it was not seen and
    the cap leaves room; the first edge that admits it sets its score.
    """
    check(hops >= 0, "hops must be at least 0")
    check(max_nodes >= 1, "max_nodes must be at least 1")
    visited = cut(seeds.where(F.col("rank") <= max_nodes)).select("qid", F.col("doc").alias("v"), F.lit(0).alias("depth"), "score", F.col("rank").alias("pos"))
    frontier = visited
    for depth in range(1, hops + 1):
        step = frontier.join(adjacent, "v").withColumn("next", F.col("score") * F.col("conf") * 0.5).where("next > 0")
        step = step.join(visited.select("qid", F.col("v").alias("u")), ["qid", "u"], "left_anti")
        order = [F.col("pos"), F.col("predicate"), F.col("u"), F.col("edge_id")]
        first = step.groupBy("qid", "u").agg(F.min(F.struct("pos", "predicate", "u", "edge_id", "next")).alias("f"))
        taken = visited.groupBy("qid").agg(F.count(F.lit(1)).alias("taken"))
        ranked = first.select("qid", "f.*").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
        new = ranked.join(taken, "qid").withColumn("at", F.col("taken") + F.col("n")).where(F.col("at") <= max_nodes)
        frontier = new.select("qid", F.col("u").alias("v"), F.lit(depth).alias("depth"), F.col("next").alias("score"), F.col("at").cast("long").alias("pos"))
        frontier = cut(frontier)
        visited = visited.unionByName(frontier)
    return visited


def chunk_scores(visited: DataFrame, node_chunks: DataFrame, evidence: DataFrame, max_chunks: int = 30) -> DataFrame:
    """(qid, doc, score, rank): each chunk's best contribution from admitted nodes, their own chunks (v, chunk) and the
    evidence (v, chunk, conf) of all their edges, reached or not. A score of 0 still counts."""
    check(max_chunks >= 1, "max_chunks must be at least 1")
    base = visited.select("qid", "v", (F.col("score") / (F.col("depth") + 1)).alias("s"))
    own = base.join(node_chunks, "v").select("qid", F.col("chunk").alias("doc"), F.col("s").alias("score"))
    seen = base.join(evidence, "v").select("qid", F.col("chunk").alias("doc"), (F.col("s") * F.col("conf")).alias("score"))
    top = own.unionByName(seen).groupBy("qid", "doc").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.col("doc").cast("string"))
    return top.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max_chunks)
