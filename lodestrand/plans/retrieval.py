"""Registered queries over rankings: lexical, dense, fused, graph expansion, hybrids and their recall.

Questions are benchmark items (first twelve terms), gold documents those that contain the item's text. The property graph is
parts (methods) that are evaluated on suppliers (datasets), evidence chunks are orders; its questions are part names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, graph, ranking, substrings
from ..storage import cut
from .corpus import TOK, _questions, load


def gold_pairs(spark, sf) -> DataFrame:
    """(qid, doc): documents that contain an item's whole text. Documents meet items by a key that any containing text must
    hold too, and only those pairs are compared: a run of up to five inner terms as they are written, or, for an item under
    three terms, which has no inner one, its first bytes, up to eight. The lengths that occur among the items are few, and
    documents give only runs of those lengths; the different first bytes of short items go through the driver."""
    found = F.regexp_extract_all("text", F.lit(tx.TERM), F.lit(1))
    items = load(spark, sf, "benchmark", "item_id", "text").where("text is not null").select(F.col("item_id").alias("qid"), F.col("text").alias("item"), found.alias("t"))
    docs = load(spark, sf, "documents", "doc_id", "text")
    keyed = items.where(F.size("t") >= 3).withColumn("n", F.least(F.lit(5), F.size("t") - 2)).select("qid", "n", F.array_join(F.slice("t", F.lit(2), F.col("n")), " ").alias("key"))
    t = docs.select("doc_id", found.alias("t")).join(F.broadcast(keyed.select("n").distinct()), F.size("t") >= F.col("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1), lambda i: F.array_join(F.slice("t", i, F.col("n")), " "))
    hits = t.select("doc_id", F.explode(F.array_distinct(runs)).alias("key")).join(keyed.select("qid", "key"), "key").select("doc_id", "qid")
    short = items.where(F.size("t") < 3).select("qid", F.substring(F.col("item").cast("binary"), 1, substrings.WIDTH).alias("start"))
    if wanted := [bytes(r.start) for r in short.select("start").distinct().collect()]:
        hits = hits.unionByName(substrings.holding(docs, "doc_id", "text", wanted).join(short, "start").select("doc_id", "qid"))
    return hits.distinct().join(items.select("qid", "item"), "qid").join(docs, "doc_id").where(F.contains("text", F.col("item"))).select("qid", F.col("doc_id").alias("doc"))


def _lexical(spark, sf, k):
    docs = load(spark, sf, "documents", "doc_id", "source", "text")
    text = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    return ranking.bm25(docs, "doc_id", text, _questions(spark, sf), "qid", F.col("question"), k)


def _rows(df):
    return df.select("qid", "doc", "rank", F.round("score", 6).alias("score"))


def bm25_topk(spark, sf):
    return _rows(_lexical(spark, sf, 5))


def bm25_idf_stats(spark, sf):
    docs = load(spark, sf, "documents", "doc_id", "text")
    stats = ranking.lengths(docs, "doc_id", F.col("text")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("mean"))
    df = ranking.postings(docs, "doc_id", F.col("text")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return df.join(F.broadcast(stats)).select("term", "df", "tf", F.round("mean", 6).alias("mean_len"), F.round(ranking.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _dense(spark, sf, k):
    v = load(spark, sf, "embeddings", "vec_id", "embedding")
    return ranking.dense(v, "vec_id", "embedding", v.where("vec_id % 20 = 0"), "vec_id", "embedding", k)


def dense_topk(spark, sf):
    return _rows(_dense(spark, sf, 5))


def _two(spark, sf):
    """Two dense views of the same queries: whole vectors and their first half."""
    v = load(spark, sf, "embeddings", "vec_id", "embedding").withColumn("half", F.slice("embedding", 1, 32))
    q = v.where("vec_id % 20 = 0")
    return ranking.dense(v, "vec_id", "embedding", q, "vec_id", "embedding", 50), ranking.dense(v, "vec_id", "half", q, "vec_id", "half", 50)


def rrf_two_way(spark, sf):
    return ranking.fuse(list(_two(spark, sf))).where("rank <= 10").select("qid", "doc", "rank", F.round("score", 9).alias("score"))


def rrf_three_way(spark, sf):
    v = load(spark, sf, "embeddings", "vec_id", "embedding").withColumn("tail", F.slice("embedding", 33, 32))
    third = ranking.dense(v, "vec_id", "tail", v.where("vec_id % 20 = 0"), "vec_id", "tail", 50)
    return ranking.fuse([*_two(spark, sf), third]).where("rank <= 10").select("qid", "doc", "rank", F.round("score", 9).alias("score"))


def _nodes(spark, sf):
    parts = load(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Method").alias("kind"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"))
    sup = load(spark, sf, "supplier", "s_suppkey", "s_name").select(F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("Dataset").alias("kind"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return parts.unionByName(sup)


def _evidence(spark, sf):
    """(edge_id, subject_id, predicate, object_id, chunk_id, confidence): one row per edge and order, the best confidence. A
    returned line is a second relation between the same two."""
    line = load(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_returnflag")
    s, o = F.concat(F.lit("m"), F.col("l_partkey").cast("string")), F.concat(F.lit("d"), F.col("l_suppkey").cast("string"))
    predicate = F.when(F.col("l_returnflag") == "R", "USES").otherwise("EVALUATES_ON")
    rows = line.select(s.alias("subject_id"), predicate.alias("predicate"), o.alias("object_id"), F.col("l_orderkey").alias("chunk_id"), F.round(1 - F.col("l_discount"), 4).alias("confidence"))
    best = rows.groupBy("subject_id", "predicate", "object_id", "chunk_id").agg(F.max("confidence").alias("confidence"))
    return best.select(F.concat_ws("-", "subject_id", F.substring("predicate", 1, 1), "object_id").alias("edge_id"), "subject_id", "predicate", "object_id", "chunk_id", "confidence")


def _edges(evidence):
    return evidence.groupBy("edge_id", "subject_id", "predicate", "object_id").agg(F.max("confidence").alias("confidence"))


def _names(spark, sf):
    return load(spark, sf, "part", "p_name").distinct().select(F.col("p_name").alias("qid"), F.col("p_name").alias("question"))


def _seeds(spark, sf, k, questions=None):
    nodes = _nodes(spark, sf)
    text = F.concat_ws(" ", "name", F.array_join("aliases", " "))
    return ranking.bm25(nodes, "id", text, _names(spark, sf) if questions is None else questions, "qid", F.col("question"), k)


def entity_seeds(spark, sf):
    return _rows(_seeds(spark, sf, 3))


def external_seeds(spark, sf):
    b = load(spark, sf, "benchmark", "item_id")
    given = b.select(F.col("item_id").alias("qid"), F.posexplode(F.array(*(F.concat(F.lit("d"), (F.col("item_id") * m % 130).cast("string")) for m in (7, 11, 7, 13, 3)))).alias("pos", "doc"))
    return ranking.external_seeds(given, _nodes(spark, sf).select(F.col("id").alias("doc")), 3).select("qid", "doc", "rank", F.round("score", 6).alias("score"))


def _sources(spark, sf):
    """(v, chunk): the first order that names a part is the chunk that the part's node comes from."""
    return load(spark, sf, "lineitem", "l_orderkey", "l_partkey").groupBy("l_partkey").agg(F.min("l_orderkey").alias("chunk")).select(F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("v"), "chunk")


def _touching(evidence):
    ends = [evidence.select(F.col(end).alias("v"), F.col("chunk_id").alias("chunk"), F.col("confidence").alias("conf")) for end in ("subject_id", "object_id")]
    return ends[0].unionByName(ends[1])


def _expanded(spark, sf, hops, seed_limit=2, max_nodes=100, max_chunks=30, seeds=None, evidence=None):
    evidence = cut(_evidence(spark, sf)) if evidence is None else evidence
    seeds = _seeds(spark, sf, seed_limit) if seeds is None else seeds
    visited = graph.expand(seeds, graph.adjacency(_edges(evidence)), hops, max_nodes)
    return visited, graph.chunk_scores(visited, _sources(spark, sf), _touching(evidence), max_chunks)


def graph_expand_1hop(spark, sf):
    visited, _ = _expanded(spark, sf, 1)
    return visited.select("qid", F.col("v").alias("node"), F.col("depth").cast("long").alias("depth"), F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


def graph_expand_2hop(spark, sf):
    visited, _ = _expanded(spark, sf, 2)
    return visited.select("qid", F.col("v").alias("node"), F.col("depth").cast("long").alias("depth"), F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


def graph_chunks_2hop(spark, sf):
    return _rows(_expanded(spark, sf, 2)[1])


def _order_texts(spark, sf):
    """Orders as passages: their text is the names of their parts."""
    line = load(spark, sf, "lineitem", "l_orderkey", "l_partkey").join(load(spark, sf, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return line.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("p_name")), " ").alias("text"))


def _order_lexical(spark, sf, k):
    return ranking.bm25(cut(_order_texts(spark, sf)), "l_orderkey", F.col("text"), _names(spark, sf), "qid", F.col("question"), k)


def hybrid_bm25_graph(spark, sf):
    _, chunks = _expanded(spark, sf, 1)
    fused = ranking.fuse([_order_lexical(spark, sf, 50), chunks])
    return fused.where("rank <= 5").select("qid", "doc", "rank", F.round("score", 9).alias("score"))


# fixed values: the names of the retrieval variants, and the rankings that each fuses
VARIANTS = {
    "bm25": ("bm25",),
    "graph": ("graph",),
    "bm25_graph_rrf": ("bm25", "graph"),
    "dense": ("dense",),
    "bm25_dense_rrf": ("bm25", "dense"),
    "bm25_dense_graph_rrf": ("bm25", "dense", "graph"),
    "dense_entity_graph": ("entity",),
    "bm25_dense_entity_graph_rrf": ("bm25", "dense", "entity"),
}


def _vectors(spark, sf, keyed):
    """keyed (id, n) with a vector of the embeddings table: the one whose vec_id is n modulo their number."""
    v = load(spark, sf, "embeddings", "vec_id", "embedding")
    total = v.agg(F.count(F.lit(1)).alias("_all"))
    return keyed.join(F.broadcast(total)).withColumn("vec_id", F.pmod(F.col("n"), F.col("_all"))).join(v, "vec_id").select("id", "embedding")


def _name_vectors(spark, sf):
    return _vectors(spark, sf, load(spark, sf, "part", "p_partkey", "p_name").groupBy(F.col("p_name").alias("id")).agg(F.min("p_partkey").alias("n")))


def _order_vectors(spark, sf):
    return _vectors(spark, sf, load(spark, sf, "lineitem", "l_orderkey").distinct().select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("n")))


def _order_dense(spark, sf, k):
    return ranking.dense(_order_vectors(spark, sf), "id", "embedding", _name_vectors(spark, sf), "id", "embedding", k)


def _entity_seeds(spark, sf, k):
    """The entities whose vectors are nearest to a question's, as seeds by rank."""
    number = F.substring("id", 2, 20).cast("long")
    nodes = _nodes(spark, sf).select("id", F.when(F.col("kind") == "Method", number).otherwise(number * 7).alias("n"))
    near = ranking.dense(_vectors(spark, sf, nodes), "id", "embedding", _name_vectors(spark, sf), "id", "embedding", k)
    return ranking.external_seeds(near.select("qid", "doc", F.col("rank").alias("pos")), _nodes(spark, sf).select(F.col("id").alias("doc")), k)


def _legs(spark, sf):
    """(leg, qid, doc, rank): the rankings that variants fuse, each computed once."""
    evidence = cut(_evidence(spark, sf))
    parts = {
        "bm25": _order_lexical(spark, sf, 50),
        "dense": _order_dense(spark, sf, 50),
        "graph": _expanded(spark, sf, 1, evidence=evidence)[1],
        "entity": _expanded(spark, sf, 1, seeds=_entity_seeds(spark, sf, 3), evidence=evidence)[1],
    }
    return reduce(DataFrame.unionByName, (r.select(F.lit(name).alias("leg"), "qid", "doc", "rank") for name, r in parts.items()))


def _variant_rankings(spark, sf):
    """(variant, qid, doc, rank) of all variants in one grouping."""
    pairs = spark.createDataFrame([(v, leg) for v, legs in VARIANTS.items() for leg in legs], "variant string, leg string")
    tagged = _legs(spark, sf).join(F.broadcast(pairs), "leg").select(F.struct("variant", "qid").alias("qid"), "doc", "rank")
    return ranking.fuse([tagged]).select("qid.variant", "qid.qid", "doc", "rank")


def _order_gold(spark, sf):
    """(qid, doc): orders with a full line of a part of the name."""
    line = load(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity").where("l_quantity >= 50")
    return line.join(load(spark, sf, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("qid"), F.col("l_orderkey").alias("doc")).distinct()


def _variant_recalls(spark, sf):
    gold = _order_gold(spark, sf)
    asked = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).withColumn("hop_count", (1 + F.length("qid") % 3).cast("long"))
    hits = _variant_rankings(spark, sf).where("rank <= 10").join(gold, ["qid", "doc"]).groupBy("variant", "qid").agg(F.count(F.lit(1)).alias("hits"))
    every = asked.join(spark.createDataFrame([(v,) for v in VARIANTS], "variant string")).join(hits, ["variant", "qid"], "left")
    return every.select("variant", "qid", "hop_count", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def _variant_means(spark, sf):
    both = _variant_recalls(spark, sf).select("variant", F.explode(F.array(F.lit(0).cast("long"), "hop_count")).alias("hop"), "recall")
    return both.groupBy("variant", "hop").agg(F.count(F.lit(1)).alias("questions"), F.avg("recall").alias("mean"))


def variant_matrix_recall(spark, sf):
    return _variant_means(spark, sf).select("variant", "hop", "questions", F.round("mean", 6).alias("recall"))


def variant_report(spark, sf):
    r = evaluation.report(_variant_means(spark, sf), [1, 2, 3])
    return r.select("variant", *(F.round(c, 6).alias(c) for c in ("overall", "hop1", "hop2", "hop3")))


def hybrid_fixed(spark, sf):
    """The fixed hybrid: lexical, dense and graph legs fused, cut to the best ten."""
    r = _variant_rankings(spark, sf).where("variant = 'bm25_dense_graph_rrf' and rank <= 10")
    return r.select("qid", "doc", "rank")


def top1_scores(spark, sf):
    top = _lexical(spark, sf, 1)
    return _questions(spark, sf).select("qid").join(top, "qid", "left").select("qid", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def recall_by_hop(spark, sf):
    questions, gold = _questions(spark, sf), gold_pairs(spark, sf)
    answerable = questions.join(gold.select("qid").distinct(), "qid", "left_semi").select("qid", "hop_count")
    r = evaluation.by_hop_interval(evaluation.recall(_lexical(spark, sf, 5), gold, answerable, 5), "recall", "qid", "20261001")
    return r.select("hop", "questions", *(F.round(a, 6).alias(b) for a, b in (("mean", "recall"), ("lo", "lo"), ("hi", "hi"))))


def knn_candidate_pairs(spark, sf):
    e = load(spark, sf, "embeddings", "vec_id", "label", "embedding")
    return ranking.neighbour_pairs(e, "vec_id", "label", "embedding", 10, 0.2).select("a", "b", F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_idf_stats, dense_topk, rrf_two_way, rrf_three_way, entity_seeds, external_seeds, graph_expand_1hop, graph_expand_2hop, graph_chunks_2hop, hybrid_bm25_graph, hybrid_fixed, variant_matrix_recall, variant_report, top1_scores, recall_by_hop, knn_candidate_pairs)}


def bm25_sql(tag: str, docs: str, questions: str, k: int) -> str:
    """CTEs ending in {tag}r(qid, doc, score, rank); docs selects (doc, txt), questions (qid, question)."""
    return f"""{tag}t AS MATERIALIZED (SELECT doc, {TOK.format('txt')} AS t FROM ({docs})),
{tag}n AS (SELECT count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1.0) AS mean FROM {tag}t),
{tag}q AS (SELECT DISTINCT qid, unnest({TOK.format('question')}) AS term FROM ({questions})),
{tag}p AS MATERIALIZED (SELECT doc, len(t) AS len, term, count(*) AS tf FROM (SELECT doc, t, unnest(t) AS term FROM {tag}t) WHERE term IN (SELECT term FROM {tag}q) GROUP BY ALL),
{tag}d AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {tag}p, {tag}n GROUP BY term, n),
{tag}s AS (SELECT qid, doc, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM {tag}q JOIN {tag}p USING (term) JOIN {tag}d USING (term), {tag}n GROUP BY qid, doc),
{tag}r AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, CAST(doc AS VARCHAR)) AS rank FROM {tag}s WHERE score > 0) WHERE rank <= {k})"""


QUESTIONS = f"SELECT item_id AS qid, array_to_string(({TOK.format('text')})[1:12], ' ') AS question, 1 + item_id % 3 AS hop_count FROM benchmark"
DOCS = "SELECT doc_id AS doc, coalesce(source, '') || ' ' || coalesce(text, '') AS txt FROM documents"
GOLD = "SELECT item_id AS qid, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)"
NODES = "SELECT 'm' || p_partkey AS doc, p_name || ' ' || p_brand || ' ' || p_type AS txt FROM part UNION ALL SELECT 'd' || s_suppkey, s_name || ' ' FROM supplier"
NAMES = "SELECT DISTINCT p_name AS qid, p_name AS question FROM part"


def dense_sql(expr: str, k: int) -> str:
    return f"SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, CAST(doc AS VARCHAR)) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS doc, list_cosine_similarity(CAST({expr.format('q.')} AS DOUBLE[]), CAST({expr.format('v.')} AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= {k}"


def fuse_sql(parts: list[str], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT qid, doc, rank FROM ({p})" for p in parts)
    return f"SELECT qid, doc, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc) AS rank FROM (SELECT qid, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ({union}) GROUP BY ALL)) WHERE rank <= {k}"


WHOLE, FRONT, BACK = "{}embedding", "{}embedding[1:32]", "{}embedding[33:64]"
EVIDENCE = "SELECT 'm' || l_partkey AS s, CASE WHEN l_returnflag = 'R' THEN 'USES' ELSE 'EVALUATES_ON' END AS p, 'd' || l_suppkey AS o, l_orderkey AS chunk, max(round(1 - l_discount, 4)) AS conf FROM lineitem GROUP BY ALL"
EDGE = "s || '-' || p[1] || '-' || o"
GRAPH = f"""ev AS MATERIALIZED ({EVIDENCE}), ed AS MATERIALIZED (SELECT s, p, o, {EDGE} AS edge, max(conf) AS conf FROM ev GROUP BY ALL),
adj AS MATERIALIZED (SELECT s AS v, p, o AS u, edge, conf FROM ed UNION ALL SELECT o, p, s, edge, conf FROM ed),
src AS MATERIALIZED (SELECT 'm' || l_partkey AS v, min(l_orderkey) AS chunk FROM lineitem GROUP BY 1)"""


def levels_sql(tag: str, seeds: str, hops: int) -> str:
    """CTEs {tag}0 to {tag}{hops}: what expansion has admitted after each level."""
    out = f"{tag}0 AS MATERIALIZED (SELECT qid, doc AS v, 0 AS depth, score, rank AS pos FROM {seeds})"
    for h in range(1, hops + 1):
        last = f"{tag}{h - 1}"
        out += f""",
{tag}f{h} AS (SELECT * FROM (SELECT w.qid, a.u, w.pos, a.p, a.edge, w.score * a.conf * 0.5 AS next, row_number() OVER (PARTITION BY w.qid, a.u ORDER BY w.pos, a.p, a.edge) AS k
  FROM {last} w JOIN adj a USING (v) WHERE w.depth = {h - 1} AND w.score * a.conf * 0.5 > 0 AND (w.qid, a.u) NOT IN (SELECT (qid, v) FROM {last})) WHERE k = 1),
{tag}g{h} AS (SELECT f.qid, u, next, n + row_number() OVER (PARTITION BY f.qid ORDER BY f.pos, f.p, u, edge) AS pos FROM {tag}f{h} f JOIN (SELECT qid, count(*) AS n FROM {last} GROUP BY 1) c ON f.qid = c.qid),
{tag}{h} AS MATERIALIZED (SELECT * FROM {last} UNION ALL SELECT qid, u, {h}, next, pos FROM {tag}g{h} WHERE pos <= 100)"""
    return out


def expand_sql(hops: int) -> str:
    return f"{bm25_sql('z', NODES, NAMES, 2)}, {GRAPH}, {levels_sql('v', 'zr', hops)}"


NODE_ROWS = "SELECT qid, v AS node, CAST(depth AS BIGINT) AS depth, CAST(pos AS BIGINT) AS pos, round(score, 6) AS score FROM v{}"
CHUNK_ROWS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, CAST(doc AS VARCHAR)) AS rank FROM (SELECT qid, chunk AS doc, max(score / (depth + 1) * conf) AS score FROM {0} JOIN (SELECT s AS v, chunk, conf FROM ev UNION ALL SELECT o, chunk, conf FROM ev UNION ALL SELECT v, chunk, 1.0 FROM src) e USING (v) GROUP BY ALL)) WHERE rank <= 30"
ROWS = "SELECT qid, doc, rank, round(score, 6) AS score FROM {}"
RECALL = "SELECT q.qid, hop_count, coalesce(count(h.doc), 0) / max(n)::DOUBLE AS recall FROM ans q JOIN (SELECT qid, count(*) AS n FROM gold GROUP BY 1) g USING (qid) LEFT JOIN (SELECT r.qid, r.doc FROM {0} r JOIN gold USING (qid, doc) WHERE rank <= 5) h ON h.qid = q.qid GROUP BY ALL"
HOPS = "SELECT coalesce(hop_count, 0) AS hop, count(*) AS questions, round(avg(recall), 6) AS recall FROM ({0}) GROUP BY ROLLUP (hop_count)"
SHORT_Q = f"SELECT item_id AS qid, array_to_string(({TOK.format('text')})[1:4], ' ') AS question FROM benchmark"
ORDERS = "SELECT l_orderkey AS doc, array_to_string(list(p_name ORDER BY p_name), ' ') AS txt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"

TOP = "SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, CAST(doc AS VARCHAR)) AS rank FROM (SELECT q.id AS qid, d.id AS doc, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score FROM {0} q, {1} d)) WHERE rank <= {2}"
DENSE = f"""em AS MATERIALIZED (SELECT *, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
qv AS MATERIALIZED (SELECT p_name AS id, embedding FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1) JOIN em ON vec_id = k % n),
ov AS MATERIALIZED (SELECT l_orderkey AS id, embedding FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN em ON vec_id = l_orderkey % n),
nv AS MATERIALIZED (SELECT 'm' || p_partkey AS id, embedding FROM part JOIN em ON vec_id = p_partkey % n UNION ALL SELECT 'd' || s_suppkey, embedding FROM supplier JOIN em ON vec_id = (s_suppkey * 7) % n),
de AS MATERIALIZED ({TOP.format('qv', 'ov', 50)}), es AS MATERIALIZED (SELECT qid, doc, 1.0::DOUBLE / rank AS score, rank FROM ({TOP.format('qv', 'nv', 3)}))"""
VARIANT_RANKS = f"""WITH {expand_sql(1)}, {bm25_sql('x', ORDERS, NAMES, 50)}, {DENSE}, {levels_sql('w', 'es', 1)},
legs AS (SELECT 'bm25' AS leg, qid, doc, rank FROM xr UNION ALL SELECT 'dense', qid, doc, rank FROM de UNION ALL SELECT 'graph', qid, doc, rank FROM ({CHUNK_ROWS.format('v1')}) UNION ALL SELECT 'entity', qid, doc, rank FROM ({CHUNK_ROWS.format('w1')})),
vp AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{leg}')" for v, legs in VARIANTS.items() for leg in legs)}) t(variant, leg)),
vr AS MATERIALIZED (SELECT variant, qid, doc, row_number() OVER (PARTITION BY variant, qid ORDER BY round(score, 12) DESC, doc) AS rank FROM (SELECT variant, qid, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM legs JOIN vp USING (leg) GROUP BY ALL))"""
VARIANT_MEANS = f"""{VARIANT_RANKS}, gold AS MATERIALIZED (SELECT DISTINCT p_name AS qid, l_orderkey AS doc FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50),
ask AS (SELECT variant, qid, n, CAST(1 + length(qid) % 3 AS BIGINT) AS hop FROM (SELECT qid, count(*) AS n FROM gold GROUP BY 1), (SELECT DISTINCT variant FROM vp)),
rec AS (SELECT a.variant, a.qid, a.hop, coalesce(c, 0) / n::DOUBLE AS recall FROM ask a LEFT JOIN (SELECT variant, qid, count(*) AS c FROM vr JOIN gold USING (qid, doc) WHERE rank <= 10 GROUP BY ALL) h ON h.variant = a.variant AND h.qid = a.qid),
vm AS (SELECT variant, hop, count(*) AS questions, avg(recall) AS mean FROM (SELECT variant, unnest([0, hop]) AS hop, recall FROM rec) GROUP BY ALL)"""
POISSON = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 ELSE 5 END"


def interval_sql(rows: str, group: str, value: str, key: str, seed: str, rounds: int = 10_000) -> str:
    """({group}, lo, hi): the resampled interval of a mean by group."""
    low = "list_sort(list(m))[CAST(floor({0} * (count(*) - 1)) AS BIGINT) + 1]"
    return f"""SELECT {group}, round({low.format(0.025)}, 6) AS lo, round({low.format(0.975)}, 6) AS hi FROM (SELECT {group}, r, round(coalesce(sum({value} * w)::DOUBLE / nullif(sum(w), 0), 0), 9) AS m
  FROM (SELECT {group}, {value}, r, {POISSON} AS w FROM (SELECT {group}, {value}, r, CAST('0x' || substr(md5('{seed}:' || r || ':' || {key}), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM ({rows}), range({rounds}) t(r))) GROUP BY ALL) GROUP BY 1"""


SQL = {
    "bm25_topk": f"WITH {bm25_sql('b', DOCS, QUESTIONS, 5)} {ROWS.format('br')}",
    "bm25_idf_stats": f"WITH t AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents), n AS (SELECT count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1.0) AS mean FROM t), p AS (SELECT doc_id, unnest(t) AS term FROM t), d AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM p GROUP BY 1) SELECT term, df, tf, round(mean, 6) AS mean_len, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, n",
    "dense_topk": ROWS.format(f"({dense_sql(WHOLE, 5)})"),
    "rrf_two_way": fuse_sql([dense_sql(WHOLE, 50), dense_sql(FRONT, 50)], 10),
    "rrf_three_way": fuse_sql([dense_sql(WHOLE, 50), dense_sql(FRONT, 50), dense_sql(BACK, 50)], 10),
    "entity_seeds": f"WITH {bm25_sql('b', NODES, NAMES, 3)} {ROWS.format('br')}",
    "external_seeds": "WITH g AS (SELECT item_id AS qid, unnest([0, 1, 2, 3, 4]) AS pos, 'd' || CAST(item_id * unnest([7, 11, 7, 13, 3]) % 130 AS VARCHAR) AS doc FROM benchmark), f AS (SELECT qid, doc, min(pos) AS pos FROM g WHERE doc IN (SELECT 'd' || s_suppkey FROM supplier) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rank FROM f) SELECT qid, doc, rank, round(1.0::DOUBLE / rank, 6) AS score FROM r WHERE rank <= 3",
    "graph_expand_1hop": f"WITH {expand_sql(1)} {NODE_ROWS.format(1)}",
    "graph_expand_2hop": f"WITH {expand_sql(2)} {NODE_ROWS.format(2)}",
    "graph_chunks_2hop": f"WITH {expand_sql(2)} SELECT qid, doc, rank, round(score, 6) AS score FROM ({CHUNK_ROWS.format("v2")})",
    "hybrid_bm25_graph": f"WITH {expand_sql(1)}, {bm25_sql('x', ORDERS, NAMES, 50)}, ch AS ({CHUNK_ROWS.format("v1")}) {fuse_sql(['SELECT * FROM xr', 'SELECT * FROM ch'], 5)}",
    "hybrid_fixed": f"{VARIANT_RANKS} SELECT qid, doc, rank FROM vr WHERE variant = 'bm25_dense_graph_rrf' AND rank <= 10",
    "variant_matrix_recall": f"{VARIANT_MEANS} SELECT variant, hop, questions, round(mean, 6) AS recall FROM vm",
    "variant_report": f"{VARIANT_MEANS} SELECT variant, " + ", ".join(f"round(max(mean) FILTER (hop = {h}), 6) AS {n}" for h, n in ((0, "overall"), (1, "hop1"), (2, "hop2"), (3, "hop3"))) + " FROM vm GROUP BY variant",
    "top1_scores": f"WITH {bm25_sql('b', DOCS, QUESTIONS, 1)} SELECT item_id AS qid, round(coalesce(score, 0), 6) AS score FROM benchmark LEFT JOIN br ON item_id = qid",
    "recall_by_hop": f"WITH {bm25_sql('b', DOCS, QUESTIONS, 5)}, gold AS MATERIALIZED ({GOLD}), ans AS (SELECT * FROM ({QUESTIONS}) WHERE qid IN (SELECT qid FROM gold)), rc AS MATERIALIZED (SELECT qid, recall, unnest([0, hop_count]) AS hop FROM ({RECALL.format('br')})) SELECT hop, questions, recall, lo, hi FROM (SELECT hop, count(*) AS questions, round(avg(recall), 6) AS recall FROM rc GROUP BY 1) JOIN ({interval_sql('SELECT * FROM rc', 'hop', 'recall', 'qid', '20261001')}) USING (hop)",
    "knn_candidate_pairs": "WITH s AS (SELECT a.vec_id AS q, b.vec_id AS d, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, CAST(d AS VARCHAR)) AS n FROM s) SELECT least(q, d) AS a, greatest(q, d) AS b, round(max(score), 6) AS similarity FROM r WHERE n <= 10 AND round(score, 9) >= 0.2 GROUP BY ALL",
}
