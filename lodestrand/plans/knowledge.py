"""Registered queries over the property graph: extraction rules, consolidation, resolution, audits.

Triples are line items (part evaluated on supplier, evidence chunk = order); return flags stand for relations, so that some
break the ontology. Merge decisions and reviewer labels are rules over ids: plain stand-ins for human work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as tx
from ..operators import knowledge, ranking, relational
from ..sources import files
from .corpus import NORM, TOK, load
from .retrieval import EDGE, EVIDENCE, _edges, _evidence, _nodes
from .retrieval import SQL as RSQL


def _triples(spark, sf):
    line = load(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag")
    predicate = F.when(F.col("l_returnflag") == "A", "EVALUATES_ON").when(F.col("l_returnflag") == "N", "USES").otherwise("PROPOSES")
    conf = F.round(1 - F.col("l_discount") + F.when(F.col("l_tax") > 0.07, 0.5).otherwise(0.0), 4)
    return line.select(F.col("l_orderkey").alias("chunk_id"), predicate.alias("predicate"), F.lit("Method").alias("subject_kind"), F.lit("Dataset").alias("object_kind"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("subject_id"), F.when(F.col("l_suppkey") % 17 != 0, F.concat(F.lit("d"), F.col("l_suppkey").cast("string"))).alias("object_id"), conf.alias("confidence"))


TRIPLES = "SELECT l_orderkey AS chunk, CASE l_returnflag WHEN 'A' THEN 'EVALUATES_ON' WHEN 'N' THEN 'USES' ELSE 'PROPOSES' END AS predicate, CASE WHEN l_suppkey % 17 <> 0 THEN 'd' || l_suppkey END AS o, round(1 - l_discount + CASE WHEN l_tax > 0.07 THEN 0.5 ELSE 0 END, 4) AS conf FROM lineitem"
ACCEPTED = "(predicate IN ('EVALUATES_ON', 'USES') AND o IS NOT NULL AND conf BETWEEN 0 AND 1)"


def ontology_accept_reject(spark, sf):
    j = knowledge.judged(_triples(spark, sf))
    return j.groupBy("predicate").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def predicate_histogram(spark, sf):
    return _triples(spark, sf).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def failure_rates(spark, sf):
    j = knowledge.judged(_triples(spark, sf)).groupBy("predicate").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("accepted")).alias("failed"))
    return j.select("predicate", "total", "failed", F.round(F.col("failed") / F.col("total"), 6).alias("rate"))


def _mentions(spark, sf):
    line = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = load(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(tx.entity_id(F.lit("Method"), F.col("p_name")).alias("id"), F.lit("Method").alias("kind"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_suppkey").cast("string").alias("paper_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))


def consolidate_nodes(spark, sf):
    n = knowledge.nodes(_mentions(spark, sf))
    size = lambda c: F.size(c).cast("long")
    return n.select("id", "kind", "name", size("aliases").alias("n_aliases"), F.sha2(F.array_join("aliases", "|"), 256).alias("aliases_sha256"), size("source_chunk_ids").alias("n_chunks"), size("paper_ids").alias("n_papers"))


def _edge_evidence(spark, sf):
    line = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount").join(load(spark, sf, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    t = line.select(tx.entity_id(F.lit("Method"), F.col("p_name")).alias("subject_id"), F.lit("EVALUATES_ON").alias("predicate"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("object_id"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.lit("p").alias("paper_id"), F.round(1 - F.col("l_discount"), 4).alias("confidence"), "l_linenumber")
    return knowledge.edge_evidence(t, F.struct("l_linenumber", "confidence"))


def consolidate_edges(spark, sf):
    e = knowledge.edges(_edge_evidence(spark, sf))
    return e.select("edge_id", "subject_id", "object_id", F.size("evidence").cast("long").alias("n_evidence"), "confidence", F.element_at("evidence", 1)["chunk_id"].alias("first_chunk"))


def edge_evidence_rows(spark, sf):
    e = _edge_evidence(spark, sf)
    return e.select(tx.evidence_id(F.col("edge_id"), F.col("chunk_id")).alias("evidence_id"), "edge_id", "chunk_id", "confidence")


def alias_table(spark, sf):
    return knowledge.aliases(_nodes(spark, sf)).where("n = 1").select("kind", "normalized_alias", F.element_at("ids", 1).alias("entity_id"))


def alias_collisions(spark, sf):
    return knowledge.aliases(_nodes(spark, sf)).where("n > 1").select("kind", "normalized_alias", "n", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


def extraction_normalize(spark, sf):
    line = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(load(spark, sf, "part", "p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    found = line.select(F.col("l_orderkey").alias("chunk_id"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.lit("Method").alias("kind"), name.alias("name"), F.array(F.col("p_brand"), F.lit(" ")).alias("aliases"))
    e = knowledge.normalized_entities(found)
    return e.select("chunk_id", "id", "kind", "normalized", "name", F.array_join("aliases", ",").alias("aliases"))


def shared_aliases(spark, sf):
    p = load(spark, sf, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", F.array(F.lower("p_brand"), F.lower("p_type")).alias("x"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return p.join(q, "p_partkey").select("p_partkey", F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("shared"))


def adjudication_worksheet(spark, sf):
    e = load(spark, sf, "embeddings", "vec_id", "label", "embedding")
    pairs = ranking.neighbour_pairs(e, "vec_id", "label", "embedding", 10, 0.2)
    pairs = pairs.select(F.concat(F.lit("m"), F.col("a").cast("string")).alias("a"), F.concat(F.lit("m"), F.col("b").cast("string")).alias("b"), "similarity")
    w = files.worksheet(pairs, _nodes(spark, sf))
    return w.select("pair_id", "a", "b", "similarity", "entity1_name", "entity2_aliases")


def _pairs(spark, sf):
    p = load(spark, sf, "part", "p_partkey")
    key = lambda x: F.concat(F.lit("m"), x.cast("string"))
    k = F.col("p_partkey")
    decision = F.when(k % 4 == 0, " merge ").when(k % 4 == 1, "KEEP_SEPARATE").when(k % 4 == 2, "uncertain").otherwise("UNREVIEWED")
    return p.select(k.alias("seq"), key(k).alias("entity_id_a"), key(k + 1).alias("entity_id_b"), decision.alias("decision"), F.when(k % 4 == 0, key(k + 1)).alias("canonical_entity_id"))


def _provenance(spark, sf):
    return _nodes(spark, sf).withColumns({"source_chunk_ids": F.array(F.concat(F.lit("c"), "id")), "paper_ids": F.array(F.lit("p"))})


def apply_merges(spark, sf):
    m = knowledge.merged(_provenance(spark, sf), knowledge.decisions(_pairs(spark, sf)))
    return m.select("id", "kind", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join("source_chunk_ids", "|").alias("chunks"))


def remap_edges(spark, sf):
    return knowledge.remapped(_edges(_evidence(spark, sf)), knowledge.decisions(_pairs(spark, sf))).select("edge_id", "subject_id", "object_id", "confidence")


def resolution_verification(spark, sf):
    mapping, before = knowledge.decisions(_pairs(spark, sf)), _provenance(spark, sf)
    after = knowledge.merged(before, mapping)
    edges = knowledge.remapped(_edges(_evidence(spark, sf)), mapping)
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct().join(after.select("id"), "id", "left_anti")
    chunks = lambda df: df.select(F.explode("source_chunk_ids").alias("c")).distinct()
    lost = chunks(before).join(chunks(after), "c", "left_anti")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(before, "nodes_before").join(count(after, "nodes_after")).join(count(ends, "orphaned")).join(count(lost, "lost"))


def decision_counts(spark, sf):
    d = F.upper(F.trim("decision"))
    return _pairs(spark, sf).agg(*(F.count_if(d == v).alias(v.lower()) for v in ("MERGE", "KEEP_SEPARATE", "UNCERTAIN", "UNREVIEWED")))


def endpoint_integrity(spark, sf):
    known = load(spark, sf, "supplier", "s_suppkey").where("s_suppkey % 10 <> 0").select(F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("id"))
    return relational.missing(_evidence(spark, sf), "object_id", known, "id")


def loader_batch_counts(spark, sf):
    e = _evidence(spark, sf)
    return relational.batch_counts({"nodes": _nodes(spark, sf), "edges": _edges(e), "evidence": e}, 500)


def triple_audit_sample(spark, sf):
    e = _evidence(spark, sf).withColumn("audit_id", tx.audit_id(F.col("edge_id"), F.col("chunk_id").cast("string")))
    j = relational.must_join(e, _nodes(spark, sf).select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), ["subject_id"], "an edge without its subject")
    j = relational.must_join(j, _nodes(spark, sf).select(F.col("id").alias("object_id"), F.col("name").alias("object")), ["object_id"], "an edge without its object")
    return relational.hash_sample(j.select("audit_id", "subject", "predicate", "object", "chunk_id", "confidence"), "audit_id", 50, "audit")


def wilson_accuracy(spark, sf):
    g = load(spark, sf, "labels", "quality", "toxic").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(knowledge.label_of(F.col("quality").cast("string"))).alias("correct"))
    lo, hi = metrics.wilson(F.col("correct"), F.col("n"))
    return g.select("toxic", "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def label_transfer(spark, sf):
    """A blank label in the sheet counts as false: parity with the workflow that this restates."""
    sheet = load(spark, sf, "labels", "doc_id", "quality").withColumn("raw", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("quality").cast("string")))
    rows = load(spark, sf, "documents", "doc_id").withColumn("old", F.lit("unreviewed"))
    new = F.when(F.col("raw").isNotNull(), F.when(F.lower(F.trim("raw")).isin("true", "yes", "correct", "1"), "true").otherwise("false"))
    return rows.join(sheet, "doc_id", "left").select("doc_id", F.coalesce(new, "old").alias("label"))


def audit_progress(spark, sf):
    j = load(spark, sf, "documents", "doc_id", "lang").join(load(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("right"), F.count_if(F.col("quality") == 0).alias("wrong"), F.count_if(F.col("quality").isNull()).alias("remaining"))


def heuristic_labels(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text").withColumn("t", tx.terms("text")).where(F.size("t") >= 8)
    k = F.col("doc_id") % 5
    predicate = F.when(k == 0, "USES").when(k == 1, "EVALUATES_ON").when(k == 2, "PROPOSES").when(k == 3, "CITES").otherwise("OUTPERFORMS")
    label = knowledge.suggested_label(F.element_at("t", 1), predicate, F.element_at("t", -1), F.col("text"))
    return d.select("doc_id", label.alias("label"))


QUERIES = {f.__name__: f for f in (ontology_accept_reject, predicate_histogram, failure_rates, consolidate_nodes, consolidate_edges, edge_evidence_rows, alias_table, alias_collisions, extraction_normalize, shared_aliases, adjudication_worksheet, apply_merges, remap_edges, resolution_verification, decision_counts, endpoint_integrity, loader_batch_counts, triple_audit_sample, wilson_accuracy, label_transfer, audit_progress, heuristic_labels)}

EID = f"'method_' || substr(sha256('Method:' || {NORM.format('p_name')}), 1, 20)"
LINE = f"SELECT *, {EID} AS id FROM lineitem JOIN part ON l_partkey = p_partkey"
EDGE_EV = f"SELECT 'edge_' || substr(sha256(s || chr(10) || 'EVALUATES_ON' || chr(10) || o), 1, 20) AS edge_id, s, o, chunk, max_by(conf, (ln, conf)) AS conf FROM (SELECT id AS s, 'd' || l_suppkey AS o, CAST(l_orderkey AS VARCHAR) AS chunk, l_linenumber AS ln, round(1 - l_discount, 4) AS conf FROM ({LINE})) GROUP BY ALL"
NODE = "SELECT 'm' || p_partkey AS id, 'Method' AS kind, p_name AS name, [p_brand, p_type] AS aliases FROM part UNION ALL SELECT 'd' || s_suppkey, 'Dataset', s_name, [] FROM supplier"
ALIAS = f"SELECT kind, {NORM.format('a')} AS normalized_alias, list_sort(list(DISTINCT id)) AS ids FROM (SELECT kind, id, unnest(list_concat([name], aliases)) AS a FROM ({NODE})) GROUP BY ALL HAVING normalized_alias <> ''"
MAPPING = "SELECT e, max_by(c, (k, side)) AS c FROM (SELECT k, unnest([0, 1]) AS side, unnest(['m' || k, 'm' || (k + 1)]) AS e, 'm' || (k + 1) AS c FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 = 0)) GROUP BY 1"
MERGED = f"""mp AS MATERIALIZED ({MAPPING}), nd AS MATERIALIZED (SELECT *, ['c' || id] AS chunks FROM ({NODE})),
  gr AS (SELECT coalesce(mp.c, nd.id) AS cid, nd.* FROM nd LEFT JOIN mp ON mp.e = nd.id),
  mg AS MATERIALIZED (SELECT n.id, n.kind, n.name, g.aliases, g.chunks FROM (SELECT cid, list_sort(list_distinct(flatten(list(aliases)))) AS aliases, list_sort(list_distinct(flatten(list(chunks)))) AS chunks FROM (SELECT cid, aliases, chunks FROM gr UNION ALL SELECT id, aliases, chunks FROM nd WHERE id IN (SELECT c FROM mp)) WHERE cid IN (SELECT c FROM mp) GROUP BY cid) g JOIN nd n ON n.id = g.cid
  UNION ALL SELECT id, kind, name, aliases, chunks FROM nd WHERE id NOT IN (SELECT c FROM mp) AND id NOT IN (SELECT e FROM mp))"""
REMAP = f"SELECT {EDGE} AS edge_id, coalesce(a.c, s) AS subject_id, coalesce(b.c, o) AS object_id, conf AS confidence FROM (SELECT s, p, o, max(conf) AS conf FROM ({EVIDENCE}) GROUP BY ALL) LEFT JOIN ({MAPPING}) a ON a.e = s LEFT JOIN ({MAPPING}) b ON b.e = o"
W = "(p + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)"
H = "1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)"
_S, _O = r"'\Q' || s || '\E'", r"'\Q' || o || '\E'"
_BETWEEN = lambda p: f"regexp_matches(x, '(?s)' || {_S} || '.*{p}.*' || {_O})"
_AHEAD = lambda p: f"regexp_matches(x, '(?s){p}.*' || {_O})"
_RULES = {
    0: " OR ".join(_BETWEEN(rf"\b{v}\b") for v in ("uses", "applies", "employs", "utilizes")),
    1: " OR ".join([_BETWEEN(r"\bevaluated? on\b"), _BETWEEN(r"\btested? on\b"), rf"regexp_matches(x, '(?s)\beval.*' || {_S} || '.*' || {_O})"]),
    2: " OR ".join(_AHEAD(v) for v in (r"\bpropose", r"\bintroduce", r"\bpresent")),
    3: " OR ".join(_AHEAD(v) for v in (r"\bcites?\b", r"\brefer.*to", r"\[\d+\]")),
    4: " OR ".join(_BETWEEN(v) for v in (r"\boutperforms?\b", r"\bbetter than\b", r"\bsurpasses\b")),
}

SQL = {
    "ontology_accept_reject": f"SELECT predicate, CAST(count_if({ACCEPTED}) AS BIGINT) AS accepted, CAST(count_if(NOT {ACCEPTED} OR {ACCEPTED} IS NULL) AS BIGINT) AS rejected FROM ({TRIPLES}) GROUP BY 1",
    "predicate_histogram": f"SELECT predicate, count(*) AS n FROM ({TRIPLES}) GROUP BY 1",
    "failure_rates": f"SELECT predicate, count(*) AS total, CAST(count_if(coalesce(NOT {ACCEPTED}, true)) AS BIGINT) AS failed, round(count_if(coalesce(NOT {ACCEPTED}, true)) / count(*)::DOUBLE, 6) AS rate FROM ({TRIPLES}) GROUP BY 1",
    "consolidate_nodes": f"SELECT id, 'Method' AS kind, min_by(p_name, (l_orderkey, l_linenumber, l_partkey)) AS name, CAST(len(al) AS BIGINT) AS n_aliases, sha256(array_to_string(al, '|')) AS aliases_sha256, count(DISTINCT l_orderkey) AS n_chunks, count(DISTINCT l_suppkey) AS n_papers FROM ({LINE}) JOIN (SELECT id AS aid, list_sort(list(DISTINCT a)) AS al FROM (SELECT id, unnest([p_brand, p_type]) AS a FROM ({LINE})) GROUP BY 1) ON aid = id GROUP BY id, al",
    "consolidate_edges": f"SELECT edge_id, s AS subject_id, o AS object_id, count(*) AS n_evidence, max(conf) AS confidence, min(chunk) AS first_chunk FROM ({EDGE_EV}) GROUP BY ALL",
    "edge_evidence_rows": f"SELECT 'evidence_' || substr(sha256(edge_id || ':' || chunk), 1, 24) AS evidence_id, edge_id, chunk AS chunk_id, conf AS confidence FROM ({EDGE_EV})",
    "alias_table": f"SELECT kind, normalized_alias, ids[1] AS entity_id FROM ({ALIAS}) WHERE len(ids) = 1",
    "alias_collisions": f"SELECT kind, normalized_alias, CAST(len(ids) AS BIGINT) AS n, sha256(array_to_string(ids, ',')) AS ids_sha256 FROM ({ALIAS}) WHERE len(ids) > 1",
    "extraction_normalize": f"SELECT chunk_id, id, 'Method' AS kind, normalized, name, aliases FROM (SELECT l_orderkey AS chunk_id, {NORM.format('p_name')} AS normalized, id, trim(min_by(CASE WHEN l_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, (l_linenumber, l_partkey))) AS name, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS aliases FROM ({LINE}) GROUP BY ALL)",
    "shared_aliases": "SELECT a.p_partkey, array_to_string(list_sort(list_intersect([lower(a.p_brand), lower(a.p_type)], [lower(b.p_brand), lower(b.p_type)])), ',') AS shared FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "adjudication_worksheet": f"WITH k AS ({RSQL['knn_candidate_pairs'].replace('round(max(score), 6)', 'max(score)')}), p AS (SELECT 'm' || a AS a, 'm' || b AS b, similarity FROM k), r AS (SELECT *, row_number() OVER (ORDER BY round(similarity, 9) DESC, a, b) AS n FROM p), nd AS ({NODE}) SELECT format('pair_{{:04d}}', n) AS pair_id, a, b, format('{{:.4f}}', similarity) AS similarity, coalesce(x.name, '') AS entity1_name, coalesce(array_to_string(y.aliases, '; '), '') AS entity2_aliases FROM r LEFT JOIN nd x ON x.id = a LEFT JOIN nd y ON y.id = b",
    "apply_merges": f"WITH {MERGED} SELECT id, kind, name, coalesce(array_to_string(aliases, '|'), '') AS aliases, array_to_string(chunks, '|') AS chunks FROM mg",
    "remap_edges": REMAP,
    "resolution_verification": f"WITH {MERGED}, re AS MATERIALIZED ({REMAP}) SELECT (SELECT count(*) FROM nd) AS nodes_before, (SELECT count(*) FROM mg) AS nodes_after, (SELECT count(*) FROM (SELECT subject_id AS i FROM re UNION SELECT object_id FROM re) WHERE i NOT IN (SELECT id FROM mg)) AS orphaned, (SELECT count(*) FROM (SELECT unnest(chunks) AS c FROM nd) WHERE c NOT IN (SELECT unnest(chunks) FROM mg)) AS lost",
    "decision_counts": "SELECT CAST(count_if(k % 4 = 0) AS BIGINT) AS merge, CAST(count_if(k % 4 = 1) AS BIGINT) AS keep_separate, CAST(count_if(k % 4 = 2) AS BIGINT) AS uncertain, CAST(count_if(k % 4 = 3) AS BIGINT) AS unreviewed FROM (SELECT p_partkey AS k FROM part)",
    "endpoint_integrity": "SELECT DISTINCT 'd' || l_suppkey AS missing FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)",
    "loader_batch_counts": f"WITH ev AS ({EVIDENCE}), c AS (SELECT 'nodes' AS relation, count(*) AS rows FROM ({NODE}) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT s, p, o FROM ev) UNION ALL SELECT 'evidence', count(*) FROM ev) SELECT relation, rows, CAST(ceil(rows / 500.0) AS BIGINT) AS batches FROM c",
    "triple_audit_sample": f"WITH e AS (SELECT 'audit_' || substr(sha256({EDGE} || ':' || chunk), 1, 20) AS audit_id, * FROM ({EVIDENCE})) SELECT audit_id, p_name AS subject, p AS predicate, s_name AS object, chunk AS chunk_id, conf AS confidence FROM e JOIN part ON s = 'm' || p_partkey JOIN supplier ON o = 'd' || s_suppkey ORDER BY sha256('audit:' || audit_id), audit_id LIMIT 50",
    "wilson_accuracy": f"SELECT toxic, n, correct, round(p, 6) AS accuracy, round(greatest(0, {W} - {H}), 6) AS lo, round(least(1, {W} + {H}), 6) AS hi FROM (SELECT toxic, count(*) AS n, CAST(count_if(quality = 1) AS BIGINT) AS correct, count_if(quality = 1) / count(*)::DOUBLE AS p FROM labels GROUP BY 1)",
    "label_transfer": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN d.doc_id % 3 <> 0 AND quality = 1 THEN 'true' ELSE 'false' END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "audit_progress": "SELECT lang, count(quality) AS labelled, CAST(count_if(quality = 1) AS BIGINT) AS right, CAST(count_if(quality = 0) AS BIGINT) AS wrong, CAST(count_if(quality IS NULL) AS BIGINT) AS remaining FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang".replace("AS right", 'AS "right"'),
    "heuristic_labels": f"SELECT doc_id, CASE WHEN NOT (contains(x, s) AND contains(x, o)) THEN 'false' WHEN CASE doc_id % 5 {' '.join(f'WHEN {k} THEN {r}' for k, r in _RULES.items())} END THEN 'true' WHEN abs(instr(x, s) - instr(x, o)) < 100 THEN 'uncertain' ELSE 'false' END AS label FROM (SELECT doc_id, lower(text) AS x, lower(t[1]) AS s, lower(t[-1]) AS o FROM (SELECT doc_id, text, {TOK.format('text')} AS t FROM documents) WHERE len(t) >= 8)",
}
