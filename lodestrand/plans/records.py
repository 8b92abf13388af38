"""Registered queries over question records, extraction chains, strict joins, audits, reports and retries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import agent, evaluation, knowledge, records, relational
from .corpus import TOK, _questions, load
from .knowledge import ACCEPTED, EDGE_EV, LINE, NORM, TRIPLES, _edge_evidence, _triples
from .retrieval import QUESTIONS, _order_gold
from .scoring import _guarded


def _conversations(spark, sf):
    """(qid, paragraphs, decomposition): conversations as questions, turns as paragraphs; every third has a decomposition."""
    turns = load(spark, sf, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    paragraph = F.struct(F.col("turn").alias("idx"), (F.col("role") == "assistant").alias("is_supporting"), "role", "text")
    grouped = turns.groupBy(F.col("conv_id").alias("qid")).agg(F.array_sort(F.collect_list(paragraph)).alias("paragraphs"))
    steps = F.transform(F.filter("paragraphs", lambda p: p["idx"] % 2 == 0), lambda p: F.struct(F.array(p["idx"], F.lit(0).cast("long")).alias("support")))
    return grouped.where(F.exists("paragraphs", lambda p: p["is_supporting"])).withColumn("decomposition", F.when(F.col("qid") % 3 == 0, steps))


def normalized_records(spark, sf):
    return records.normalized(_conversations(spark, sf)).select("qid", F.array_join(F.col("supports").cast("array<string>"), ",").alias("supports"), F.col("hop_count").cast("long").alias("hop_count"))


def required_ids(spark, sf):
    r = records.normalized(_conversations(spark, sf)).where(F.col("qid") % 2 == 0)
    return r.select(F.explode("supports").alias("turn")).distinct()


def corpus_flatten(spark, sf):
    first, _ = records.flattened(_conversations(spark, sf), tx.paragraph_id(F.col("role"), F.coalesce("text", F.lit(""))))
    return first.select("id", "qid", F.col("pos").cast("long").alias("pos"))


def corpus_supports(spark, sf):
    return records.flattened(_conversations(spark, sf), tx.paragraph_id(F.col("role"), F.coalesce("text", F.lit(""))))[1]


def supporting_ids(spark, sf):
    d = load(spark, sf, "documents", "doc_id")
    k = F.col("doc_id")
    q = d.select("doc_id", F.when(k % 2 == 0, F.array(k, k, k + 1)).alias("a"), F.when(k % 3 == 0, F.array(F.concat(F.lit("p"), k.cast("string")))).alias("supporting_passage_ids"))
    ids = F.array_join(F.coalesce(records.supporting_ids(F.col("a"), F.col("supporting_passage_ids")), F.array().cast("array<string>")), ",")
    return q.select("doc_id", ids.alias("ids")).join(F.broadcast(records.track(q)))


def extraction_chain(spark, sf):
    """Entities and triples of orders: normalised with their source paper, resolved within the order, judged in both modes."""
    line = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax").join(load(spark, sf, "part", "p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    line = line.withColumns({"chunk_id": F.col("l_orderkey"), "paper": F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), "data": F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))})
    papers = line.select("chunk_id", F.col("paper").alias("paper_id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("title")).distinct()
    none = F.array().cast("array<string>")
    found = line.select("chunk_id", F.col("l_linenumber").alias("pos"), F.lit("Method").alias("kind"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    found = found.unionByName(line.select("chunk_id", (100 + F.col("l_linenumber")).alias("pos"), F.lit("Dataset").alias("kind"), F.col("data").alias("name"), none.alias("aliases")))
    conf = F.when(F.col("l_linenumber") == 3, None).when(F.col("l_tax") > 0.07, 1.5).otherwise(F.round(1 - F.col("l_discount"), 4))
    triple = lambda s_kind, s, p, o_kind, o: line.select("chunk_id", F.lit(s_kind).alias("subject_kind"), F.col(s).alias("subject"), F.lit(p).alias("predicate"), F.lit(o_kind).alias("object_kind"), F.col(o).alias("object"), conf.alias("confidence"))
    triples = triple("Paper", "paper", "PROPOSES", "Method", "p_name").unionByName(triple("Method", "p_brand", "EVALUATES_ON", "Dataset", "data"))
    _, ends = knowledge.extraction_records(papers, found, triples, default_confidence=False)
    both = knowledge.judged(ends).select("predicate", F.col("accepted").alias("strict"), F.coalesce(F.col("confidence"), F.lit(0.0)).between(0.0, 1.0).alias("lenient"))
    kept = both.groupBy("predicate").agg(F.count(F.lit(1)).alias("resolved"), F.count_if("lenient").alias("accepted_default"), F.count_if("strict").alias("accepted_strict"))
    return triples.groupBy("predicate").agg(F.count(F.lit(1)).alias("total")).join(kept, "predicate")


def strict_triples(spark, sf):
    good = knowledge.judged(_triples(spark, sf)).where("accepted").drop("accepted")
    return knowledge.accepted(good).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def failing_kind_pairs(spark, sf):
    failed = knowledge.judged(_triples(spark, sf)).where(~F.col("accepted"))
    top = relational.most_common(failed, ["predicate", "subject_kind", "object_kind"], 10, F.struct("chunk_id", "subject_id", "confidence"))
    return top.join(F.broadcast(failed.agg(F.count(F.lit(1)).alias("_all")))).select("predicate", "subject_kind", "object_kind", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def evidence_explode(spark, sf):
    e = knowledge.edges(_edge_evidence(spark, sf))
    return e.select("edge_id", F.explode("evidence").alias("e")).select("edge_id", "e.chunk_id", "e.confidence")


def validation_audit_rows(spark, sf):
    line = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    m, d = F.concat(F.lit("m"), F.col("l_partkey").cast("string")), F.concat(F.lit("d"), F.col("l_suppkey").cast("string"))
    cache = line.select(F.col("l_orderkey").alias("chunk_id"), m.alias("subject_id"), F.lit("EVALUATES_ON").alias("predicate"), d.alias("object_id")).distinct()
    passages = load(spark, sf, "orders", "o_orderkey", "o_orderpriority").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("text"))
    named = line.where("l_linenumber <> 2").join(load(spark, sf, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    entities = named.select(F.col("l_orderkey").alias("chunk_id"), m.alias("id"), F.col("p_name").alias("name"), F.lit("Method").alias("kind")).distinct()
    rows, _ = knowledge.audit_rows(cache, passages, entities)
    return rows.select("chunk_id", "subject_id", "subject", "subject_kind", "object_id", "object", "object_kind", "text")


def answer_inputs(spark, sf):
    orders = load(spark, sf, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderkey", "doc")
    return relational.must_join(_order_gold(spark, sf), orders, ["doc"], "a retrieved passage is unknown").select("qid", "doc", "o_orderpriority")


def citation_titles(spark, sf):
    b, d = load(spark, sf, "benchmark", "item_id"), load(spark, sf, "documents", "doc_id", "source")
    own = (F.col("item_id") * 5).cast("string")
    answers = b.select(F.col("item_id").alias("qid"), F.array(own, F.lit("none")).alias("citation_ids"))
    titles = b.join(d, F.col("doc_id") == F.col("item_id") * 5).select(F.col("item_id").alias("qid"), own.alias("doc"), F.col("source").alias("title"))
    return agent.titled(answers, titles).withColumn("pos", F.col("pos").cast("long"))


def subset_violations(spark, sf):
    c = load(spark, sf, "conversations", "conv_id", "turn", "role").where("turn < 2").groupBy("conv_id").agg(F.collect_set("role").alias("part"))
    v = relational.not_subset(c.withColumn("whole", F.array(F.lit("user"), F.lit("assistant"))), "conv_id", "part", "whole")
    return v.select("conv_id", F.array_join(F.array_sort("extra"), ",").alias("extra"))


def ranking_equality(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "n_chars")
    return relational.same_keys(relational.numbered(d, "pos", "doc_id"), relational.numbered(d.where("doc_id % 10 <> 0"), "pos", F.desc("n_chars"), F.col("doc_id")), "doc_id")


def question_page(spark, sf):
    return relational.page(_questions(spark, sf).select("qid", "question"), 5, 20, "qid")


def top_terms(spark, sf):
    t = load(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(tx.terms("text")).alias("pos", "term"))
    return relational.most_common(t, ["term"], 10, F.struct("doc_id", "pos"))


def stratified_sample(spark, sf):
    return relational.stratified_sample(load(spark, sf, "documents", "doc_id", "lang"), "lang", "doc_id", 300, "public")


def _stub(prompt: str, budget: int) -> str:
    """Stands for a model: an answer cut at its budget."""
    return json.dumps({"answer": prompt, "citation_ids": [], "abstained": False}, ensure_ascii=False)[:budget]


_EMPTY = len(_stub("", 1000))


def generation_retry(spark, sf):
    out = agent.generated(_questions(spark, sf).select("qid", "question"), _stub, 48)
    return out.select("qid", "answer", "abstained", "attempts", "generation_error")


def settled_answers(spark, sf):
    c = load(spark, sf, "conversations", "conv_id", "turn", "role", "text").where("role <> 'user'")
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 5 == 3, F.lit("  ")).otherwise(F.col("text")).alias("answer"), F.array(F.lit("x")).alias("citation_ids"), (F.col("turn") % 4 == 1).alias("abstained"))
    return evaluation.settled(rows).select("conv_id", "turn", F.sha2("answer", 256).alias("sha"), F.size("citation_ids").cast("long").alias("citations"), "abstained")


def guardrail_pass_rate(spark, sf):
    r = evaluation.pass_rate(_guarded(spark, sf))
    return r.select("total", "passed", F.round("rate", 6).alias("rate"))


def guardrail_failing(spark, sf):
    return evaluation.failing(_guarded(spark, sf).withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id")


def run_totals(spark, sf):
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    return e.agg(F.count(F.lit(1)).alias("requests"), F.sum("user_id").alias("tokens"), F.round(F.sum("value"), 2).alias("latency"), F.count_if(F.col("event_id") % 3 == 0).alias("hits"), F.count_if(F.col("event_id") % 3 != 0).alias("misses"), F.count_if(F.col("event_type") == "error").alias("rejections"))


def question_set_errors(spark, sf):
    q = _questions(spark, sf).select((F.col("qid") % 5 != 0).alias("is_answerable"), F.when(F.col("hop_count") != 3, F.col("hop_count")).alias("hop_count"), F.when(F.col("qid") % 6 == 0, "pending").otherwise("verified").alias("review_status"))
    return evaluation.set_errors(q)


def _statuses(spark, sf):
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "ts")
    return relational.last_wins(e, "user_id", F.col("event_id"), "event_type", "ts")


def downloaded_unextracted(spark, sf):
    done = _statuses(spark, sf).where(F.col("event_type").isin("click", "purchase"))
    return relational.remaining(done.select("user_id", "event_type"), load(spark, sf, "labels", F.col("doc_id").alias("user_id")), "user_id")


def latest_downloads(spark, sf):
    known = load(spark, sf, "customer", "c_custkey", "c_nationkey").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return _statuses(spark, sf).join(known, "user_id", "left").select("user_id", F.col("event_type").alias("status"), F.coalesce("c_nationkey", F.year("ts")).cast("long").alias("origin"))


QUERIES = {f.__name__: f for f in (normalized_records, required_ids, corpus_flatten, corpus_supports, supporting_ids, extraction_chain, strict_triples, failing_kind_pairs, evidence_explode, validation_audit_rows, answer_inputs, citation_titles, subset_violations, ranking_equality, question_page, top_terms, stratified_sample, generation_retry, settled_answers, guardrail_pass_rate, guardrail_failing, run_totals, question_set_errors, downloaded_unextracted, latest_downloads)}

TURNS = "SELECT conv_id, turn, max(role) AS role, max(text) AS text FROM conversations GROUP BY ALL"
CONV = f"SELECT * FROM ({TURNS}) WHERE conv_id IN (SELECT conv_id FROM ({TURNS}) WHERE role = 'assistant')"
SUPPORT = f"SELECT conv_id AS qid, turn FROM ({CONV}) WHERE CASE WHEN conv_id % 3 = 0 THEN turn % 2 = 0 ELSE role = 'assistant' END"
PARA = "'para_' || substr(sha256(role || chr(10) || coalesce(text, '')), 1, 20)"
FAILED = f"SELECT * FROM ({TRIPLES}) WHERE coalesce(NOT {ACCEPTED}, true)"
LAST = "SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(ts, event_id) AS ts FROM events GROUP BY 1"
GUARDED = "SELECT conv_id, turn, turn % 11 <> 0 AND turn % 2 = 1 AND turn % 3 <> 0 AND NOT contains(answer, 'PHISHING-CANARY') AND NOT contains(lower(answer), 'system prompt') AS passed FROM (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN text || ' PHISHING-CANARY' WHEN conv_id % 7 = 0 THEN text || ' my System Prompt says' ELSE text END AS answer FROM conversations WHERE role <> 'user')"

SQL = {
    "normalized_records": f"SELECT qid, array_to_string(list(CAST(turn AS VARCHAR) ORDER BY turn), ',') AS supports, count(*) AS hop_count FROM ({SUPPORT}) GROUP BY qid",
    "required_ids": f"SELECT DISTINCT turn FROM ({SUPPORT}) WHERE qid % 2 = 0",
    "corpus_flatten": f"SELECT id, min(conv_id) AS qid, min_by(pos, (conv_id, pos)) AS pos FROM (SELECT {PARA} AS id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM ({CONV})) GROUP BY id",
    "corpus_supports": f"SELECT DISTINCT {PARA} AS id, conv_id AS qid FROM ({CONV}) WHERE role = 'assistant'",
    "supporting_ids": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id || ',' || (doc_id + 1) WHEN doc_id % 3 = 0 THEN 'p' || doc_id ELSE '' END AS ids, 'domain' AS track FROM documents",
    "extraction_chain": f"""WITH li AS MATERIALIZED (SELECT *, l_orderkey AS chunk, {NORM.format('p_name')} AS n, {NORM.format('p_brand')} AS b FROM ({LINE})),
  sp AS (SELECT chunk, a, min(id) AS lo, max(id) AS hi FROM (SELECT chunk, id, n AS a FROM li UNION ALL SELECT chunk, id, b FROM li) GROUP BY ALL), ok AS (SELECT chunk, a FROM sp WHERE lo = hi),
  t AS (SELECT 'PROPOSES' AS predicate, chunk, n AS a, l_linenumber AS ln, l_tax, l_discount FROM li UNION ALL SELECT 'EVALUATES_ON', chunk, b, l_linenumber, l_tax, l_discount FROM li),
  j AS (SELECT predicate, ok.a IS NOT NULL AS res, CASE WHEN ln = 3 THEN NULL WHEN l_tax > 0.07 THEN 1.5 ELSE round(1 - l_discount, 4) END AS conf FROM t LEFT JOIN ok ON ok.chunk = t.chunk AND ok.a = t.a)
  SELECT predicate, count(*) AS total, CAST(count_if(res) AS BIGINT) AS resolved, CAST(count_if(res AND coalesce(conf, 0) BETWEEN 0 AND 1) AS BIGINT) AS accepted_default, CAST(count_if(res AND conf BETWEEN 0 AND 1) AS BIGINT) AS accepted_strict FROM j GROUP BY 1""",
    "strict_triples": f"SELECT predicate, count(*) AS n, round(avg(conf), 6) AS mean FROM ({TRIPLES}) WHERE {ACCEPTED} GROUP BY 1",
    "failing_kind_pairs": f"SELECT predicate, 'Method' AS subject_kind, 'Dataset' AS object_kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM ({FAILED}))::DOUBLE, 6) AS share FROM ({FAILED}) GROUP BY 1 ORDER BY n DESC LIMIT 10",
    "evidence_explode": f"SELECT edge_id, chunk AS chunk_id, conf AS confidence FROM ({EDGE_EV})",
    "validation_audit_rows": "WITH c AS (SELECT DISTINCT l_orderkey AS chunk_id, 'm' || l_partkey AS subject_id, 'd' || l_suppkey AS object_id FROM lineitem), e AS (SELECT DISTINCT l_orderkey, 'm' || l_partkey AS id, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 2) SELECT chunk_id, subject_id, coalesce(p_name, 'UNKNOWN') AS subject, CASE WHEN p_name IS NULL THEN 'UNKNOWN' ELSE 'Method' END AS subject_kind, object_id, 'UNKNOWN' AS object, 'UNKNOWN' AS object_kind, o_orderpriority AS text FROM c JOIN orders ON o_orderkey = chunk_id AND o_orderkey % 7 <> 0 LEFT JOIN e ON e.l_orderkey = chunk_id AND e.id = subject_id",
    "answer_inputs": "SELECT DISTINCT p_name AS qid, l_orderkey AS doc, o_orderpriority FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 50",
    "citation_titles": "SELECT item_id AS qid, CAST(0 AS BIGINT) AS pos, CAST(item_id * 5 AS VARCHAR) AS citation, coalesce(source, '') AS title FROM benchmark LEFT JOIN documents ON doc_id = item_id * 5 UNION ALL SELECT item_id, 1, 'none', '' FROM benchmark",
    "subset_violations": "SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS extra FROM conversations WHERE turn < 2 AND role NOT IN ('user', 'assistant') GROUP BY 1",
    "ranking_equality": "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS p FROM documents WHERE doc_id % 10 <> 0) SELECT CAST(count_if(b.p IS NULL) AS BIGINT) AS only_left, CAST(count_if(a.p IS NULL) AS BIGINT) AS only_right, CAST(count_if(a.p <> b.p) AS BIGINT) AS moved FROM a FULL JOIN b USING (doc_id)",
    "question_page": f"SELECT qid, question FROM ({QUESTIONS}) ORDER BY qid LIMIT 20 OFFSET 5",
    "top_terms": f"SELECT term, n FROM (SELECT term, count(*) AS n, min((doc_id, pos)) AS f FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)) GROUP BY 1) ORDER BY n DESC, f LIMIT 10",
    "stratified_sample": "WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), q AS (SELECT *, CAST(300 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY lang) - 1 < 300 % count(*) OVER () THEN 1 ELSE 0 END AS BIGINT) AS even FROM s), b AS (SELECT *, least(size, even) AS base, greatest(size - even, 0) AS room FROM q), c AS (SELECT *, 300 - sum(base) OVER () AS spill, coalesce(sum(room) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b), k AS (SELECT lang, base + least(room, greatest(spill - before, 0)) AS quota FROM c), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('public:' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) SELECT doc_id, r.lang, place FROM r JOIN k ON r.lang = k.lang WHERE place <= quota",
    "generation_retry": f"SELECT qid, CASE WHEN n <= 192 THEN question ELSE '' END AS answer, n > 192 AS abstained, CAST(CASE WHEN n <= 48 THEN 1 WHEN n <= 96 THEN 2 ELSE 3 END AS BIGINT) AS attempts, CASE WHEN n > 192 THEN 'malformed JSON: JSONDecodeError' END AS generation_error FROM (SELECT *, {_EMPTY} + length(question) AS n FROM ({QUESTIONS}))",
    "settled_answers": "SELECT conv_id, turn, sha256(CASE WHEN gone THEN '' ELSE text END) AS sha, CAST(CASE WHEN gone THEN 0 ELSE 1 END AS BIGINT) AS citations, gone AS abstained FROM (SELECT *, turn % 4 = 1 OR turn % 5 = 3 OR trim(coalesce(text, '')) = '' AS gone FROM conversations WHERE role <> 'user')",
    "guardrail_pass_rate": f"SELECT count(*) AS total, CAST(count_if(passed) AS BIGINT) AS passed, round(count_if(passed) / count(*)::DOUBLE, 6) AS rate FROM ({GUARDED})",
    "guardrail_failing": f"SELECT conv_id || ':' || turn AS id FROM ({GUARDED}) WHERE NOT passed",
    "run_totals": "SELECT count(*) AS requests, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 2) AS latency, CAST(count_if(event_id % 3 = 0) AS BIGINT) AS hits, CAST(count_if(event_id % 3 <> 0) AS BIGINT) AS misses, CAST(count_if(event_type = 'error') AS BIGINT) AS rejections FROM events",
    "question_set_errors": "WITH c AS (SELECT count(*) AS n, count_if(item_id % 5 = 0) AS none, count_if(item_id % 3 = 0) AS h1, count_if(item_id % 3 = 1) AS h2, count_if(item_id % 6 = 0) AS o FROM benchmark) SELECT 'empty' AS rule FROM c WHERE n = 0 UNION ALL SELECT 'question count' FROM c WHERE n NOT BETWEEN 100 AND 150 UNION ALL SELECT 'unanswerable share' FROM c WHERE NOT coalesce(none / nullif(n, 0)::DOUBLE, 0) BETWEEN 0.10 AND 0.15 UNION ALL SELECT 'missing hop' FROM c UNION ALL SELECT 'unverified questions' FROM c WHERE o > 0",
    "downloaded_unextracted": f"SELECT user_id, event_type FROM ({LAST}) WHERE event_type IN ('click', 'purchase') AND user_id NOT IN (SELECT doc_id FROM labels)",
    "latest_downloads": f"SELECT e.user_id, event_type AS status, CAST(coalesce(c_nationkey, year(ts)) AS BIGINT) AS origin FROM ({LAST}) e LEFT JOIN customer ON c_custkey = e.user_id AND c_custkey % 3 = 0",
}
