"""Registered queries over answers, abstention, gates, resampling, the agent loop, caches and request streams.

Answers are whole assistant turns, gold answers the whole user turns next to them; scores are those of the lexical query; a
benchmark item with a document that contains it is answerable.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as tx
from ..operators import agent, evaluation, ranking, relational
from ..storage import cut
from ..streaming import requests
from .corpus import TOK, _questions, load
from .retrieval import CHUNK_ROWS, DENSE, DOCS, GOLD, NAMES, ORDERS, POISSON, QUESTIONS, RECALL, SHORT_Q, TOP, _expanded, _lexical, _name_vectors, _names, _order_texts, _order_vectors, _seeds, bm25_sql, expand_sql, gold_pairs, interval_sql


def _answers(spark, sf):
    """(id, conv_id, prediction, golds): assistant turns against the user's turns before and behind them."""
    turns = load(spark, sf, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id", "turn", "role").agg(F.max("text").alias("text"))
    asked = turns.where("role = 'user'")
    near = [asked.select("conv_id", (F.col("turn") + step).alias("turn"), F.col("text").alias(name)) for step, name in ((1, "before"), (-1, "behind"))]
    out = turns.where("role = 'assistant'").join(near[0], ["conv_id", "turn"], "left").join(near[1], ["conv_id", "turn"], "left")
    return out.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", F.col("text").alias("prediction"), F.array_compact(F.array("before", "behind")).alias("golds"))


ANSWERS = "WITH t AS (SELECT conv_id, turn, role, max(text) AS text FROM conversations GROUP BY ALL), u AS (SELECT * FROM t WHERE role = 'user') SELECT t.conv_id || ':' || t.turn AS id, t.conv_id AS conv_id, t.text AS prediction, list_filter([b.text, c.text], lambda x: x IS NOT NULL) AS golds FROM t LEFT JOIN u b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1 LEFT JOIN u c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1 WHERE t.role = 'assistant'"


def _norm(x):
    return rf"list_filter(string_split_regex(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def exact_match(spark, sf):
    a = _answers(spark, sf)
    loud = F.concat(F.lit("The "), F.element_at("golds", -1), F.lit("!"))
    return a.where(F.size("golds") > 0).select("id", metrics.exact_match(loud, F.col("golds")).alias("em"), metrics.exact_match(F.col("prediction"), F.col("golds")).alias("em_own"))


def token_f1(spark, sf):
    return metrics.token_f1_rows(_answers(spark, sf), "id", "prediction", "golds").select("id", F.round("f1", 6).alias("f1"))


def answer_metrics(spark, sf):
    """Per run of questions: how many, their mean F1 and its interval over 10,000 resamplings."""
    a = _answers(spark, sf)
    rows = metrics.token_f1_rows(a, "id", "prediction", "golds").join(a.select("id", (F.col("conv_id") % 4).alias("run")), "id").select("id", "run", F.round("f1", 9).alias("f1"))
    rows = cut(rows)
    means = rows.groupBy("run").agg(F.count(F.lit(1)).alias("question_count"), F.round(F.avg("f1"), 6).alias("mean_f1"))
    return means.join(metrics.bootstrap_hash(rows, "run", "f1", "id", "20260928", 10_000), "run").select("run", "question_count", "mean_f1", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _cited(spark, sf):
    """Citations of each question: its first and third result, and on every fourth item one that was not retrieved."""
    ranked = _lexical(spark, sf, 5)
    got = ranked.groupBy("qid").agg(F.collect_list(F.col("doc").cast("string")).alias("retrieved"), F.sort_array(F.collect_list(F.when(F.col("rank").isin(1, 3), F.struct("rank", F.col("doc").cast("string").alias("d"))))).alias("c"))
    made = F.when(F.col("qid") % 4 == 0, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))
    gone = F.col("qid") % 5 == 0
    cited = F.when(gone, F.array().cast("array<string>")).otherwise(F.concat(F.transform("c", lambda x: x["d"]), made))
    return got.select("qid", "retrieved", cited.alias("cited"), gone.alias("abstained"))


def citation_validity(spark, sf):
    cols = metrics.citation_columns(F.col("cited"), F.col("retrieved"), F.col("abstained"))
    return _cited(spark, sf).withColumns(cols).select("qid", "citation_valid", F.round("valid_citation_fraction", 6).alias("fraction"), F.array_join("unsupported_citation_ids", ",").alias("unsupported"))


def _records(spark, sf):
    """Request log as answer records: value is latency, type the group, purchases carry no cost."""
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    return e.select("event_type", F.col("value").alias("latency_seconds"), (F.col("event_id") % 3 == 0).alias("hit"), F.col("user_id").alias("input_tokens"), F.when(F.col("event_type") != "purchase", F.round(F.col("value") / 1000, 6)).alias("estimated_cost_usd"))


def answer_summary(spark, sf):
    s = evaluation.summary(_records(spark, sf), ["hit", "input_tokens"], "event_type")
    return s.select("event_type", "question_count", *(F.round(c, 6).alias(c) for c in ("mean_hit", "mean_input_tokens", "p50_latency", "p95_latency")), F.round("cost", 3).alias("cost"))


def floor_percentiles(spark, sf):
    r = relational.low_ranks(load(spark, sf, "events", "user_id", "value"), "user_id", "value", {"p50": 0.5, "p95": 0.95})
    return r.select("user_id", *(F.round(c, 6).alias(c) for c in ("p50", "p95")))


def _scores(spark, sf):
    top = _questions(spark, sf).select("qid").join(_lexical(spark, sf, 1).select("qid", "score"), "qid", "left")
    known = gold_pairs(spark, sf).select("qid").distinct().withColumn("positive", F.lit(True))
    rows = top.join(known, "qid", "left").select("qid", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.coalesce("positive", F.lit(False)).alias("positive"))
    return cut(rows)  # read several times


SCORES = f"WITH {bm25_sql('b', DOCS, QUESTIONS, 1)}, gold AS MATERIALIZED ({GOLD}), sc AS MATERIALIZED (SELECT item_id AS qid, round(coalesce(score, 0), 6) AS score, item_id IN (SELECT qid FROM gold) AS positive FROM benchmark LEFT JOIN br ON item_id = qid)"


def abstention_rates(spark, sf):
    s = _scores(spark, sf)
    gone = (F.col("score") < 30) | (F.col("qid") % 6 == 0)
    r = s.select(F.col("positive").alias("is_answerable"), gone.alias("abstained"), (gone != F.col("positive")).alias("abstention_correct"), F.when(F.col("qid") % 7 == 0, "malformed").alias("generation_error"))
    a = evaluation.abstention(r)
    return a.select(*(c if t == "bigint" else F.round(c, 6).alias(c) for c, t in a.dtypes))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


def abstention_threshold_sweep(spark, sf):
    return _rounded(evaluation.threshold_sweep(_scores(spark, sf)))


def best_threshold(spark, sf):
    return _rounded(evaluation.best_threshold(evaluation.threshold_sweep(_scores(spark, sf))))


def rank_auc(spark, sf):
    return _rounded(evaluation.rank_auc(_scores(spark, sf)))


def _recalls(spark, sf):
    questions, gold = _questions(spark, sf), gold_pairs(spark, sf)
    q = questions.join(gold.select("qid").distinct(), "qid", "left_semi").select("qid", "hop_count")
    short = ranking.bm25(load(spark, sf, "documents", "doc_id", "text"), "doc_id", F.col("text"), questions, "qid", F.array_join(F.slice(tx.terms("question"), 1, 4), " "), 5)
    return evaluation.recall(_lexical(spark, sf, 5), gold, q, 5), evaluation.recall(short, gold, q, 5)


def paired_delta(spark, sf):
    d = cut(evaluation.paired(*_recalls(spark, sf), "recall"))
    r = evaluation.by_hop_interval(d, "delta", "qid", "20261001")
    return r.select("hop", "questions", *(F.round(a, 6).alias(b) for a, b in (("mean", "delta"), ("lo", "lo"), ("hi", "hi"))))


def quality_gate(spark, sf):
    means = evaluation.by_hop(_recalls(spark, sf)[1], "recall").select(F.concat(F.lit("hop"), F.coalesce("hop", F.lit(0)).cast("string")).alias("name"), F.round("mean", 6).alias("value"))
    floors = spark.createDataFrame([("hop0", 0.42), ("hop1", 0.99), ("hop2", 0.1), ("hop9", 0.1)], "name string, floor double")
    return evaluation.gate(means, floors)


def bootstrap_ci_hash(spark, sf):
    c = metrics.bootstrap_hash(load(spark, sf, "labels", "doc_id", "quality", "toxic"), "toxic", "quality", "doc_id", "20260928", 10_000)
    return c.select("toxic", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def bootstrap_ci_mt(spark, sf):
    a = _answers(spark, sf)
    rows = metrics.token_f1_rows(a, "id", "prediction", "golds").join(a.select("id", (F.col("conv_id") % 4).alias("run")), "id")
    return metrics.bootstrap_mt(rows, "run", "f1", "id", 20260928)


def _guarded(spark, sf):
    c = load(spark, sf, "conversations", "conv_id", "turn", "role", "text").where("role <> 'user'")
    poison = F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit(" PHISHING-CANARY"))).when(F.col("conv_id") % 7 == 0, F.concat("text", F.lit(" my System Prompt says"))).otherwise(F.col("text"))
    cites = F.when(F.col("turn") % 3 == 0, F.array(F.lit("s"), F.lit("x"))).otherwise(F.array(F.lit("s")))
    rows = c.select("conv_id", "turn", poison.alias("answer"), (F.col("turn") % 11 == 0).alias("abstained"), (F.col("turn") % 2 == 1).alias("citation_valid"), cites.alias("citation_ids"), F.lit("s").alias("support_id"), F.lit("x").alias("attack_id"))
    return evaluation.guardrails(rows)


def guardrail_checks(spark, sf):
    return _guarded(spark, sf).select("conv_id", "turn", "answered", "cites_valid", "cites_support", "no_canary", "no_attack_cited", "no_prompt_echo", "passed")


def short_query_fallback(spark, sf):
    b = _questions(spark, sf)
    query = F.array_join(F.slice(F.split("question", " "), 1, (1 + F.col("qid") % 5).cast("int")), " ")
    return b.select("qid", tx.fallback_query(query, F.col("question")).alias("query"))


def _results(spark, sf):
    """Three tool calls per user in the log: documents stand for the event's value bucket, ranks follow time."""
    from pyspark.sql import Window

    e = load(spark, sf, "events", "event_id", "user_id", "value", "ts")
    doc = F.floor(F.col("value") / 5).cast("long")
    step = (F.col("event_id") % 3 + 1).cast("int")
    order = Window.partitionBy("user_id", "step").orderBy("event_id")
    rows = e.select(F.col("user_id").alias("qid"), "event_id", doc.alias("doc"), F.round("value", 6).alias("score"), step.alias("step"))
    first = rows.groupBy("qid", "step", "doc").agg(F.min_by(F.struct("event_id", "score"), "event_id").alias("f")).select("qid", F.col("qid").alias("user_id"), "step", "doc", F.col("f.event_id").alias("event_id"), F.col("f.score").alias("score"))
    return first.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5")


RESULTS = "SELECT qid, step, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, step ORDER BY event_id) AS rank FROM (SELECT user_id AS qid, event_id % 3 + 1 AS step, CAST(floor(value / 5) AS BIGINT) AS doc, min(event_id) AS event_id, round(min_by(value, event_id), 6) AS score FROM events GROUP BY ALL)) WHERE rank <= 5"
FUSED = f"SELECT qid, doc, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max_by(score, step) AS score, max(step) AS last_step, max_by(rank, step) AS last_rank FROM ({RESULTS}) GROUP BY ALL"


def agent_evidence_fusion(spark, sf):
    a = agent.accumulated(_results(spark, sf))
    return a.select("qid", "doc", F.round("rrf", 9).alias("rrf"), "score", F.col("last_step").cast("long").alias("last_step"), "last_rank")


def planner_context(spark, sf):
    return agent.planner_context(agent.accumulated(_results(spark, sf)), 5).select("qid", "doc", "place")


def answer_context(spark, sf):
    return agent.answer_context(agent.accumulated(_results(spark, sf)), 5).select("qid", "doc", "place")


def agent_batch_run(spark, sf):
    """Questions about parts over orders as passages: the keyword tool is BM25, the vector tool cosine search, the graph tool
    expansion from lexical seeds."""
    orders = cut(_order_texts(spark, sf))
    vectors, names = _order_vectors(spark, sf), _name_vectors(spark, sf)

    def keyword(q):
        return ranking.bm25(orders, "l_orderkey", F.col("text"), q, "qid", F.col("question"), 5)

    def vector(q):
        return ranking.dense(vectors, "id", "embedding", names.join(q.select(F.col("qid").alias("id")), "id"), "id", "embedding", 5)

    def graph_tool(q):
        return _expanded(spark, sf, 1, seeds=_seeds(spark, sf, 2, q))[1]

    out = agent.run(_names(spark, sf), orders.select(F.col("l_orderkey").alias("doc"), "text"), {"keyword": keyword, "vector": vector, "graph": graph_tool})
    return out.select("qid", "answer", F.array_join("citation_ids", ",").alias("citations"), "abstained", "stop_reason", "steps")


def rate_limiter(spark, sf):
    e = load(spark, sf, "events", "event_id", "user_id", "ts").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return requests.limited(e, 5, 86_400.0).select("user_id", "event_id", "admitted")


def cache_hit_miss(spark, sf):
    items = load(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = items.where("doc_id % 3 = 0").select("key").distinct().withColumn("result", F.substring("key", 1, 8))
    hits, misses = relational.lookup(items, cache, "key")
    return hits.select("doc_id", F.lit("hit").alias("state"), "result").unionByName(misses.select("doc_id", F.lit("miss").alias("state"), F.lit(None).cast("string").alias("result")))


def manifest_latest_status(spark, sf):
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    return relational.last_wins(e, "user_id", F.col("event_id"), "event_type", "value").select("user_id", "event_type", F.round("value", 6).alias("value"))


def resume_remaining(spark, sf):
    done = load(spark, sf, "labels", "doc_id")
    return relational.remaining(load(spark, sf, "documents", "doc_id", "source"), done, "doc_id")


def trace_summary(spark, sf):
    e = load(spark, sf, "events", "event_type", "user_id", "value")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 3).alias("total"), F.count_if(F.col("value") > 50).alias("slow"))


def minute_counts(spark, sf):
    e = load(spark, sf, "events", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    m = requests.minute_counts(e)
    return m.select(F.unix_seconds("start").alias("start"), "n", F.round("mean", 6).alias("mean"))


QUERIES = {f.__name__: f for f in (exact_match, token_f1, answer_metrics, citation_validity, answer_summary, floor_percentiles, abstention_rates, abstention_threshold_sweep, best_threshold, rank_auc, paired_delta, quality_gate, bootstrap_ci_hash, bootstrap_ci_mt, guardrail_checks, short_query_fallback, agent_evidence_fusion, planner_context, answer_context, agent_batch_run, rate_limiter, cache_hit_miss, manifest_latest_status, resume_remaining, trace_summary, minute_counts)}

F1 = f"""SELECT id, round(coalesce(max(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN len(p) = 0 OR len(g) = 0 THEN 0 ELSE 2.0::DOUBLE * list_sum(list_transform(list_concat(list_distinct(p), []), lambda w: least(len(list_filter(p, lambda v: v = w)), len(list_filter(g, lambda v: v = w))))) / (len(p) + len(g)) END), 0), 9) AS f1
FROM (SELECT id, {_norm('prediction')} AS p, CASE WHEN gold IS NOT NULL THEN {_norm('gold')} END AS g FROM (SELECT id, prediction, unnest(CASE WHEN len(golds) = 0 THEN [NULL] ELSE golds END) AS gold FROM ({ANSWERS}))) GROUP BY id"""
SWEEP = f"{SCORES}, ends AS (SELECT min(score) AS lo, max(score) AS hi, max(score) FILTER (NOT positive) AS neg FROM sc), th AS (SELECT DISTINCT unnest(list_concat(list(score), [min(score) - 1, max(score) + 1, max(score) FILTER (NOT positive) + 1e-9])) AS threshold FROM sc), sw AS (SELECT threshold, count_if(positive AND score >= threshold) / count_if(positive)::DOUBLE AS r, count_if(NOT positive AND score < threshold) / count_if(NOT positive)::DOUBLE AS j FROM th, sc GROUP BY 1)"
SWEEP_ROW = "SELECT round(threshold, 6) AS threshold, round(r, 6) AS answerable_recall, round(j, 6) AS unanswerable_rejection_rate, round((r + j) / 2, 6) AS balanced_accuracy FROM sw"
PAIRED = f"WITH {bm25_sql('b', DOCS, QUESTIONS, 5)}, {bm25_sql('c', 'SELECT doc_id AS doc, text AS txt FROM documents', SHORT_Q, 5)}, gold AS MATERIALIZED ({GOLD}), ans AS (SELECT * FROM ({QUESTIONS}) WHERE qid IN (SELECT qid FROM gold)), x AS ({RECALL.format('br')}), y AS ({RECALL.format('cr')})"
_LOW = "list_sort(list({0}))[CAST(floor({1} * (count(*) - 1)) AS BIGINT) + 1]"
_GONE = "(score < 30 OR qid % 6 = 0)"
_RATE = "round(count_if({0} AND {1}) / nullif(count_if({1}), 0)::DOUBLE, 6)"
CITED = f"""WITH {bm25_sql('b', DOCS, QUESTIONS, 5)}, c AS (SELECT qid, list(CAST(doc AS VARCHAR)) AS retrieved, qid % 5 = 0 AS abstained,
  CASE WHEN qid % 5 = 0 THEN [] ELSE list_concat(list(CAST(doc AS VARCHAR) ORDER BY rank) FILTER (rank IN (1, 3)), CASE WHEN qid % 4 = 0 THEN ['none'] ELSE [] END) END AS cited FROM br GROUP BY qid),
  d AS (SELECT *, list_filter(cited, lambda x: NOT list_contains(retrieved, x)) AS bad FROM c)"""

SQL = {
    "exact_match": f"SELECT id, CAST(list_contains(list_transform(golds, lambda g: array_to_string({_norm('g')}, ' ')), array_to_string({_norm(chr(39) + 'The ' + chr(39) + ' || golds[-1] || ' + chr(39) + '!' + chr(39))}, ' ')) AS DOUBLE) AS em, CAST(list_contains(list_transform(golds, lambda g: array_to_string({_norm('g')}, ' ')), array_to_string({_norm('prediction')}, ' ')) AS DOUBLE) AS em_own FROM ({ANSWERS}) WHERE len(golds) > 0",
    "token_f1": f"SELECT id, round(f1, 6) AS f1 FROM ({F1})",
    "answer_metrics": f"WITH f AS MATERIALIZED (SELECT id, CAST(split_part(id, ':', 1) AS BIGINT) % 4 AS run, f1 FROM ({F1})) SELECT run, question_count, mean_f1, lo, hi FROM (SELECT run, count(*) AS question_count, round(avg(f1), 6) AS mean_f1 FROM f GROUP BY 1) JOIN ({interval_sql('SELECT * FROM f', 'run', 'f1', 'id', '20260928')}) USING (run)",
    "agent_batch_run": f"""WITH {expand_sql(1)}, {bm25_sql('x', ORDERS, NAMES, 5)}, {DENSE},
  rs AS (SELECT qid, CAST(doc AS VARCHAR) AS doc, rank, 1 AS step FROM xr UNION ALL SELECT qid, CAST(doc AS VARCHAR), rank, 2 FROM de WHERE rank <= 5 UNION ALL SELECT qid, CAST(doc AS VARCHAR), rank, 3 FROM ({CHUNK_ROWS.format('v1')}) WHERE rank <= 5),
  ac AS (SELECT qid, doc, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(step) AS last_step, max_by(rank, step) AS last_rank FROM rs GROUP BY ALL),
  bp AS (SELECT qid, doc FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY last_step DESC, round(rrf, 12) DESC, last_rank, doc) AS place FROM ac) WHERE place = 1),
  tx AS (SELECT CAST(doc AS VARCHAR) AS doc, txt FROM ({ORDERS}))
  SELECT n.qid, CASE WHEN tx.doc IS NULL OR trim(substr(txt, 1, 120)) = '' THEN '' ELSE substr(txt, 1, 120) END AS answer, CASE WHEN tx.doc IS NULL THEN '' ELSE tx.doc END AS citations, tx.doc IS NULL AS abstained,
  CASE WHEN tx.doc IS NULL THEN 'insufficient_evidence' ELSE 'planner_finished' END AS stop_reason, CAST(3 AS BIGINT) AS steps FROM ({NAMES}) n LEFT JOIN bp USING (qid) LEFT JOIN tx ON tx.doc = bp.doc""",
    "rate_limiter": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS n FROM events),
  r AS (SELECT user_id, event_id, n, true AS admitted, [s] AS log FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(left_) < 5, CASE WHEN len(left_) < 5 THEN list_append(left_, s) ELSE left_ END FROM (SELECT e.user_id, e.event_id, e.n, e.s, list_filter(r.log, lambda x: e.s - x < 86400.0) AS left_ FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
  SELECT user_id, event_id, admitted FROM r""",
    "citation_validity": f"{CITED} SELECT qid, CASE WHEN abstained THEN len(cited) = 0 ELSE len(cited) > 0 AND len(bad) = 0 END AS citation_valid, round(CASE WHEN len(cited) > 0 THEN (len(cited) - len(bad)) / len(cited)::DOUBLE WHEN abstained THEN 1 ELSE 0 END, 6) AS fraction, array_to_string(bad, ',') AS unsupported FROM d",
    "answer_summary": f"SELECT event_type, count(*) AS question_count, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS mean_hit, round(avg(user_id), 6) AS mean_input_tokens, round({_LOW.format('value', 0.5)}, 6) AS p50_latency, round({_LOW.format('value', 0.95)}, 6) AS p95_latency, CASE WHEN event_type <> 'purchase' THEN round(sum(round(value / 1000, 6)), 3) END AS cost FROM events GROUP BY 1",
    "floor_percentiles": f"SELECT user_id, round({_LOW.format('value', 0.5)}, 6) AS p50, round({_LOW.format('value', 0.95)}, 6) AS p95 FROM events GROUP BY 1",
    "abstention_rates": f"{SCORES}, a AS (SELECT *, {_GONE} AS gone, qid % 7 = 0 AS failed FROM sc) SELECT count(*) AS question_count, round(avg(CASE WHEN gone <> positive THEN 1.0::DOUBLE ELSE 0 END), 6) AS abstention_accuracy, CAST(count_if(NOT positive) AS BIGINT) AS unanswerable_count, {_RATE.format('gone', 'NOT positive')} AS unanswerable_abstention_rate, {_RATE.format('gone', '(NOT positive AND NOT failed)')} AS model_only_unanswerable_abstention_rate, {_RATE.format('NOT gone', 'NOT positive')} AS unanswerable_answer_rate, CAST(count_if(failed) AS BIGINT) AS generation_failure_count, CAST(count_if(positive) AS BIGINT) AS answerable_count, {_RATE.format('NOT gone', 'positive')} AS answerable_response_rate FROM a",
    "abstention_threshold_sweep": f"{SWEEP} {SWEEP_ROW}",
    "best_threshold": f"{SWEEP} {SWEEP_ROW} ORDER BY (r + j) / 2 DESC, j DESC, sw.threshold LIMIT 1",
    "rank_auc": f"{SCORES} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc FROM sc p, sc n WHERE p.positive AND NOT n.positive",
    "paired_delta": f"{PAIRED}, dl AS MATERIALIZED (SELECT qid, unnest([0, hop_count]) AS hop, x.recall - y.recall AS delta FROM x JOIN y USING (qid, hop_count)) SELECT hop, questions, delta, lo, hi FROM (SELECT hop, count(*) AS questions, round(avg(delta), 6) AS delta FROM dl GROUP BY 1) JOIN ({interval_sql('SELECT * FROM dl', 'hop', 'delta', 'qid', '20261001')}) USING (hop)",
    "quality_gate": f"{PAIRED}, m AS (SELECT 'hop' || coalesce(hop_count, 0) AS name, round(avg(recall), 6) AS value FROM y GROUP BY ROLLUP (hop_count)) SELECT f.name, floor, value, coalesce(value >= floor, false) AS passed FROM (VALUES ('hop0', 0.42::DOUBLE), ('hop1', 0.99), ('hop2', 0.1), ('hop9', 0.1)) f(name, floor) LEFT JOIN m USING (name)",
    "bootstrap_ci_hash": f"WITH d AS (SELECT toxic, quality, r, {POISSON} AS w FROM (SELECT toxic, quality, r, CAST('0x' || substr(md5('20260928:' || r || ':' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM labels, range(10000) t(r))), m AS (SELECT toxic, r, round(coalesce(sum(quality * w)::DOUBLE / nullif(sum(w), 0), 0), 9) AS m FROM d GROUP BY ALL) SELECT toxic, round({_LOW.format('m', 0.025)}, 6) AS lo, round({_LOW.format('m', 0.975)}, 6) AS hi FROM m GROUP BY 1",
    "guardrail_checks": "WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN text || ' PHISHING-CANARY' WHEN conv_id % 7 = 0 THEN text || ' my System Prompt says' ELSE text END AS answer FROM conversations WHERE role <> 'user'), k AS (SELECT conv_id, turn, turn % 11 <> 0 AS answered, turn % 2 = 1 AS cites_valid, true AS cites_support, NOT contains(answer, 'PHISHING-CANARY') AS no_canary, turn % 3 <> 0 AS no_attack_cited, NOT contains(lower(answer), 'system prompt') AS no_prompt_echo FROM c) SELECT *, answered AND cites_valid AND no_canary AND no_attack_cited AND no_prompt_echo AS passed FROM k",
    "short_query_fallback": f"SELECT qid, CASE WHEN len({TOK.format('s')}) < 3 THEN question ELSE s END AS query FROM (SELECT qid, question, array_to_string(string_split(question, ' ')[1:1 + qid % 5], ' ') AS s FROM ({QUESTIONS}))",
    "agent_evidence_fusion": f"SELECT qid, doc, round(rrf, 9) AS rrf, score, last_step, last_rank FROM ({FUSED})",
    "planner_context": f"SELECT qid, doc, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY last_step DESC, last_rank, CAST(doc AS VARCHAR)) AS place FROM ({FUSED})) WHERE place <= 3",
    "answer_context": f"SELECT qid, doc, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY last_step DESC, round(rrf, 12) DESC, last_rank, CAST(doc AS VARCHAR)) AS place FROM ({FUSED})) WHERE place <= 5",
    "cache_hit_miss": "WITH i AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT DISTINCT key FROM i WHERE doc_id % 3 = 0) SELECT doc_id, CASE WHEN c.key IS NULL THEN 'miss' ELSE 'hit' END AS state, CASE WHEN c.key IS NOT NULL THEN substr(i.key, 1, 8) END AS result FROM i LEFT JOIN c ON i.key = c.key",
    "manifest_latest_status": "SELECT user_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 6) AS value FROM events GROUP BY 1",
    "resume_remaining": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "trace_summary": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 3) AS total, CAST(count_if(value > 50) AS BIGINT) AS slow FROM events GROUP BY 1",
    "minute_counts": "SELECT CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
}
