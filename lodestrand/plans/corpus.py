"""Registered queries over text, chunks and corpus curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, relational
from ..sources import html as html_source

TOK = r"regexp_extract_all(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"
NORM = "array_to_string(" + TOK + ", ' ')"


def load(spark, sf, name, *columns):
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def tokenize_terms(spark, sf):
    t = tx.terms("text")
    d = load(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.sha2(F.array_join(t, " "), 256).alias("terms_sha256"))


def normalize_names(spark, sf):
    p = load(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", tx.normalize_name(F.concat_ws(" - ", "p_name", "p_brand")).alias("name"))


def normalize_answers(spark, sf):
    b = load(spark, sf, "benchmark", "item_id", "text")
    return b.select("item_id", tx.normalize_answer("text").alias("answer"))


def stable_entity_ids(spark, sf):
    p = load(spark, sf, "part", "p_partkey", "p_name")
    return p.select("p_partkey", tx.entity_id(F.lit("Method"), F.col("p_name")).alias("entity_id"))


def content_hash_dedup(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "source", "text").withColumn("sha", tx.content_hash(tx.document_text("source", "text")))
    return d.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def text_cleanup(spark, sf):
    c = tx.clean_text("text")
    return load(spark, sf, "documents", "doc_id", "text").select("doc_id", F.length(c).cast("long").alias("n_chars"), F.sha2(c, 256).alias("sha"))


def html_links(spark, sf):
    return html_source.links(load(spark, sf, "pages", "page_id", "html"))


def html_fields(spark, sf):
    return html_source.fields(load(spark, sf, "pages", "page_id", "html"), ["content", "nav", "title"])


def chunk_documents(spark, sf):
    c = chunking.chunks(load(spark, sf, "documents", "doc_id", "text"), "text", 100, 15)
    cid = tx.chunk_id(F.col("doc_id").cast("string"), F.col("start"), F.col("chunk_text"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), cid.alias("chunk_id"))


def page_passages(spark, sf):
    p = chunking.passages(load(spark, sf, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text", 40, 8)
    return p.select("conv_id", "turn", F.col("page_chunk_index").cast("long").alias("page_chunk_index"), F.col("chunk_index").cast("long").alias("chunk_index"), "id")


def overlap_windows(spark, sf):
    w = chunking.encoder_windows(load(spark, sf, "documents", "doc_id", "text"), "text", 128)
    return w.select("doc_id", F.col("start").cast("long").alias("start"), F.sha2("chunk_text", 256).alias("sha"))


def window_mean_pool(spark, sf):
    p = chunking.pooled(load(spark, sf, "embeddings", "label", "embedding"), "label", "embedding")
    return p.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


#: Terms that score a text, with their weights: the role that title and abstract terms play in curation.
RELEVANCE = (("the", 5), ("der", 3), ("que", 3), ("token", 1), ("licensed", 2))


def _scored(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text", "source", "lang", "n_chars")
    low = F.lower(F.coalesce("text", F.lit("")))
    parts = [F.when(F.contains(low, F.lit(w)), n).otherwise(0) for w, n in RELEVANCE]
    reasons = F.array_join(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w, _ in RELEVANCE))), ",")
    must = F.contains(low, F.lit("en")) & (F.contains(low, F.lit("er")) | F.contains(low, F.lit("an")))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return d.where(must).select("doc_id", "source", "lang", "n_chars", total.cast("long").alias("score"), reasons.alias("reasons"))


SCORED = "SELECT doc_id, source, lang, n_chars, CAST({0} AS BIGINT) AS score, concat_ws(',', {1}) AS reasons FROM (SELECT *, lower(coalesce(text, '')) AS low FROM documents) WHERE contains(low, 'en') AND (contains(low, 'er') OR contains(low, 'an'))".format(
    " + ".join(f"CASE WHEN contains(low, '{w}') THEN {n} ELSE 0 END" for w, n in RELEVANCE), ", ".join(f"CASE WHEN contains(low, '{w}') THEN '{w}' END" for w, _ in RELEVANCE)
)


def relevance_score(spark, sf):
    return _scored(spark, sf).select("doc_id", "score", "reasons")


def top_n_per_group(spark, sf):
    out = relational.top_n(_scored(spark, sf), "source", 3, F.desc("score"), F.col("doc_id").cast("string"))
    return out.select("source", "place", "doc_id", "score")


def hash_sample_per_group(spark, sf):
    out = relational.hash_sample(load(spark, sf, "documents", "doc_id", "lang"), "doc_id", 5, "20260928", "lang")
    return out.select("lang", "place", "doc_id")


def quota_selection(spark, sf):
    out = relational.quota_selection(_scored(spark, sf), "source", 47, F.desc("score"), F.col("doc_id").cast("string"))
    return out.select("source", "place", "quota", "doc_id")


def first_n_per_group(spark, sf):
    out = relational.top_n(load(spark, sf, "conversations", "conv_id", "turn", "role"), "conv_id", 2, F.col("turn"))
    return out.select("conv_id", "place", "turn", "role")


def stratified_allocation(spark, sf):
    return relational.stratified_quotas(load(spark, sf, "documents", "lang"), "lang", 300)


def _required(spark, sf):
    return load(spark, sf, "labels", "doc_id", "quality").where("quality = 1").select("doc_id").distinct()


def corpus_inventory(spark, sf):
    d, need = _scored(spark, sf), _required(spark, sf).withColumn("required", F.lit(True))
    chunked = chunking.chunks(load(spark, sf, "documents", "doc_id", "text"), "text", 100, 15).groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"))
    j = d.join(chunked, "doc_id").join(need, "doc_id", "left")
    return j.where((F.col("n_chars") > 0) & ((F.col("score") >= 6) | F.col("required"))).select("doc_id", "score", "passages", F.when(F.col("score") < 6, "required_source").otherwise("relevance").alias("reason"))


def coverage_anti_join(spark, sf):
    return relational.missing(load(spark, sf, "documents", "doc_id"), "doc_id", load(spark, sf, "labels", "doc_id"), "doc_id").select(F.col("missing").alias("doc_id"))


def corpus_audit_pivot(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    n = lambda cond: F.count_if(cond)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), n(F.col("n_chars") == 0).alias("empty"), n(F.col("quality") == 1).alias("good"), n(F.col("quality") == 0).alias("poor"), n(F.col("quality").isNull()).alias("unlabelled"))


def evidence_resolution(spark, sf):
    refs = load(spark, sf, "conversations", "conv_id", "turn", "role", "text").where((F.col("role") == "user") & (F.size(tx.words("text")) > 0)).select("conv_id", F.col("turn").alias("page"), F.lit(0).alias("page_chunk_index"))
    p = chunking.passages(load(spark, sf, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text", 40, 8)
    j = relational.must_join(refs, p.select("conv_id", F.col("turn").alias("page"), F.col("page_chunk_index").cast("int").alias("page_chunk_index"), "id"), ["conv_id", "page", "page_chunk_index"], "evidence without a passage")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "id"))), lambda x: x["id"])
    return j.groupBy("conv_id").agg(F.count(F.lit(1)).alias("refs"), F.array_join(F.array_distinct(listed), ",").alias("ids"))


def inventory_semi_join(spark, sf):
    need = _required(spark, sf)
    return load(spark, sf, "documents", "doc_id", "source", "n_chars").join(need, "doc_id", "left_semi")


def exclude_prior(spark, sf):
    seen = load(spark, sf, "labels", "doc_id", "toxic").where("toxic = 1").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("paper"))
    d = load(spark, sf, "documents", "doc_id", "source").withColumn("key", F.col("doc_id").cast("string"))
    return d.join(seen.select(F.regexp_replace("paper", "^doc:", "").alias("key")), "key", "left_anti").select("doc_id", "source")


def corpus_dedup_supports(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "source", "text").join(load(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    d = d.withColumn("id", tx.paragraph_id(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))))
    good = F.when(F.col("quality") == 1, F.col("doc_id"))
    return d.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("quality") == 1).alias("n_supporting"), F.min(good).alias("first_supporting"), F.max(good).alias("last_supporting"))


def _questions(spark, sf):
    """Benchmark items as questions: the first twelve terms ask, hop buckets are synthetic (1 + item_id mod 3)."""
    b = load(spark, sf, "benchmark", "item_id", "text")
    return b.select(F.col("item_id").alias("qid"), "text", F.array_join(F.slice(tx.terms("text"), 1, 12), " ").alias("question"), (1 + F.col("item_id") % 3).alias("hop_count"))


def question_validator(spark, sf):
    from ..operators.evaluation import question_errors

    q = _questions(spark, sf)
    none = F.array().cast("array<string>")
    rows = q.select(
        F.col("qid").cast("string").alias("id"), F.when(F.col("qid") % 11 == 0, "").otherwise(F.col("question")).alias("question"), (F.col("hop_count") + F.when(F.col("qid") % 7 == 0, 5).otherwise(0)).cast("int").alias("hop_count"),
        (F.col("qid") % 5 != 0).alias("is_answerable"), F.when(F.col("qid") % 3 == 0, none).otherwise(F.array(F.col("question"))).alias("gold_answers"),
        F.when(F.col("qid") % 4 == 0, none).otherwise(F.array((F.col("qid") * 40).cast("string"))).alias("supporting_passage_ids"), F.when(F.col("qid") % 6 == 0, "draft").otherwise("verified").alias("review_status"),
    )
    docs = load(spark, sf, "documents", F.col("doc_id").cast("string").alias("id"))
    return question_errors(rows, docs)


QUERIES = {f.__name__: f for f in (tokenize_terms, normalize_names, normalize_answers, stable_entity_ids, content_hash_dedup, text_cleanup, html_links, html_fields, chunk_documents, page_passages, overlap_windows, window_mean_pool, relevance_score, top_n_per_group, hash_sample_per_group, quota_selection, first_n_per_group, stratified_allocation, corpus_inventory, coverage_anti_join, corpus_audit_pivot, evidence_resolution, inventory_semi_join, exclude_prior, corpus_dedup_supports, question_validator)}

CHUNKED = "SELECT doc_id, s AS start, array_to_string(w[s + 1:s + 100], ' ') AS chunk_text FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) > 0 THEN range(0, len(w), 85) ELSE [] END) AS s FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM documents)) WHERE s = 0 OR s - 85 + 100 < len(w)"
PASSAGES = """SELECT conv_id, turn, s // 32 AS page_chunk_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn, s) - 1 AS chunk_index, chunk_text FROM (
  SELECT conv_id, turn, s, array_to_string(w[s + 1:s + 40], ' ') AS chunk_text FROM (SELECT conv_id, turn, w, unnest(CASE WHEN len(w) > 0 THEN range(0, len(w), 32) ELSE [] END) AS s
  FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM conversations)) WHERE s = 0 OR s - 32 + 40 < len(w))"""
PASSAGE_ID = "'passage_' || substr(sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) || ':' || chunk_text), 1, 24)"

SQL = {
    "tokenize_terms": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, sha256(array_to_string(t, ' ')) AS terms_sha256 FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)",
    "normalize_names": f"SELECT p_partkey, {NORM.format('''p_name || ' - ' || p_brand''')} AS name FROM part",
    "normalize_answers": r"SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(replace(lower(text), 'ß', 'ss'), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM benchmark",
    "stable_entity_ids": f"SELECT p_partkey, 'method_' || substr(sha256('Method:' || {NORM.format('p_name')}), 1, 20) AS entity_id FROM part",
    "content_hash_dedup": "SELECT sha256(trim(coalesce(source, '') || chr(10) || coalesce(text, ''))) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "text_cleanup": r"SELECT doc_id, CAST(length(c) AS BIGINT) AS n_chars, sha256(c) AS sha FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(0), ''), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS c FROM documents)",
    "html_links": "SELECT page_id, CAST(n - 1 AS BIGINT) AS pos, h AS href FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS n FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1) AS l FROM pages))",
    "chunk_documents": f"SELECT doc_id, s // 85 AS chunk_index, s AS start, 'chunk_' || substr(sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(s AS VARCHAR) || ':' || chunk_text), 1, 16) AS chunk_id FROM (SELECT doc_id, start AS s, chunk_text FROM ({CHUNKED}))",
    "page_passages": f"SELECT conv_id, turn, page_chunk_index, chunk_index, {PASSAGE_ID} AS id FROM ({PASSAGES})",
    "overlap_windows": "SELECT doc_id, s AS start, sha256(array_to_string(w[s + 1:s + 128], ' ')) AS sha FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 128 THEN [0] ELSE range(0, len(w), 96) END) AS s FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM documents))",
    "window_mean_pool": "WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT label, dim, avg(CAST(v AS DOUBLE)) AS mean FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY 1) SELECT m.label, dim, round(mean / greatest(norm, 1e-12), 6) AS value FROM m JOIN n USING (label)",
    "relevance_score": f"SELECT doc_id, score, reasons FROM ({SCORED})",
    "top_n_per_group": f"SELECT source, place, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS place FROM ({SCORED})) WHERE place <= 3",
    "hash_sample_per_group": "SELECT lang, place, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('20260928:' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) WHERE place <= 5",
    "quota_selection": f"WITH s AS ({SCORED}), g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM s)), q AS (SELECT source, CAST(47 // n + CASE WHEN i < 47 % n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS place FROM s) SELECT r.source, place, quota, doc_id FROM r JOIN q ON r.source = q.source WHERE place <= quota",
    "first_n_per_group": "SELECT conv_id, place, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place <= 2",
    "stratified_allocation": "WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), q AS (SELECT *, CAST(300 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY lang) - 1 < 300 % count(*) OVER () THEN 1 ELSE 0 END AS BIGINT) AS even FROM s), b AS (SELECT *, least(size, even) AS base, greatest(size - even, 0) AS room FROM q), c AS (SELECT *, 300 - sum(base) OVER () AS spill, coalesce(sum(room) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT lang, size, CAST(base + least(room, greatest(spill - before, 0)) AS BIGINT) AS quota FROM c",
    "corpus_inventory": f"WITH s AS ({SCORED}), p AS (SELECT doc_id, count(*) AS passages FROM ({CHUNKED}) GROUP BY 1), r AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT s.doc_id, score, passages, CASE WHEN score < 6 THEN 'required_source' ELSE 'relevance' END AS reason FROM s JOIN p USING (doc_id) LEFT JOIN r ON s.doc_id = r.doc_id WHERE n_chars > 0 AND (score >= 6 OR r.doc_id IS NOT NULL)",
    "coverage_anti_join": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "corpus_audit_pivot": "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(count_if(n_chars = 0) AS BIGINT) AS empty, CAST(count_if(quality = 1) AS BIGINT) AS good, CAST(count_if(quality = 0) AS BIGINT) AS poor, CAST(count_if(quality IS NULL) AS BIGINT) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "evidence_resolution": f"WITH p AS (SELECT *, {PASSAGE_ID} AS id FROM ({PASSAGES})), r AS (SELECT conv_id, turn FROM conversations WHERE role = 'user') SELECT conv_id, count(*) AS refs, array_to_string(list(id ORDER BY turn, id), ',') AS ids FROM r JOIN p USING (conv_id, turn) WHERE page_chunk_index = 0 GROUP BY conv_id",
    "inventory_semi_join": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "exclude_prior": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "corpus_dedup_supports": "SELECT 'para_' || substr(sha256(coalesce(source, '') || chr(10) || coalesce(text, '')), 1, 20) AS id, min(doc_id) AS doc_id, count(*) FILTER (quality = 1) AS n_supporting, min(doc_id) FILTER (quality = 1) AS first_supporting, max(doc_id) FILTER (quality = 1) AS last_supporting FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "question_validator": """WITH q AS (SELECT CAST(item_id AS VARCHAR) AS id, item_id AS n FROM benchmark),
  e AS (SELECT id, 'empty question' AS rule FROM q WHERE n % 11 = 0 UNION ALL SELECT id, 'hop count' FROM q WHERE n % 7 = 0
  UNION ALL SELECT id, 'no gold answer' FROM q WHERE n % 5 <> 0 AND n % 3 = 0 UNION ALL SELECT id, 'no support' FROM q WHERE n % 5 <> 0 AND n % 4 = 0
  UNION ALL SELECT id, 'unanswerable with support' FROM q WHERE n % 5 = 0 AND NOT (n % 3 = 0 AND n % 4 = 0) UNION ALL SELECT id, 'review status' FROM q WHERE n % 6 = 0
  UNION ALL SELECT id, 'unknown support' FROM q WHERE n % 5 <> 0 AND n % 4 <> 0 AND n * 40 NOT IN (SELECT doc_id FROM documents))
SELECT id, rule FROM e""",
}
