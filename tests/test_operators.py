"""Chunking, curation, knowledge graph, evaluation, agent, sources and streams on small literal inputs."""

from __future__ import annotations

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import agent, chunking, evaluation, knowledge, relational
from lodestrand.plans import scoring
from lodestrand.sources import files, html, vectors
from lodestrand.streaming import requests


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize(("n", "starts"), [(0, []), (1, [0]), (10, [0]), (11, [0, 7]), (17, [0, 7]), (18, [0, 7, 14])])
def test_chunks(spark, n, starts):
    df = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "id int, text string")
    got = chunking.chunks(df, "text", 10, 3).orderBy("start").collect()
    assert [r.start for r in got] == starts
    assert {w for r in got for w in r.chunk_text.split()} == set(map(str, range(n)))


def test_windows_keep_the_tail(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(20))))], "id int, text string")
    assert [r.start for r in chunking.encoder_windows(df, "text", 8).orderBy("start").collect()] == [0, 6, 12, 18]


def test_quotas(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 1), ("b", 9), ("c", 9)) for i in range(n)], "g string, i int")
    assert rows(relational.quotas(df, "g", 7), "g") == [("a", 3), ("b", 2), ("c", 2)]
    assert rows(relational.stratified_quotas(df, "g", 9), "g") == [("a", 1, 1), ("b", 9, 5), ("c", 9, 3)]
    with pytest.raises(Exception, match="too few rows"):
        relational.top_n(df, "g", 2, F.col("i"), strict=True).collect()


def test_last_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "k string, seq int, v string")
    assert rows(relational.last_wins(df, "k", F.col("seq"), "v"), "k") == [("a", "z"), ("b", "q")]
    assert rows(relational.first_wins(df, "k", F.col("seq"), "v"), "k") == [("a", "x"), ("b", "q")]


def test_ontology(spark):
    df = spark.createDataFrame(
        [("USES", "Method", "Dataset", "s", "o", 0.5), ("USES", "Dataset", "Task", "s", "o", 0.5), ("CITES", "Paper", "Paper", None, "o", 0.5), ("CITES", "Paper", "Paper", "s", "o", 1.5), ("CITES", "Paper", "Paper", "s", "o", None), ("LIKES", "Paper", "Paper", "s", "o", 0.5)],
        "predicate string, subject_kind string, object_kind string, subject_id string, object_id string, confidence double",
    )
    assert sorted((r.predicate, r.confidence, r.accepted) for r in knowledge.judged(df).collect() if r.accepted) == [("USES", 0.5, True)]
    assert knowledge.judged(df).count() == 6


def test_extraction(spark):
    e = spark.createDataFrame([("c", 0, "Paper", "The  Paper", ["p1"]), ("c", 1, "Method", "BERT", ["b"]), ("c", 2, "Method", "bert", ["B2", " "]), ("c", 3, "Method", "RoBERTa", ["b"])], "chunk_id string, pos int, kind string, name string, aliases array<string>")
    ents = knowledge.normalized_entities(e)
    assert [(r.kind, r.name, r.aliases) for r in ents.orderBy("kind", "name").collect()] == [("Method", "BERT", ["B2", "b"]), ("Method", "RoBERTa", ["b"]), ("Paper", "The Paper", ["p1"])]
    t = spark.createDataFrame([("c", "Method", "Bert", "OUTPERFORMS", "Method", "roberta", 0.9), ("c", "Method", "b", "OUTPERFORMS", "Method", "bert", 0.9)], "chunk_id string, subject_kind string, subject string, predicate string, object_kind string, object string, confidence double")
    got = {r.subject: (r.subject_id is not None, r.object_id is not None) for r in knowledge.resolved(t, ents).collect()}
    assert got == {"Bert": (True, True), "b": (False, True)}  # an alias of two entities means neither
    with pytest.raises(Exception, match="invalid entity"):
        knowledge.normalized_entities(e.withColumn("kind", F.lit("Benchmark"))).collect()


def test_merge(spark):
    nodes = spark.createDataFrame([(i, "Method", i, [f"a{i}"], [f"c{i}"], ["p"]) for i in "ABCD"], "id string, kind string, name string, aliases array<string>, source_chunk_ids array<string>, paper_ids array<string>")
    pairs = spark.createDataFrame([(1, "A", "B", " merge", "B"), (2, "B", "C", "MERGE", "C"), (3, "C", "D", "keep_separate", None)], "seq int, entity_id_a string, entity_id_b string, decision string, canonical_entity_id string")
    mapping = knowledge.decisions(pairs)
    assert rows(mapping, "entity_id") == [("A", "B"), ("B", "C"), ("C", "C")]  # the last decision wins, chains are not followed
    got = {r.id: (r.aliases, r.source_chunk_ids) for r in knowledge.merged(nodes, mapping).collect()}
    assert got == {"B": (["aA", "aB"], ["cA", "cB"]), "C": (["aB", "aC"], ["cB", "cC"]), "D": (["aD"], ["cD"])}
    edges = spark.createDataFrame([("e", "A", "B"), ("f", "A", "B")], "edge_id string, subject_id string, object_id string")
    assert sorted((r.edge_id, r.subject_id, r.object_id) for r in knowledge.remapped(edges, mapping).collect()) == [("e", "B", "C"), ("f", "B", "C")]
    with pytest.raises(Exception, match="unknown decision"):
        knowledge.decisions(pairs.withColumn("decision", F.lit("MAYBE"))).collect()


def test_nodes_and_edges(spark):
    m = spark.createDataFrame([("n", "Task", "first", ["x"], "c1", "p1", 1), ("n", "Task", "second", ["y", "x"], "c2", "p1", 2)], "id string, kind string, name string, aliases array<string>, chunk_id string, paper_id string, seq int")
    r = knowledge.nodes(m).first()
    assert (r.name, r.aliases, r.source_chunk_ids, r.paper_ids) == ("first", ["x", "y"], ["c1", "c2"], ["p1"])
    with pytest.raises(Exception, match="two kinds"):
        knowledge.nodes(m.withColumn("kind", F.when(F.col("seq") == 1, "Task").otherwise("Paper"))).collect()
    t = spark.createDataFrame([("s", "USES", "o", "c2", "p", 0.4, 1), ("s", "USES", "o", "c1", "p", 0.3, 2), ("s", "USES", "o", "c2", "p", 0.2, 3)], "subject_id string, predicate string, object_id string, chunk_id string, paper_id string, confidence double, seq int")
    e = knowledge.edges(knowledge.edge_evidence(t, F.col("seq"))).first()
    assert [(x.chunk_id, x.confidence) for x in e.evidence] == [("c1", 0.3), ("c2", 0.2)]


def test_thresholds(spark):
    pos, neg = [5.0, 3.0, 3.0, 1.0], [2.0, 3.0]
    df = spark.createDataFrame([(x, True) for x in pos] + [(x, False) for x in neg], "score double, positive boolean")
    got = {round(r.threshold, 6): (r.answerable_recall, r.unanswerable_rejection_rate) for r in evaluation.threshold_sweep(df).collect()}
    cands = sorted({0.0, *pos, *neg, 3.0 + 1e-9, 6.0})
    assert got == {round(t, 6): (sum(x >= t for x in pos) / 4, sum(x < t for x in neg) / 2) for t in cands} or len(got) == len({round(t, 6) for t in cands})
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / 8
    assert evaluation.rank_auc(df).first().auc == pytest.approx(auc)


ONE_SIDED = ([(4.0, True), (2.0, True), (2.0, True)], [(4.0, False), (1.0, False)], [])


def in_duckdb(rows, query):
    """A query of the catalogue over given scores: its SQL from the table of scores on."""
    con = duckdb.connect()
    con.sql("CREATE TABLE sc (score DOUBLE, positive BOOLEAN)")
    if rows:
        con.executemany("INSERT INTO sc VALUES (?, ?)", rows)
    sql = scoring.SQL[query].removeprefix(scoring.SCORES).lstrip(", ")
    return con.sql(sql if sql.startswith("SELECT") else f"WITH {sql}").fetchall()


def flat(rows):
    return sorted([tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("rows", ONE_SIDED)
def test_sweep_of_one_side(spark, rows):
    df = spark.createDataFrame(rows, "score double, positive boolean")
    assert flat(scoring._rounded(evaluation.threshold_sweep(df)).collect()) == flat(in_duckdb(rows, "abstention_threshold_sweep"))


@pytest.mark.parametrize("rows", ONE_SIDED)
def test_best_threshold_of_one_side(spark, rows):
    df = spark.createDataFrame(rows, "score double, positive boolean")
    assert flat(scoring._rounded(evaluation.best_threshold(evaluation.threshold_sweep(df))).collect()) == flat(in_duckdb(rows, "best_threshold"))


@pytest.mark.parametrize("rows", ONE_SIDED)
def test_auc_of_one_side(spark, rows):
    df = spark.createDataFrame(rows, "score double, positive boolean")
    assert flat(scoring._rounded(evaluation.rank_auc(df)).collect()) == flat(in_duckdb(rows, "rank_auc"))


def test_recall_and_pairs(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1)], "qid long, doc long, rank long")
    gold = spark.createDataFrame([(1, 8), (1, 9), (2, 1)], "qid long, doc long")
    q = spark.createDataFrame([(1, 2), (2, 10), (3, 2)], "qid long, hop_count int")
    r = evaluation.recall(ranked, gold, q, 5)
    assert rows(r, "qid") == [(1, 2, 2, 0.5), (2, 10, 1, 0.0), (3, 2, 0, 0.0)]
    assert rows(evaluation.by_hop(r, "recall"), "hop") == [(None, 3, pytest.approx(0.5 / 3)), (2, 2, 0.25), (10, 1, 0.0)]
    with pytest.raises(Exception, match="runs differ"):
        evaluation.paired(r, r.where("qid < 3"), "recall").collect()


def test_gate_and_guardrails(spark):
    m = spark.createDataFrame([("a", 0.5)], "name string, value double")
    f = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "name string, floor double")
    assert [(r.name, r.passed) for r in evaluation.gate(m, f).orderBy("name").collect()] == [("a", True), ("b", False)]
    a = spark.createDataFrame([("fine", False, True, ["s"]), ("PHISHING-CANARY", False, True, ["s"]), ("my SYSTEM prompt", False, True, ["s", "x"])], "answer string, abstained boolean, citation_valid boolean, citation_ids array<string>").withColumns({"support_id": F.lit("s"), "attack_id": F.lit("x")})
    assert [r.passed for r in evaluation.guardrails(a).orderBy("answer").collect()] == [False, True, False]


def test_question_rules(spark):
    q = spark.createDataFrame([("a", "why", 1, True, ["g"], ["p"], "verified"), ("b", " ", 4, True, [], ["zz"], "draft"), ("c", "x", 2, False, ["g"], [], "pending"), ("c", "x", 2, None, None, None, "pending")], "id string, question string, hop_count int, is_answerable boolean, gold_answers array<string>, supporting_passage_ids array<string>, review_status string")
    p = spark.createDataFrame([("p",)], "id string")
    got = {tuple(r) for r in evaluation.question_errors(q, p).collect()}
    assert got == {("b", "empty question"), ("b", "hop count"), ("b", "no gold answer"), ("b", "review status"), ("b", "unknown support"), ("c", "unanswerable with support"), ("c", "repeated id")}
    assert {r.rule for r in evaluation.set_errors(q).collect()} == {"question count", "unanswerable share", "missing hop", "unverified questions"}


def test_agent(spark):
    questions = spark.createDataFrame([(1, "one two three"), (2, "none at all")], "qid long, question string")
    docs = spark.createDataFrame([(7, "an answer"), (8, "other")], "doc long, text string")
    hits = spark.createDataFrame([(1, 7, 2.0, 1), (1, 8, 1.0, 2)], "qid long, doc long, score double, rank long")
    tools = dict.fromkeys(("keyword", "vector", "graph"), lambda q: hits)
    got = {r.qid: r for r in agent.run(questions, docs, tools).collect()}
    assert (got[1].answer, got[1].citation_ids, got[1].stop_reason, got[1].steps) == ("an answer", ["7"], "planner_finished", 3)
    assert (got[2].abstained, got[2].stop_reason) == (True, "insufficient_evidence")
    again = agent.run(questions, docs, tools, planner=lambda t: agent.Step("keyword", F.col("question")))
    assert {r.stop_reason for r in again.collect()} == {"repeated_tool_query", "insufficient_evidence"}
    wrong = agent.run(questions, docs, tools, answerer=lambda c, d: agent.first_passage(c, d).withColumn("citation_ids", F.array(F.lit("99"))))
    assert {r.qid: r.stop_reason for r in wrong.collect()}[1] == "invalid_citation_abstained"
    with pytest.raises(ValueError, match="max_steps"):
        agent.run(questions, docs, tools, max_steps=11)


def test_labels(spark):
    df = spark.createDataFrame([(" Yes ",), ("0",), (None,)], "x string")
    assert [r[0] for r in df.select(knowledge.label_of(F.col("x"))).collect()] == [True, False, None]
    with pytest.raises(Exception, match="unknown label"):
        df.select(knowledge.label_of(F.lit("maybe"))).collect()


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "text": "世界"}\n\n{"id": "2", "text": "b"}\n')
    assert rows(files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, text string"), "id") == [("1", "世界"), ("2", "b")]
    files.write_jsonl(files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, text string"), str(tmp_path / "out"), "id", single=True)
    assert [json.loads(x)["text"] for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()] == ["世界", "b"]
    (tmp_path / "bad.jsonl").write_text("{")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_markdown(spark, tmp_path):
    (tmp_path / "my-paper.md").write_text('---\ntitle: "A Title"\nauthors: Ann, Bob\nyear: 2020\n---\n\nBody text.\n')
    (tmp_path / "no-front.md").write_text("Only text")
    got = {r.source_id: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    a, b = got["my-paper"], got["no-front"]
    assert (a.title, a.authors, a.year, a.text) == ("A Title", ["Ann", "Bob"], 2020, "Body text.")
    assert (b.title, b.authors, b.year, b.text) == ("No Front", [], None, "Only text")
    with pytest.raises(ValueError, match="no Markdown"):
        files.read_markdown(spark, _empty(tmp_path))


def _empty(path):
    (path / "void").mkdir()
    (path / "void" / "x.txt").write_text("x")
    return str(path / "void")


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    assert files.checksums(spark, str(tmp_path), "*.bin").first().sha256 == hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame([("x", 'say "hi"\nthere')], "a string, b string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert rows(files.read_csv(spark, str(tmp_path / "csv"))) == [("x", 'say "hi"\nthere')]
    assert files.audit_sheet(spark.createDataFrame([("y" * 801,)], "passage_text string")).first()[0] == "y" * 800 + "..."
    assert files.report(["a", "b"], [(1.23456, None)]) == "| a | b |\n|---|---|\n| 1.235 | — |"


def test_html(spark):
    page = '<ul><li class="big result"><p class="title">A &amp; <b>B</b></p><br><p>x</p></li></ul><a href="u?a=1">l</a>'
    assert html.class_text(page, ["result", "title", "none"]) == {"result": "A & B x", "title": "A & B", "none": ""}
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert rows(html.links(df)) == [(1, 0, "u?a=1")] and html.fields(df, ["title"]).count() == 2


def test_vector_cache(spark, tmp_path):
    calls = []
    base = vectors.hashing_encoder(8)
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, text string")
    path = str(tmp_path / "cache")
    first = vectors.cached_vectors(spark, texts, path, base, "hash")
    assert first.count() == 3 and spark.read.parquet(path).count() == 2

    def refuse(batch):
        calls.append(1)
        raise AssertionError("all texts are cached")

    assert vectors.cached_vectors(spark, texts, path, refuse, "hash").count() == 3
    assert vectors.cached_vectors(spark, texts, path, base, "other").count() == 3 and spark.read.parquet(path).count() == 4


def test_limiter(spark):
    stamps = [0.0, 1.0, 2.0, 3.0, 60.0, 60.5, 61.0]
    log, verdicts = requests.admit([], stamps, 2, 60.0)
    assert verdicts == [True, True, False, False, True, False, True] and log == [60.0, 61.0]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(stamps)], "user_id long, event_id long, seconds double")
    assert [r.admitted for r in requests.limited(df, 2, 60.0).orderBy("event_id").collect()] == verdicts


def test_limiter_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((0, 1, 2, 60))], "user_id long, event_id long, seconds double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("user_id long, event_id long, seconds double").parquet(src)
    # with time-outs on, a query that ends when all is read would run empty batches for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = requests.limited_stream(stream, 2, 60.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [r.admitted for r in spark.read.parquet(out).orderBy("event_id").collect()] == [True, True, False, True]


def test_cache_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").write.parquet(src)
    for n in range(2):
        stream = spark.readStream.schema("k int, v string").parquet(src)
        requests.cache_stream(stream, out, str(tmp_path / f"cp{n}"), "k", lambda b: b.select("k")).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]
