"""Question records, ordered helpers, strict joins, retries and result pages."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrand import storage
from lodestrand.functions import metrics
from lodestrand.functions import text as tx
from lodestrand.operators import agent, evaluation, knowledge, ranking, records, relational, vectors
from lodestrand.sources import files, html
from lodestrand.streaming import requests

PAGE = """<ol><li class="arxiv-result"><p class="list-title"><a href="https://arxiv.org/abs/2401.01234v3">arXiv:2401.01234</a>
<span class="tag is-small">cs.CL</span> <span class="tag">cs.AI</span></p><p class="title">A &amp; B</p><p class="authors"><span>Authors:</span> <a>Ann One</a>, <a>Bo Two</a></p>
<p class="abstract"><span class="abstract-short">Abstract: short</span><span class="abstract-full">Abstract: the full text</span></p></li>
<li class="arxiv-result"><p class="title">no id</p></li><li class="arxiv-result"><a href="/abs/2402.00001">x</a><span class="abstract-short">abstract: only short</span></li></ol>"""


def test_results(spark):
    got = html.results(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"), "q").collect()
    assert [(r.page_id, r.pos, r.id, r.title, r.authors, r.summary, r.categories) for r in got] == [(1, 0, "2401.01234", "A & B", ["Ann One", "Bo Two"], "the full text", "cs.CL, cs.AI"), (1, 1, "2402.00001", "", [], "only short", "")]


def test_running_numbered_and_low_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), float(rng.randrange(40)), rng.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, x double, n long").repartition(5)
    per = df.groupBy("g", "x").agg(F.sum("n").alias("n"))
    want = {(r.g, r.x): sum(n for g, x, n in rows if g == r.g and x < r.x) for r in per.collect()}
    assert {(r.g, r.x): r.n_below for r in relational.running(per, "x", ["n"], ["g"]).collect()} == want
    whole = df.groupBy("x").agg(F.sum("n").alias("n"))
    assert {r.x: r.n_below for r in relational.running(whole, "x", ["n"]).collect()} == {x: sum(n for _, y, n in rows if y < x) for _, x, _ in rows}
    got = [tuple(r) for r in relational.numbered(df.withColumn("id", F.monotonically_increasing_id()), "pos", F.desc("x"), F.col("g"), F.col("id")).orderBy("pos").select("pos", "x", "g").collect()]
    assert [p for p, _, _ in got] == list(range(1, 301)) and [(x, g) for _, x, g in got] == sorted(((x, g) for g, x, _ in rows), key=lambda t: (-t[0], t[1]))
    for r in relational.low_ranks(df, "g", "x", {"p50": 0.5, "p95": 0.95}).collect():
        own = sorted(x for g, x, _ in rows if g == r.g)
        assert (r.p50, r.p95) == (own[int(0.5 * (len(own) - 1))], own[int(0.95 * (len(own) - 1))])


def test_strict_joins_and_counts(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    right = spark.createDataFrame([(1, "c")], "k long, y string")
    with pytest.raises(Exception, match="no partner: 2"):
        relational.must_join(left, right, ["k"], "no partner").collect()
    assert relational.must_join(left.where("k = 1"), right, ["k"], "no partner").collect()[0].y == "c"
    assert relational.require_count(left, 1, 2, "rows") == 2
    with pytest.raises(ValueError, match="2 rows, not 3 to 5"):
        relational.require_count(left, 3, 5, "rows")
    assert [r.k for r in relational.page(left, 1, 0, "k").collect()] == [2]
    with pytest.raises(ValueError, match="offset"):
        relational.page(left, -1, 0, "k")


def test_records(spark):
    rows = [(1, [([2, 0],), ([2],)], [(0, False), (2, True)]), (2, None, [(5, True), (7, False), (6, True)])]
    ddl = "qid long, decomposition array<struct<support:array<bigint>>>, paragraphs array<struct<idx:bigint,is_supporting:boolean>>"
    got = {r.qid: (r.supports, r.hop_count) for r in records.normalized(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: ([2, 0], 2), 2: ([5, 6], 2)}
    for bad in ((3, None, [(1, False)]), (4, [([9],)], [(1, True)])):
        with pytest.raises(Exception, match="no such paragraph"):
            records.normalized(spark.createDataFrame([bad], ddl)).collect()
    q = spark.createDataFrame([(1, None), (2, ["p"])], "qid long, supporting_passage_ids array<string>")
    assert records.track(q).first()[0] == "domain" and records.track(q.where("qid = 1")).first()[0] == "public" == records.track(q.limit(0)).first()[0]


def test_accepted(spark):
    good = spark.createDataFrame([("Paper", "p", "USES", "Method", "m", 0.5)], "subject_kind string, subject_id string, predicate string, object_kind string, object_id string, confidence double")
    assert knowledge.accepted(good).count() == 1
    with pytest.raises(Exception, match="invalid triple p USES m"):
        knowledge.accepted(good.withColumn("confidence", F.lit(2.0))).collect()


def test_retries():
    whole = json.dumps({"answer": "x" * 50, "citation_ids": ["a"], "abstained": False})
    cut = lambda prompt, budget: whole[:budget]
    assert agent.retrying(cut, "q", len(whole))["attempts"] == 1
    assert agent.retrying(cut, "q", len(whole) // 3)["attempts"] == 3
    failed = agent.retrying(cut, "q", 5)
    assert failed["abstained"] and failed["generation_error"].startswith("malformed") and failed["answer"] == ""
    assert agent.retrying(lambda p, b: "[1]", "q", 5)["generation_error"] == "no JSON object"
    with pytest.raises(ValueError, match="malformed"):
        agent.retrying(cut, "q", 5, (1, 2, 4, 8), closed=False)


def test_settled_and_floors(spark):
    a = spark.createDataFrame([("x", ["c"], False), (" ", ["c"], False), ("y", None, True), (None, ["c"], None)], "answer string, citation_ids array<string>, abstained boolean")
    assert [tuple(r) for r in evaluation.settled(a).collect()] == [("x", ["c"], False), ("", [], True), ("", [], True), ("", [], True)]
    assert evaluation.hop_floor("2=0.5") == (2, 0.5)
    for bad in ("2", "x=1", "0=0.1", "1=2"):
        with pytest.raises(ValueError):
            evaluation.hop_floor(bad)
    q = spark.createDataFrame([(1, None), (2, True), (3, False)], "qid long, is_answerable boolean")
    assert sorted(r.qid for r in evaluation.answerable(q).collect()) == [1, 2]


def test_long_f1_equals_short_f1(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "cat", "Dog!", "sat", "on", "A", ""]) for _ in range(rng.randrange(12)))
    df = spark.createDataFrame([(i, text(), [text() for _ in range(rng.randrange(3))]) for i in range(80)] + [(90, None, [""]), (91, "x", None)], "id long, p string, g array<string>")
    want = {r.id: r.f for r in df.select("id", metrics.token_f1(F.col("p"), F.col("g")).alias("f")).collect()}
    got = {r.id: r.f1 for r in metrics.token_f1_rows(df, "id", "p", "g").collect()}
    assert got == pytest.approx(want)


def test_graph_tables_are_checked(spark, tmp_path):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("e", "a", "b")], "edge_id string, subject_id string, object_id string")
    evidence = spark.createDataFrame([("v", "e")], "evidence_id string, edge_id string")
    files.write_graph(nodes, edges, evidence, str(tmp_path / "g"), dry_run=True)
    assert not storage.exists(spark, str(tmp_path / "g"))
    files.write_graph(nodes, edges, evidence, str(tmp_path / "g"))
    assert storage.exists(spark, str(tmp_path / "g/nodes"))
    with pytest.raises(ValueError, match="repeated node id"):
        files.write_graph(nodes.union(nodes), edges, evidence, str(tmp_path / "h"))
    with pytest.raises(ValueError, match="unknown object_id"):
        files.write_graph(nodes.where("id = 'a'"), edges, evidence, str(tmp_path / "h"))
    assert files.report(["v", "ci"], [["x", (0.1, 0.25)], ["y", None]]).splitlines()[2:] == ["| x | 0.100–0.250 |", "| y | — |"]


def test_nearest_of_hot_kinds_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", "hot" if i % 5 else "rare", [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    rows += [("null", "hot", None), ("short", "hot", [1.0]), ("zero", "hot", [0.0] * 8), ("e999", "hot", rows[1][2])]
    df = spark.createDataFrame(rows, "id string, kind string, v array<double>").repartition(4)
    unit = {i: [x / max(1e-12, sum(y * y for y in v) ** 0.5) for x in v] for i, _, v in rows if v}
    got = {}
    for r in ranking.dense(df, "id", "v", df.where("id in ('e1', 'e7')"), "id", "v", 5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc))
    for q in ("e1", "e7"):
        score = {i: round(sum(a * b for a, b in zip(unit[q], u, strict=True)), 9) for i, u in unit.items() if len(u) == 8}
        assert [d for _, d in sorted(got[q])] == sorted(score, key=lambda i: (-score[i], i))[:5]
    kinds = {i: k for i, k, _ in rows}
    pairs = ranking.neighbour_pairs(df, "id", "kind", "v", 3, 0.1).collect()
    assert all(kinds[r.a] == kinds[r.b] and r.a < r.b for r in pairs) and ("e1", "e999") in {(r.a, r.b) for r in pairs}


def packed_broadcasts(df):
    """Lines of the plan by which packed vectors are broadcast."""
    below, found = None, []
    for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        below = None if below is not None and depth <= below else below
        found += [line] if below is not None and "MapInArrow" in line else []
        below = depth if "BroadcastExchange" in line and below is None else below
    return found


def test_worksheet_of_pairs_from_many_blocks(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(f"m{i:03d}", i % 2, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)], "id string, kind int, v array<double>")
    pairs = ranking.neighbour_pairs(df, "id", "kind", "v", 3, 0.2)
    known = spark.createDataFrame([("m000", "zero", ["x", "y"])], "id string, name string, aliases array<string>")
    sheet = sorted(files.worksheet(pairs, known).collect(), key=lambda r: r.pair_id)
    order = sorted(pairs.collect(), key=lambda r: (-round(r.similarity, 9), r.a, r.b))
    assert [(r.pair_id, r.a, r.b, r.similarity) for r in sheet] == [(f"pair_{n:04d}", r.a, r.b, f"{r.similarity:.4f}") for n, r in enumerate(order, 1)]
    assert {r.entity1_name for r in sheet if r.a == "m000"} == {"zero"} and not packed_broadcasts(pairs)


def test_worksheet_sends_no_entities_through_the_driver(spark, tmp_path):
    rows = [(f"m{i}", f"name {i}" if i % 3 else None, [f"x{i}", "y"] if i % 2 else None) for i in range(50)]
    spark.createDataFrame(rows, "id string, name string, aliases array<string>").write.parquet(str(tmp_path / "known"))
    pairs = spark.createDataFrame([(f"m{i}", f"m{i * 7 + 1}", 0.5 + i / 100) for i in range(20)], "a string, b string, similarity double")
    sheet = files.worksheet(pairs, spark.read.parquet(str(tmp_path / "known")))
    joins = [line for line in sheet._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftOuter" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
    names, aliases = {i: n or "" for i, n, _ in rows}, {i: "; ".join(a or []) for i, _, a in rows}
    got = sorted((r.pair_id, r.a, r.b, r.entity1_name, r.entity1_aliases, r.entity2_name, r.entity2_aliases) for r in sheet.collect())
    ends = [(f"m{i}", f"m{i * 7 + 1}") for i in reversed(range(20))]
    assert got == [(f"pair_{n:04d}", a, b, names[a], aliases[a], names.get(b, ""), aliases.get(b, "")) for n, (a, b) in enumerate(ends, 1)]


def test_neighbours_send_no_vectors_through_the_driver(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 6 else "rare", [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, kind string, v array<double>")
    out = vectors.nearest(df.repartition(5), "id", "v", df, "id", "v", 3, "kind", rows=16, query_rows=8)
    got = {}
    for r in out.collect():
        got.setdefault(r.qid, []).append((r.score, r.doc))
    unit = {i: (k, [x / sum(y * y for y in v) ** 0.5 for x in v]) for i, k, v in rows}
    for q, (kind, u) in unit.items():
        want = sorted(((sum(a * b for a, b in zip(u, w, strict=True)), i) for i, (k, w) in unit.items() if k == kind), reverse=True)[:3]
        assert [i for _, i in sorted(got[q], reverse=True)[:3]] == [i for _, i in want] and len(got[q]) == len(set(got[q]))
    assert not packed_broadcasts(out)


def test_limiter_streams_users(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(4), i, float(rng.randrange(500))) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, seconds double").repartition(6)
    want = {}
    for user in range(4):
        own = sorted((s, i) for u, i, s in rows if u == user)
        want |= dict(zip([i for _, i in own], requests.admit([], [s for s, _ in own], 3, 60.0)[1], strict=True))
    assert {r.event_id: r.admitted for r in requests.limited(df, 3, 60.0).collect()} == want


def test_valid_text(spark):
    assert spark.range(1).select(tx.valid_text(F.lit("a\u00e9"))).first()[0] == "a\u00e9"
