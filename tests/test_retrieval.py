"""Rankings against plain restatements: lexical, fusion, expansion by a queue on random graphs."""

from __future__ import annotations

import math
import random
from collections import Counter, deque

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import graph, ranking, substrings
from lodestrand.plans import catalogue, retrieval

DOCS = [(1, "the quick brown fox"), (2, "machine learning for text"), (3, ""), (10, "machine fox fox"), (5, "quick learning")]


def bm25(docs, query, k1=1.5, b=0.75):
    toks = {i: t.split() for i, t in docs}
    mean = sum(map(len, toks.values())) / len(toks) or 1.0
    df = Counter(w for t in toks.values() for w in set(t))
    out = []
    for i, t in toks.items():
        tf = Counter(t)
        s = sum(math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean)) for w in set(query.split()) if tf[w])
        if s > 0:
            out.append((i, s))
    return sorted(out, key=lambda x: (-round(x[1], 9), str(x[0])))


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    for query in ("fox machine", "quick", "absent"):
        q = spark.createDataFrame([(0, query)], "qid long, question string")
        got = ranking.bm25(docs, "id", F.col("text"), q, "qid", F.col("question"), 3).orderBy("rank").collect()
        want = bm25(DOCS, query)[:3]
        assert [(r.doc, pytest.approx(r.score)) for r in got] == want


@pytest.mark.parametrize(("kwargs", "message"), [({"k1": 0}, "k1"), ({"b": 2}, "b must"), ({"k": 0}, "top_k")])
def test_bm25_guards(spark, kwargs, message):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    with pytest.raises(ValueError, match=message):
        ranking.bm25(docs, "id", F.col("text"), docs, "id", F.col("text"), **{"k": 1, **kwargs})


def test_fusion(spark):
    a = spark.createDataFrame([(0, 7, 1), (0, 2, 2)], "qid int, doc long, rank long")
    b = spark.createDataFrame([(0, 2, 1), (0, 7, 2), (0, 100, 3)], "qid int, doc long, rank long")
    got = [(r.doc, round(r.score, 9)) for r in ranking.fuse([a, b]).orderBy("rank").collect()]
    assert got == [(2, round(1 / 61 + 1 / 62, 9)), (7, round(1 / 61 + 1 / 62, 9)), (100, round(1 / 63, 9))]
    assert [tuple(r) for r in ranking.fuse([b, a]).orderBy("rank").select("doc").collect()] == [(2,), (7,), (100,)]


def queue(seeds, edges, hops, cap):
    """Admission by a queue: neighbours by (predicate, neighbour, edge)."""
    adj: dict = {}
    for e, s, p, o, c in edges:
        adj.setdefault(s, []).append((p, o, e, c))
        adj.setdefault(o, []).append((p, s, e, c))
    seen, todo = {}, deque()
    for v, s in seeds[:cap]:
        seen[v] = (0, s, len(seen) + 1)
        todo.append(v)
    while todo:
        v = todo.popleft()
        d, s, _ = seen[v]
        for p, u, e, c in sorted(adj.get(v, [])):
            if d + 1 <= hops and u not in seen and len(seen) < cap and s * c * 0.5 > 0:
                seen[u] = (d + 1, s * c * 0.5, len(seen) + 1)
                todo.append(u)
    return seen


def test_expansion(spark):
    rng = random.Random(4)
    seeds, edges, want = [], [], {}
    cases = [(hops, cap) for hops in (0, 1, 2, 3) for cap in (1, 4, 9)]
    for hops, cap in cases:
        for case in range(4):
            q = f"{case}"
            own = [(f"{q}-e{i}", f"{q}n{rng.randrange(12)}", rng.choice("PQ"), f"{q}n{rng.randrange(12)}", rng.choice([0.0, 0.5, 0.9, 1.0])) for i in range(25)]
            start = [(f"{q}n{i}", 1.0 / (i + 1)) for i in range(2)]
            want[(hops, cap, q)] = queue(start, own, hops, cap)
            seeds += [(hops, cap, q, v, s, i + 1) for i, (v, s) in enumerate(start)]
            edges += [(hops, cap, *e) for e in own]
    for hops, cap in cases:
        s = spark.createDataFrame([x[2:] for x in seeds if x[:2] == (hops, cap)], "qid string, doc string, score double, rank long")
        e = spark.createDataFrame([x[2:] for x in edges if x[:2] == (hops, cap)], "edge_id string, subject_id string, predicate string, object_id string, confidence double")
        got = {}
        for r in graph.expand(s, graph.adjacency(e), hops, cap).collect():
            got.setdefault(r.qid, {})[r.v] = (r.depth, pytest.approx(r.score), r.pos)
        for q in got:
            assert got[q] == want[(hops, cap, q)], (hops, cap, q)


def test_chunks(spark):
    """A chunk counts from the seed's own list and from evidence of edges whose other end was not reached."""
    visited = spark.createDataFrame([("q", "e1", 0, 1.0, 1)], "qid string, v string, depth int, score double, pos long")
    own = spark.createDataFrame([("e1", "c1")], "v string, chunk string")
    evidence = spark.createDataFrame([("e1", "c1", 0.95), ("e1", "c2", 0.0)], "v string, chunk string, conf double")
    got = [(r.doc, r.score) for r in graph.chunk_scores(visited, own, evidence).orderBy("rank").collect()]
    assert got == [("c1", 1.0), ("c2", 0.0)]
    with pytest.raises(ValueError, match="hops"):
        graph.expand(visited, own, -1)


def test_gold_of_short_items(spark, tmp_path):
    """Items under three terms, without a term and empty ones are contained like any other; case folding, which hangs on what
    stands around a text, has no part in it."""
    docs = ["The quick brown fox.\nIt jumps over", "", None, "über die Straße geht 😀fox😀 weiter", "...--- ?!", "machine learning for the foxes", "  ", "MACHINE learning"]
    items = ["", "fox", "quick brown", None, "?", " ", "The quick brown fox", "😀", "😀fox", "chine learni", ".\nIt", "--- ?!", "absent", "straße", "Straße geht", "Straße geht", "learning for the f", "foxes and more", "?fox", "machine l"]
    held = ["x ΑΣ.ʰa b", "aʰ'Σ b c"]
    asked = ["x ΑΣ.ʰ", "ʰ'Σ b c"]
    for name, d, i in (("plain", docs, items), ("all", docs + held, items + asked)):
        sf = tmp_path / name
        spark.createDataFrame([(k, x, "web") for k, x in enumerate(d)], "doc_id long, text string, source string").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(list(enumerate(i)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
        assert sorted(tuple(r) for r in retrieval.gold_pairs(spark, str(sf)).collect()) == sorted(con.sql(retrieval.GOLD).fetchall())
        if name == "plain":
            best = catalogue.queries()["best_threshold"](spark, str(sf))
            want = con.sql(catalogue.oracle_sql()["best_threshold"])
            assert [tuple(r) for r in best.select(*want.columns).collect()] == want.fetchall()


def test_holding(spark):
    rng = random.Random(7)
    texts = [(i, None if i % 19 == 3 else "".join(rng.choice("abñ \0") for _ in range(rng.randrange(30)))) for i in range(200)]
    wanted = list({"".join(rng.choice("abñ \0") for _ in range(rng.randrange(6))).encode()[:8] for _ in range(90)} | {b"", b"a\0", b"a"})
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    want = sorted((i, s) for i, t in texts if t is not None for s in wanted if s in t.encode())
    for places in (1, 7, 1 << 20):
        assert sorted((r.id, bytes(r.start)) for r in substrings.holding(df, "id", "text", wanted, places).collect()) == want
    assert substrings.holding(df, "id", "text", []).collect() == []
    with pytest.raises(ValueError, match="eight"):
        substrings.holding(df, "id", "text", [b"123456789"])
