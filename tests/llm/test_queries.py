"""The operators over small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import ann, langid, media, mixing, neardup, pieces, pii, registry, suffix_dedup, token_store, warc

SF = "/root/testdata/sf0.001"
LONG = "long text with words " * 4000
TEXTS = [(1, "hello world, mail a@b.example.com"), (2, None), (3, ""), (None, "no id here"), (5, "same"), (5, "same"), (6, LONG), (7, "x\0y \n\n z"), (8, "12 34"), (9, "hello world, mail a@b.example.com")]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that clash with the operators' own."""
    rows = [(i, t, "en" if n % 2 else None, f"s{n % 2}", len(t or ""), n, 0.5, "kept") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, spans string").repartition(3)


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path


def test_token_store(spark, docs, path, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    words = b"".join(np.arange(500, dtype="<u2").tobytes() for _ in range(9))
    index = token_store.write_shards(docs, str(tmp_path / "t"), path("byte_bpe_50k.json"), dictionary=words, shard_bytes=2000)
    got = token_store.read_shards(index, words).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5, 6, 7, 8, 9]
    texts = defaultdict(list)
    for i, t in TEXTS:
        texts[i].append(t or "")
    start = 0
    for r in got:
        ids = [*plain.encode(texts[r.doc_id][0], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    row = index.where("doc_id = 7").first()
    assert token_store.read_document(row.file, words, 7).tolist() == [*plain.encode("x\0y \n\n z", add_special_tokens=False).ids, 0]
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.open_shard(row.file, b"other")
    empty = token_store.write_shards(docs.limit(0), str(tmp_path / "e"), path("byte_bpe_50k.json"))
    assert token_store.read_shards(empty, b"").count() == 0 and token_store.train_dictionary(docs.limit(0), path("byte_bpe_50k.json")) == b""


def test_media(spark, docs):
    got = media.read_features(media.store_bytes(docs, "doc_id", "text"), "doc_id").collect()
    assert len(got) == len(TEXTS)
    want = Counter()
    for i, t in TEXTS:
        raw = (t or "").encode()
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want[(i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 9)}) == 1
    assert media.store_bytes(docs.limit(0), "doc_id", "text").count() == 0


def test_warc(spark, tmp_path):
    big = "x" * 150
    rows = [(4, "u4", big), (2, "u\n2", big), (2, "u2", big), (9, None, "small"), (8, "u8", "small"), (1, "u1", None), (None, "u", big), (7, "u7", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    assert sorted(map(str, warc.plan_records(pages, hot=1).collect())) == sorted(map(str, warc.plan_records(pages).collect()))  # joined or broadcast
    index = warc.write_archives(warc.plan_records(pages), str(tmp_path / "w"), archive_bytes=600)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter((i, len((t or "").encode()), digest(t), "revisit" if t == big and i != 2 else "response", 2 if t == big and i != 2 else None) for i, _, t in rows)
    assert got == want
    some = warc.read_records(index.where("url = 'u7'")).collect()
    assert [(r.url, r.html) for r in some] == [("u7", "é" * 60)]
    assert warc.read_records(warc.write_archives(warc.plan_records(pages.limit(0)), str(tmp_path / "e"))).count() == 0


def test_pii(spark, docs):
    model = pii.Model(pii.fresh(1))
    got = pii.annotate(docs, model).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        base = pii.base_spans(r.text or "")
        assert r.base_sha256 == hashlib.sha256(pii.render(base).encode()).hexdigest() and r.n_email == sum(k == 0 for _, k, _ in base)
        assert set(filter(None, pii.render(base).split(","))) <= set(r.spans.split(",")) | {""} and r.n_tokens is not None
    clean = {r.doc_id: r.text for r in pii.masked(docs, model).collect()}
    assert clean[1] == "hello world, mail [EMAIL]" and clean[2] is None and clean[6] == LONG
    assert pii.annotate(docs.limit(0), model).count() == 0 and pii.examples([], 3)[0].shape == (3, 96)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 16))
    v[60:90] = v[59]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    odd = [(500, None), (501, [0.0] * 16), (502, [1.0] * 15 + [None]), (503, [1.0] * 15 + [float("nan")]), (504, [1.0] * 15 + [float("inf")]), (505, [1.0] * 3), (506, [1.0] * 20), (507, []), (None, [1.0] * 16), (100, rows[100][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).repartition(4)
    found = ann.nearest(df, df.where("vec_id % 50 = 0"), epsilon=3.0, rows=64, query_rows=3).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    for q in range(0, 300, 50):
        s = np.round(unit @ unit[q], 12)
        assert got[q] == [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
    assert set(got) == set(range(0, 300, 50))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1)")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1)]


def test_nearest_sends_no_vectors_through_the_driver(spark):
    v = np.random.default_rng(1).standard_normal((400, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(400)], "vec_id long, embedding array<double>").repartition(4)
    out = ann.nearest(df, df.where("vec_id % 50 = 0"), epsilon=4.0, rows=32, query_rows=3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): r.vec_id for r in out.collect()}
    for q in range(0, 400, 50):
        assert [got[q, n] for n in range(1, 6)] == [i for i in np.argsort(-(unit @ unit[q])) if i != q][:5]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def near_rows():
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    def edit(n):
        cut = set(rng.sample(range(120), n))
        return " ".join(f"e{rng.random()}" if i in cut else w for i, w in enumerate(base))

    rows = [(i, edit(rng.choice((0, 1, 1, 2, 3, 4, 8)))) for i in range(150)] + [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(150, 200)]
    return rows + [(300, rows[170][1]), (301, None), (302, ""), (303, " \n"), (304, "one two"), (305, "one two"), (None, rows[171][1]), (304, "one two"), (310, LONG)]


@pytest.mark.parametrize("block", [(512, 1024), (7, 11)])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "label": F.lit(2)}).repartition(3)
    sets = [frozenset() if not (t or "").split() else frozenset(tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (k := len(sets[i] & sets[j])) and k / len(sets[i] | sets[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    want = Counter((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g)
    got = neardup.classes(df).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    if block[0] == 512:
        assert neardup.classes(df.limit(0)).count() == 0


def test_near_duplicates_with_repeated_lines(spark):
    """A line that one copy repeats counts once: 96 of 118 shingles are shared (0.81)."""
    rows = []
    for i in range(60):
        text = " ".join(f"w{i}x{j}" for j in range(100))
        rows += [(2 * i, text), (2 * i + 1, text + f" {' '.join(f'r{i}x{j}' for j in range(18))}" * (1, 20, 100)[i % 3])]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == {d: d // 2 * 2 for d, _ in rows}


def test_near_duplicates_of_blank_texts(spark):
    """Every document has a row, whatever white space it is made of."""
    rows = [(i, c) for i, c in enumerate(["\x1c", "\x1d\x1e", "\x1f ", "\x85", "\xa0", "\u2028\u3000", "\u200b", "a b c d e f", None, "\x1c", "\u180e"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in neardup.classes(df).collect()) == [(i, i) for i, _ in rows]
    assert sorted(r.doc_id for r in neardup.deduplicated(df).collect()) == [i for i, _ in rows]


def test_repeats(spark):
    import random

    rng = random.Random(3)
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "sit", "é"]) + str(rng.randrange(100))
    shared = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(50))) + shared[rng.randrange(40) : rng.randrange(240, 330)] + " ".join(word() for _ in range(rng.randrange(50)))) for i in range(120)]
    rows += [(200, "a" * 900), (201, "a" * 150), (202, None), (203, ""), (None, "q" * 199), (205, "ab" * 300), (206, "unique " + "z" * 250)]
    seen = Counter(b[i : i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = {}
    for d, t in rows:
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[d] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash")).repartition(3)
    for most in (4096, 6):
        got = suffix_dedup.remove_repeats(df, chunk_bytes=8000, batch_bytes=5000, most=most)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.remove_repeats(df, 64)


def test_mixing(spark, docs):
    full = mixing.described(docs, topic=F.when(F.col("doc_id") > 5, "a").otherwise("b"))
    got = mixing.weigh(full).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.probability <= 1 for r in got)
    assert {r._lang for r in got} == {"en", "unknown"}
    new = ("weight", "probability", "kept", "copies")
    clash = mixing.weigh(full.withColumns({c: F.lit("clash") for c in new})).select(*got[0].asDict())
    assert sorted(map(str, clash.collect())) == sorted(map(str, got))
    cells = spark.createDataFrame([("x", "1", 10), ("x", "2", 30), ("y", "1", 40), ("y", "2", 20)], "_source string, _lang string, tokens long")
    goals = {"_source": mixing.targets(cells, "_source", given={"x": 0.3, "y": 0.7}), "_lang": mixing.targets(cells, "_lang", temper=0.0)}
    raked = mixing.rake(cells, goals).collect()
    mass = lambda i, k: sum(r.w for r in raked if r[i] == k)
    assert mass("_source", "x") == pytest.approx(30, rel=2e-4) and mass("_lang", "1") == pytest.approx(50, rel=2e-4)
    odds = {(r._source, r._lang): r.w / r.tokens for r in raked}
    assert odds["x", "1"] * odds["y", "2"] == pytest.approx(odds["x", "2"] * odds["y", "1"])  # raking keeps interactions
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns and kept.count() <= len(TEXTS) and mixing.sampled(docs.limit(0)).count() == 0


def test_mixed_sources_meet_their_target(spark, tmp_path):
    """Shares of 0.99 and 0.01 are tempered to 0.909 and 0.091; the small source's rate is 4.6."""
    rows = [(i, "ten plain words that say nothing at all of note", "en", "small" if i % 100 == 0 else "big", 47) for i in range(1000)]
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    n = Counter(r.source for r in out.collect())
    assert n["small"] / n.total() == pytest.approx(1 / (1 + 99**0.5), abs=0.01) and n.total() == pytest.approx(500, abs=50)


def test_pieces(spark, docs, path):
    model = path("piece_bpe_32k.model")
    clash = docs.withColumns({c: F.lit("clash") for c in ("n_pieces", "ids_crc32", "round_trip", "piece_ids")})
    got = pieces.encode_column(docs, model)
    assert sorted(map(str, pieces.encode_column(clash, model).select(*got.columns).collect())) == sorted(map(str, got.collect()))
    back = pieces.decode_column(got.withColumnRenamed("text", "original"), model)
    rows = back.collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip and r.text == (r.original or "") for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    assert pieces.encode_column(docs.limit(0), model).count() == 0


def test_language(spark, docs):
    model = langid.train(["the house and tree"] * 3 + ["das haus und baum"] * 3, ["en"] * 3 + ["de"] * 3, sequences=100, epochs=1)
    got = {r.doc_id: r for r in langid.annotate(docs, model).collect()}
    assert [got[i].lang_pred for i in (2, 3, 8)] == ["und"] * 3 and got[2].score == 0.0
    assert got[6].lang_pred in ("en", "de") and 0 < got[6].score <= 1 and "spans" in got[6].asDict()
    assert {r.lang_pred for r in langid.annotate(docs, None).collect()} == {"und"}
    assert langid.annotate(docs.limit(0), model).count() == 0 and langid.fit(docs.where("lang is null").select("doc_id", "text", "lang")) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    got = langid.op10_language_id(spark, SF)
    j = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in j]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    place = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)


def test_stages(spark, docs, tmp_path):
    """Each stage on the odd rows: columns stay, decisions take effect, clean documents stay."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns, name
        kept = Counter(r.doc_id for r in out.collect())
        if name == "identify_language":
            assert not kept[2] and not kept[3] and not kept[8] and kept[1] == 1 and kept[6] == 1
        if name == "drop_near_duplicates":
            assert kept[1] == 1 and not kept[9] and kept[5] == 1 and kept[6] == 1 and kept[None] == 1
        if name == "mask_personal_data":
            assert sum(kept.values()) == len(TEXTS)
            assert {r.doc_id: r.n_chars for r in out.collect()}[1] == len("hello world, mail [EMAIL]")
    last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
    assert len(last) == len(TEXTS) and all(r.round_trip for r in last)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "mask_personal_data", "mix_sources", "encode_pieces"]
