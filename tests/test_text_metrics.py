"""Text, ids, answer metrics and citations: hand-computed values."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import metrics
from lodestrand.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("GPT-3", "gpt 3"), ("café", "café"), ("test@example.com", "test example com"), ("Straße", "strasse"), ("  ", ""), ("x² ½", "x² ½")])
def test_normalize_name(spark, raw, want):
    assert one(spark, tx.normalize_name("a"), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("The GPT-3, model!", "gpt3 model"), ("a an the", ""), ("", "")])
def test_normalize_answer(spark, raw, want):
    assert one(spark, tx.normalize_answer("a"), a=raw) == want


def test_entity_id(spark):
    got = one(spark, tx.entity_id(F.lit("Method"), F.col("a")), a="BERT")
    assert got == "method_" + hashlib.sha256(b"Method:bert").hexdigest()[:20] and len(got) == 27
    with pytest.raises(Exception, match="must hold a term"):
        one(spark, tx.entity_id(F.lit("Method"), F.col("a")), a="  ")


@pytest.mark.parametrize(("prediction", "golds", "f1", "em"), [
    ("Paris France", ["Paris"], 2 / 3, 0.0), ("the the cat", ["the cat"], 1.0, 1.0), ("", [""], 1.0, 1.0), ("", ["text"], 0.0, 0.0), ("text", [], 0.0, 0.0),
    ("b b c", ["b c c"], 2 / 3, 0.0), ("London", ["Paris", "london!"], 1.0, 1.0),
])
def test_answers(spark, prediction, golds, f1, em):
    assert one(spark, metrics.token_f1(F.col("p"), F.col("g")), p=prediction, g=golds) == pytest.approx(f1)
    assert one(spark, metrics.exact_match(F.col("p"), F.col("g")), p=prediction, g=golds) == em


@pytest.mark.parametrize(("cited", "abstained", "valid", "fraction"), [(["a"], False, True, 1.0), (["a", "z"], False, False, 0.5), ([], False, False, 0.0), ([], True, True, 1.0), (["a"], True, False, 1.0)])
def test_citations(spark, cited, abstained, valid, fraction):
    cols = metrics.citation_columns(F.col("c"), F.col("r"), F.col("b"))
    assert one(spark, cols["citation_valid"], c=cited, r=["a", "b"], b=abstained) is valid
    assert one(spark, cols["valid_citation_fraction"], c=cited, r=["a", "b"], b=abstained) == fraction


def test_wilson(spark):
    lo, hi = metrics.wilson(F.lit(33), F.lit(50))
    assert one(spark, lo, a=1) == pytest.approx(0.522, abs=5e-4) and one(spark, hi, a=1) == pytest.approx(0.776, abs=5e-4)
    lo, hi = metrics.wilson(F.lit(0), F.lit(0))
    assert one(spark, lo, a=1) == 0.0 == one(spark, hi, a=1)


def test_low_rank(spark):
    x = F.array(*map(F.lit, (3.0, 1.0, 2.0)))
    assert one(spark, metrics.low_rank(x, 0.95), a=1) == 2.0 and one(spark, metrics.low_rank(F.array(F.lit(7.0)), 0.95), a=1) == 7.0


def test_bootstrap_mt(spark):
    import random

    values = [0.0, 1.0, 1.0, 0.5, None]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    row = metrics.bootstrap_mt(df, "g", "v", "i", 7, 500).first()
    rng, x = random.Random(7), values[:4]
    means = sorted(sum(rng.choices(x, k=4)) / 4 for _ in range(500))
    assert (row.n, row.lo, row.hi) == (4, means[int(0.025 * 499)], means[int(0.975 * 499)]) and row.lo <= row["mean"] <= row.hi


def test_year_and_urls(spark):
    assert one(spark, tx.year_of(F.col("a")), a="2305.01234") == 2023
    with pytest.raises(Exception, match="no yymm id"):
        one(spark, tx.year_of(F.col("a")), a="cs/0101")
    assert one(spark, tx.loopback(F.col("a")), a="http://localhost:11434") is True
    assert one(spark, tx.loopback(F.col("a")), a="http://user@localhost/") is False and one(spark, tx.loopback(F.col("a")), a="https://example.com") is False


def test_bootstrap_ci_mt_resamples_ten_thousand_times(spark):
    import random

    from lodestrand.plans import scoring

    sf = "/root/testdata/sf0.001"
    rows = scoring._answers(spark, sf).select("id", "conv_id", metrics.token_f1(F.col("prediction"), F.col("golds")).alias("f1")).orderBy("id").collect()
    for row in scoring.bootstrap_ci_mt(spark, sf).collect():
        x = [r.f1 for r in rows if r.conv_id % 4 == row.run]
        rng = random.Random(20260928)
        means = sorted(sum(rng.choices(x, k=len(x))) / len(x) for _ in range(10_000))
        assert (row.n, row.lo, row.hi) == (len(x), means[249], means[9749])
