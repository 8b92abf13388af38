"""A bounded planning loop over a batch of questions: one relational step per turn, policies and generators pluggable.

Planner and answerer are opaque functions behind protocols; the defaults are deterministic rules that need no model, and
claim nothing about a model's quality. State is one DataFrame keyed by question.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, fallback_query
from .ranking import check


@dataclass(frozen=True)
class Step:
    """What a planner decides for every question of the batch: a tool and the query column it is asked with."""

    tool: str
    query: Column


Planner = Callable[[int], Step | None]
Tool = Callable[[DataFrame], DataFrame]  # questions (qid, question) -> (qid, doc, score, rank)


def rule_planner(turn: int) -> Step | None:
    """Keyword, vector, graph, then finish."""
    tools = ("keyword", "vector", "graph")
    return Step(tools[turn - 1], F.col("question")) if turn <= len(tools) else None


def accumulated(results: DataFrame) -> DataFrame:
    """(qid, doc, rrf, score, last_step, last_rank) from results (qid, doc, score, rank, step): ranks fused over steps, the
    rest from the latest."""
    latest = F.max(F.struct("step", "score", "rank")).alias("l")
    return results.groupBy("qid", "doc").agg(F.sum(1.0 / (60 + F.col("rank"))).alias("rrf"), latest).select("qid", "doc", "rrf", F.col("l.score").alias("score"), F.col("l.step").alias("last_step"), F.col("l.rank").alias("last_rank"))


def planner_context(evidence: DataFrame, top_k: int) -> DataFrame:
    """The min(top_k, 3) latest and best ranked."""
    order = Window.partitionBy("qid").orderBy(F.desc("last_step"), "last_rank", F.col("doc").cast("string"))
    return evidence.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= min(top_k, 3))


def answer_context(evidence: DataFrame, top_k: int) -> DataFrame:
    """The min(2 top_k, 5) latest, best fused, best ranked."""
    order = Window.partitionBy("qid").orderBy(F.desc("last_step"), F.round("rrf", 12).desc(), "last_rank", F.col("doc").cast("string"))
    return evidence.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= min(2 * top_k, 5))


def retrying(generate: Callable[[str, int], str], prompt: str, budget: int, factors: tuple[int, ...] = (1, 2, 4), closed: bool = True) -> dict:
    """A JSON object from a generator that is given ``budget`` times 1, 2, 4, … output tokens until its text is one. When all
    attempts fail the answer is withheld with the error (closed), or the error is raised."""
    error = ""
    for n, factor in enumerate(factors, 1):
        try:
            found = json.loads(generate(prompt, budget * factor))
            if isinstance(found, dict):
                return {**found, "attempts": n, "generation_error": None}
            error = "no JSON object"
        except ValueError as e:
            error = f"malformed JSON: {e.__class__.__name__}"
    if not closed:
        raise ValueError(error)
    return {"answer": "", "citation_ids": [], "abstained": True, "attempts": len(factors), "generation_error": error}


def generated(questions: DataFrame, generate: Callable[[str, int], str], budget: int, factors: tuple[int, ...] = (1, 2, 4), closed: bool = True) -> DataFrame:
    """(qid, answer, citation_ids, abstained, attempts, generation_error) for questions (qid, question) by a generator behind a
    plain function; batches go through Arrow, one call at a time per task."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            rows = [retrying(generate, q, budget, factors, closed) for q in frame["question"]]
            yield pd.DataFrame({"qid": frame["qid"], **{c: [r.get(c) for r in rows] for c in ("answer", "citation_ids", "abstained", "attempts", "generation_error")}})

    kind = dict(questions.dtypes)["qid"]
    return questions.select("qid", "question").mapInPandas(run, f"qid {kind}, answer string, citation_ids array<string>, abstained boolean, attempts long, generation_error string")


def titled(answers: DataFrame, titles: DataFrame) -> DataFrame:
    """(qid, pos, citation, title) of answers (qid, citation_ids) with the titles (qid, doc, title) of what was retrieved; empty
    where a citation was not."""
    cited = answers.select("qid", F.posexplode("citation_ids").alias("pos", "citation"))
    return cited.join(titles.select("qid", F.col("doc").alias("citation"), "title"), ["qid", "citation"], "left").select("qid", "pos", "citation", F.coalesce("title", F.lit("")).alias("title"))


def first_passage(context: DataFrame, docs: DataFrame) -> DataFrame:
    """Default answerer: the start of the best passage, citing it."""
    best = context.where("place = 1").join(docs, "doc")
    return best.select("qid", excerpt(F.col("text"), 120).alias("answer"), F.array(F.col("doc").cast("string")).alias("citation_ids"), F.lit(False).alias("abstained"))


def run(questions: DataFrame, docs: DataFrame, tools: dict[str, Tool], planner: Planner = rule_planner, answerer: Callable[[DataFrame, DataFrame], DataFrame] = first_passage, max_steps: int = 5, top_k: int = 5) -> DataFrame:
    """(qid, answer, citation_ids, abstained, stop_reason, steps) for questions (qid, question) over docs (doc, text).

    Stops when the planner finishes, repeats a (tool, query), or steps run out. Without evidence, or with citations
    that were not retrieved, the answer is withheld.
    """
    check(1 <= max_steps <= 10, "max_steps must lie in [1, 10]")
    check(top_k >= 1, "top_k must be at least 1")
    results, seen, stop, turn = None, set(), "step_budget", 0
    while turn < max_steps:
        step = planner(turn + 1)
        if step is None:
            stop = "planner_finished"
            break
        if (step.tool, str(step.query)) in seen:
            stop = "repeated_tool_query"
            break
        seen.add((step.tool, str(step.query)))
        turn += 1
        asked = questions.select("qid", fallback_query(step.query, F.col("question")).alias("question"))
        found = tools[step.tool](asked).where(F.col("rank") <= top_k).select("qid", F.col("doc").cast("string").alias("doc"), F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"), F.lit(turn).alias("step"))
        results = found if results is None else results.unionByName(found)
    if results is None:
        raise ValueError("the planner used no tool")
    context = answer_context(accumulated(results), top_k)
    answers = answerer(context, docs.select(F.col("doc").cast("string").alias("doc"), "text"))
    cited = context.groupBy("qid").agg(F.collect_set("doc").alias("known"))
    out = questions.select("qid").join(answers, "qid", "left").join(cited, "qid", "left")
    none, blank = F.col("known").isNull(), F.coalesce(F.col("abstained"), F.lit(True)) | (F.trim(F.coalesce("answer", F.lit(""))) == "")
    missing, wrong = F.size(F.coalesce("citation_ids", F.array().cast("array<string>"))) == 0, F.size(F.array_except("citation_ids", "known")) > 0
    reason = F.when(none, "insufficient_evidence").when(~blank & missing, "missing_citation_abstained").when(~blank & wrong, "invalid_citation_abstained").otherwise(stop)
    withheld = none | blank | missing | wrong
    return out.select("qid", F.when(withheld, "").otherwise(F.col("answer")).alias("answer"), F.when(withheld, F.array().cast("array<string>")).otherwise(F.col("citation_ids")).alias("citation_ids"), F.coalesce(withheld, F.lit(True)).alias("abstained"), reason.alias("stop_reason"), F.lit(turn).cast("long").alias("steps"))
