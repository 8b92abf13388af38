"""File sources and sinks: JSON lines, CSV worksheets, front-matter Markdown, checksums, reports, graph tables."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import excerpt, hash_id
from ..operators.relational import duplicates, numbered, require_none


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by a declared schema; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, *order: str, single: bool = False) -> None:
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files; contents stay on the executors."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _meta(front: Column, key: str) -> Column:
    value = F.regexp_extract(front, rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*(.*?)[ \t\r]*$", 1)
    return F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")


def parse_markdown(files: DataFrame) -> DataFrame:
    """Documents from (path, value): front matter between --- lines, the title else from the file's name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    has = text.startswith("---\n")
    front = F.when(has, F.regexp_extract(text, r"(?s)^---\n(.*?)---", 1)).otherwise("")
    body = F.when(has, F.regexp_replace(text, r"(?s)^---\n.*?---", "")).otherwise(text)
    title, authors, year, source = (_meta(F.col("_front"), k) for k in ("title", "authors", "year", "source_id"))
    base = files.select(name.alias("_name"), stem.alias("_stem"), front.alias("_front"), body.alias("_body"))
    return base.select(
        hash_id("doc_", F.col("_name"), 16).alias("id"),
        F.when(title == "", F.initcap(F.replace("_stem", F.lit("-"), F.lit(" ")))).otherwise(title).alias("title"),
        F.filter(F.transform(F.split(authors, ","), lambda a: F.trim(a)), lambda a: a != "").alias("authors"),
        F.when(year.rlike(r"^\d+$"), year.cast("int")).alias("year"),
        F.when(source == "", F.col("_stem")).otherwise(source).alias("source_id"),
        F.regexp_replace("_body", r"^\s+|\s+$", "").alias("text"),
    )


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all .md files below a path, by path; none at all fails."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")
    if files.isEmpty():
        raise ValueError(f"no Markdown file in {path}")
    return parse_markdown(files.orderBy("path"))


def worksheet(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adjudication rows of candidate pairs (a, b, similarity) in order of similarity, with both entities' provenance;
    unknown entities have empty fields. Entities are joined by sorting, as a planner that goes by the size of compressed
    files would send millions of them through the driver, once for each side."""
    out = numbered(pairs, "_n", F.round("similarity", 9).desc(), "a", "b")
    out = out.withColumn("pair_id", F.format_string("pair_%04d", "_n")).drop("_n")
    for side, key in (("entity1", "a"), ("entity2", "b")):
        joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ")
        cols = entities.select(F.col("id").alias(key), F.col("name").alias(f"{side}_name"), joined("aliases").alias(f"{side}_aliases"))
        out = out.join(cols.hint("merge"), key, "left")
    fill = {c: F.coalesce(c, F.lit("")) for c in out.columns if c.endswith(("_name", "_aliases"))}
    return out.withColumns(fill).withColumn("similarity", F.format_string("%.4f", "similarity"))


def audit_sheet(rows: DataFrame, text: str = "passage_text") -> DataFrame:
    """Audit rows with passages cut to 800 characters and an ellipsis."""
    return rows.withColumn(text, excerpt(F.col(text), 800, "..."))


def write_graph(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, path: str, dry_run: bool = False) -> None:
    """Vertex, edge and evidence tables, replaced as a whole: running it again changes nothing. Repeated ids and edges with
    an unknown end fail before anything is written; a dry run stops there."""
    for name, df, key in (("node", nodes, "id"), ("edge", edges, "edge_id"), ("evidence", evidence, "evidence_id")):
        if key in df.columns:
            require_none(duplicates(df, key), f"repeated {name} id")
    for end in ("subject_id", "object_id"):
        require_none(edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti").select(end).distinct(), f"unknown {end}")
    if dry_run:
        return
    for name, df in (("nodes", nodes), ("edges", edges), ("edge_evidence", evidence)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_summary(row: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(row, indent=2, ensure_ascii=False))


def report(header: Iterable[str], rows: Iterable[Iterable]) -> str:
    """A Markdown table of a small aggregate: a dash for null, floats with three places, pairs as intervals."""
    one = lambda x: "—" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    show = lambda x: f"{one(x[0])}–{one(x[1])}" if isinstance(x, tuple) else one(x)
    head = list(header)
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def read_config(path: str) -> dict:
    return tomllib.loads(Path(path).read_text())
