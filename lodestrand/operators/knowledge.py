"""Building and auditing a typed property graph from extracted entities and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import edge_id, entity_id, mention_id, normalize_name

# fixed values: the kinds of entities, and which kinds each relation joins
KINDS = ("Paper", "Method", "Dataset", "Metric", "Task")
RELATIONS = (
    ("PROPOSES", ("Paper",), ("Method",)),
    ("EVALUATES_ON", ("Paper", "Method"), ("Dataset", "Task", "Metric")),
    ("USES", ("Paper", "Method"), ("Method", "Dataset", "Metric", "Task")),
    ("OUTPERFORMS", ("Method",), ("Method",)),
    ("CITES", ("Paper",), ("Paper",)),
)


def allowed(spark: SparkSession) -> DataFrame:
    rows = [(p, s, o) for p, subjects, objects in RELATIONS for s in subjects for o in objects]
    return spark.createDataFrame(rows, "predicate string, subject_kind string, object_kind string")


def judged(triples: DataFrame) -> DataFrame:
    """triples (predicate, subject_kind, object_kind, subject_id, object_id, confidence) with accepted: a known relation
    between allowed kinds, both ends resolved, confidence a number in [0, 1]. Rejected ones stay, to be counted."""
    rules = F.broadcast(allowed(triples.sparkSession).withColumn("_ok", F.lit(True)))
    fine = F.col("_ok").isNotNull() & F.col("subject_id").isNotNull() & F.col("object_id").isNotNull() & F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    return triples.join(rules, ["predicate", "subject_kind", "object_kind"], "left").withColumn("accepted", fine).drop("_ok")


def normalized_entities(entities: DataFrame) -> DataFrame:
    """(chunk_id, kind, normalized, id, name, aliases): entities (chunk_id, pos, kind, name, aliases) of a chunk, one
    per kind and normalised name: the first name, all aliases. An unknown kind or a blank name fails."""
    tidy = F.trim(F.regexp_replace("name", r"\s+", " "))
    bad = ~F.col("kind").isin(*KINDS) | (normalize_name(tidy) == "")
    name = F.when(bad, F.raise_error(F.concat(F.lit("invalid entity in chunk "), F.col("chunk_id").cast("string")))).otherwise(tidy)
    rows = entities.withColumn("name", name).withColumn("normalized", normalize_name("name"))
    trimmed = F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: a != "")
    grouped = rows.groupBy("chunk_id", "kind", "normalized").agg(F.min_by("name", "pos").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(trimmed)))).alias("aliases"))
    return grouped.withColumn("id", entity_id(F.col("kind"), F.col("name")))


def endpoints(entities: DataFrame) -> DataFrame:
    """(chunk_id, kind, alias, id): names and aliases that mean a single entity of their kind in a chunk."""
    spelled = entities.select("chunk_id", "kind", "id", F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    spelled = spelled.select("chunk_id", "kind", normalize_name("alias").alias("alias"), "id")
    return spelled.groupBy("chunk_id", "kind", "alias").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").drop("other")


def resolved(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """triples (chunk_id, subject_kind, subject, predicate, object_kind, object, confidence) with the ids of both ends
    (null where a name is unknown or ambiguous) and the mention's id."""
    ends = endpoints(entities)
    out = triples.withColumns({"_s": normalize_name("subject"), "_o": normalize_name("object")})
    out = out.join(ends.select("chunk_id", F.col("kind").alias("subject_kind"), F.col("alias").alias("_s"), F.col("id").alias("subject_id")), ["chunk_id", "subject_kind", "_s"], "left")
    out = out.join(ends.select("chunk_id", F.col("kind").alias("object_kind"), F.col("alias").alias("_o"), F.col("id").alias("object_id")), ["chunk_id", "object_kind", "_o"], "left")
    return out.drop("_s", "_o").withColumn("mention_id", mention_id(F.col("chunk_id").cast("string"), F.col("subject_id"), F.col("predicate"), F.col("object_id")))


def accepted(triples: DataFrame) -> DataFrame:
    """The triples, all of which must obey the rules of ``judged``: the first that doesn't fails."""
    bad = F.raise_error(F.concat(F.lit("invalid triple "), F.concat_ws(" ", F.col("subject_id"), F.col("predicate"), F.col("object_id")))).cast("boolean")
    return judged(triples).where(F.when(F.col("accepted"), F.lit(True)).otherwise(bad)).drop("accepted")


def extraction_records(papers: DataFrame, entities: DataFrame, triples: DataFrame, default_confidence: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of extracted chunks. The source paper (papers: chunk_id, paper_id, title) comes first among a
    chunk's entities, with its id as alias; names are normalised and ends resolved within the chunk; triples with an
    unresolved end go. A missing confidence is 0, or stays null, which ``judged`` rejects."""
    source = papers.select("chunk_id", F.lit(-1).alias("pos"), F.lit("Paper").alias("kind"), F.col("title").alias("name"), F.array("paper_id").alias("aliases"))
    found = normalized_entities(source.unionByName(entities.select("chunk_id", F.col("pos").cast("int").alias("pos"), "kind", "name", "aliases")))
    ends = resolved(triples, found).where("subject_id is not null and object_id is not null")
    confidence = F.col("confidence").cast("double")
    return found, ends.withColumn("confidence", F.coalesce(confidence, F.lit(0.0)) if default_confidence else confidence)


def audit_rows(cache: DataFrame, passages: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): cached triples (chunk_id, subject_id, predicate, object_id) beside their passage and the names and kinds of
    their ends within the chunk, UNKNOWN where there is none; those without a passage are skipped."""
    rows = cache.join(passages.select("chunk_id", "text"), "chunk_id", "left")
    for end in ("subject", "object"):
        own = entities.select("chunk_id", F.col("id").alias(f"{end}_id"), F.col("name").alias(end), F.col("kind").alias(f"{end}_kind"))
        rows = rows.join(own, ["chunk_id", f"{end}_id"], "left").withColumns({c: F.coalesce(c, F.lit("UNKNOWN")) for c in (end, f"{end}_kind")})
    return rows.where("text is not null"), rows.where("text is null").select("chunk_id").distinct()


def nodes(mentions: DataFrame) -> DataFrame:
    """Entities over all chunks from mentions (id, kind, name, aliases, chunk_id, paper_id, seq): the first name, the
    union of the rest. An id of two kinds fails."""
    kind = F.when(F.min("kind") != F.max("kind"), F.raise_error(F.concat(F.lit("two kinds for "), F.first("id")))).otherwise(F.min("kind"))
    union = lambda c: F.array_sort(F.collect_set(c))
    flat = mentions.withColumn("alias", F.explode_outer("aliases"))
    return flat.groupBy("id").agg(kind.alias("kind"), F.min_by("name", "seq").alias("name"), union("alias").alias("aliases"), union("chunk_id").alias("source_chunk_ids"), union("paper_id").alias("paper_ids"))


def edge_evidence(triples: DataFrame, seq: Column) -> DataFrame:
    """(edge_id, subject_id, predicate, object_id, chunk_id, paper_id, confidence): one row per edge and chunk, of repeated
    ones the last in the order of seq."""
    keyed = triples.withColumn("edge_id", edge_id(F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    last = F.max_by(F.struct("paper_id", "confidence"), seq).alias("_last")
    return keyed.groupBy("edge_id", "subject_id", "predicate", "object_id", "chunk_id").agg(last).select("edge_id", "subject_id", "predicate", "object_id", "chunk_id", "_last.paper_id", "_last.confidence")


def edges(evidence: DataFrame) -> DataFrame:
    """Edges with their evidence, in chunk order, and their best confidence."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_id", "paper_id", "confidence")))
    return evidence.groupBy("edge_id", "subject_id", "predicate", "object_id").agg(rows.alias("evidence"), F.max("confidence").alias("confidence"))


def aliases(node_table: DataFrame) -> DataFrame:
    """(kind, normalized_alias, ids, n): the entities that a spelling may mean."""
    spelled = node_table.select("id", "kind", F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    spelled = spelled.select("kind", normalize_name("alias").alias("normalized_alias"), "id").where("normalized_alias <> ''")
    return spelled.groupBy("kind", "normalized_alias").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("n", F.size("ids").cast("long"))


def decisions(pairs: DataFrame) -> DataFrame:
    """(entity_id, canonical_id) from worksheet rows (seq, entity_id_a, entity_id_b, decision, canonical_entity_id): of
    merges, the last one that names an entity. Unknown decisions and merges without a canonical id fail."""
    verdict = F.upper(F.trim("decision"))
    known = F.when(verdict.isin("MERGE", "KEEP_SEPARATE", "UNCERTAIN", "UNREVIEWED"), verdict).otherwise(F.raise_error(F.concat(F.lit("unknown decision "), verdict)))
    canonical = F.trim("canonical_entity_id")
    merges = pairs.withColumn("_d", known).where(F.col("_d") == "MERGE")
    canonical = F.when(F.coalesce(canonical, F.lit("")) == "", F.raise_error(F.lit("a merge needs a canonical id"))).otherwise(canonical)
    both = merges.withColumn("canonical_id", canonical).select("seq", "canonical_id", F.posexplode(F.array("entity_id_a", "entity_id_b")).alias("side", "entity_id"))
    return both.groupBy("entity_id").agg(F.max_by("canonical_id", F.struct("seq", "side")).alias("canonical_id"))


def merged(node_table: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes after merging: canonical ones with the provenance of their group, without the merged ones. Mappings are not
    chained; group members that don't exist are ignored, a missing canonical id drops out (see missing())."""
    to = mapping.withColumnRenamed("entity_id", "id")
    tagged = node_table.join(to, "id", "left")
    groups = mapping.select("canonical_id").distinct().withColumnRenamed("canonical_id", "id").withColumn("_canonical", F.lit(True))
    tagged = tagged.join(groups, "id", "left")
    parts = tagged.where("canonical_id is not null").select(F.col("canonical_id").alias("id"), "aliases", "source_chunk_ids", "paper_ids")
    heads = tagged.where("_canonical is not null")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    pooled = parts.unionByName(heads.select("id", "aliases", "source_chunk_ids", "paper_ids")).groupBy("id").agg(union("aliases"), union("source_chunk_ids"), union("paper_ids"))
    kept = heads.select("id", "kind", "name").join(pooled, "id")
    rest = tagged.where("_canonical is null and canonical_id is null").select("id", "kind", "name", "aliases", "source_chunk_ids", "paper_ids")
    return kept.unionByName(rest)


def remapped(edge_table: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with merged ends replaced; self-loops and parallel edges stay."""
    s, o = mapping.select(F.col("entity_id").alias("subject_id"), F.col("canonical_id").alias("_s")), mapping.select(F.col("entity_id").alias("object_id"), F.col("canonical_id").alias("_o"))
    out = edge_table.join(s, "subject_id", "left").join(o, "object_id", "left")
    return out.withColumns({"subject_id": F.coalesce("_s", "subject_id"), "object_id": F.coalesce("_o", "object_id")}).drop("_s", "_o")


def suggested_label(subject: Column, predicate: Column, obj: Column, passage: Column) -> Column:
    """true, uncertain or false by plain patterns: both names must occur; a relation's phrase between them makes it true;
    else first occurrences less than 100 characters apart make it uncertain."""
    text, s, o = F.lower(passage), F.lower(subject), F.lower(obj)
    quote = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    between = lambda phrase: F.concat(F.lit("(?s)"), quote(s), F.lit(f".*{phrase}.*"), quote(o))
    ahead = lambda phrase: F.concat(F.lit(f"(?s){phrase}.*"), quote(o))
    # fixed values: the phrases of each relation
    rules = {
        "USES": [between(rf"\b{v}\b") for v in ("uses", "applies", "employs", "utilizes")],
        "EVALUATES_ON": [between(r"\bevaluated? on\b"), between(r"\btested? on\b"), F.concat(F.lit(r"(?s)\beval.*"), quote(s), F.lit(".*"), quote(o))],
        "PROPOSES": [ahead(r"\bpropose"), ahead(r"\bintroduce"), ahead(r"\bpresent")],
        "CITES": [ahead(r"\bcites?\b"), ahead(r"\brefer.*to"), ahead(r"\[\d+\]")],
        "OUTPERFORMS": [between(r"\boutperforms?\b"), between(r"\bbetter than\b"), between(r"\bsurpasses\b")],
    }
    found = F.lit(False)
    for name, patterns in rules.items():
        for pattern in patterns:
            found = found | ((predicate == name) & F.regexp_like(text, pattern))
    present = F.contains(text, s) & F.contains(text, o)
    near = F.abs(F.instr(text, s) - F.instr(text, o)) < 100
    return F.when(~F.coalesce(present, F.lit(False)), "false").when(found, "true").when(near, "uncertain").otherwise("false")


def label_of(raw: Column) -> Column:
    """A boolean from reviewers' spellings; others fail, null stays null."""
    x = F.lower(F.trim(raw))
    return F.when(raw.isNull(), F.lit(None).cast("boolean")).when(x.isin("true", "yes", "correct", "1"), True).when(x.isin("false", "no", "incorrect", "0"), False).otherwise(F.raise_error(F.concat(F.lit("unknown label "), raw)).cast("boolean"))
