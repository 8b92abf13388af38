"""Small relational building blocks: quotas, samples, last-wins tables, integrity checks, cache lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .ranking import check


def top_n(df: DataFrame, group: str, n: int, *order: Column, strict: bool = False) -> DataFrame:
    """The first n rows of each group with their place; strict fails where a group is shorter."""
    check(n >= 1, "n must be at least 1")
    out = df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("place") <= n)
    if strict:
        size = F.count(F.lit(1)).over(Window.partitionBy(group))
        short = F.raise_error(F.concat(F.lit("too few rows in group "), F.col(group).cast("string"))).cast("long")
        out = out.withColumn("place", F.when(size < n, short).otherwise(F.col("place")))
    return out


def hash_order(seed: str, key: Column) -> Column:
    """A pseudo-random order that every engine agrees on."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, n: int, seed: str, group: str | None = None) -> DataFrame:
    """n rows of the table or of each group in hash order; all of them where there are fewer."""
    order = hash_order(seed, F.col(key))
    if group:
        return top_n(df, group, n, order, F.col(key))
    return df.orderBy(order, key).limit(n)


def quotas(groups: DataFrame, group: str, limit: int) -> DataFrame:
    """(group, quota): limit dealt evenly, what is left over to the earliest groups. A row per group is ranked."""
    place = F.row_number().over(Window.orderBy(group)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return groups.select(group).distinct().select(group, (F.floor(F.lit(limit) / n) + F.when(place < F.lit(limit) % n, 1).otherwise(0)).cast("long").alias("quota"))


def quota_selection(df: DataFrame, group: str, limit: int, *order: Column) -> DataFrame:
    dealt = quotas(df, group, limit)
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return ranked.join(F.broadcast(dealt), group).where("place <= quota")


def stratified_quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, size, quota): even quotas; what short strata leave goes to the others in stratum order."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    even = sizes.join(quotas(sizes, stratum, total), stratum)
    even = even.withColumns({"base": F.least("size", "quota"), "room": F.greatest(F.col("size") - F.col("quota"), F.lit(0))})
    spill = F.lit(total) - F.sum("base").over(Window.partitionBy())
    before = F.coalesce(F.sum("room").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return even.select(stratum, "size", (F.col("base") + F.least(F.col("room"), F.greatest(spill - before, F.lit(0)))).cast("long").alias("quota"))


def last_wins(df: DataFrame, key: str | list[str], seq: Column, *values: str) -> DataFrame:
    """One row per key: the values of the largest seq."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_last")).select(*keys, *(F.col(f"_last.{v}").alias(v) for v in values))


def first_wins(df: DataFrame, key: str | list[str], seq: Column, *values: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), seq).alias("_first")).select(*keys, *(F.col(f"_first.{v}").alias(v) for v in values))


def missing(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct keys of df that known lacks."""
    return df.select(F.col(key).alias("missing")).distinct().join(known.select(F.col(known_key).alias("missing")).distinct(), "missing", "left_anti")


def require_none(df: DataFrame, what: str) -> None:
    """Fail with the first five of a set of missing keys."""
    rows = [r[0] for r in df.orderBy(df.columns[0]).limit(5).collect()]
    if rows:
        raise ValueError(f"{what}: {rows}")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lookup(items: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached result, rows to compute)."""
    return items.join(cache, key), items.join(cache.select(key).distinct(), key, "left_anti")


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df sorted over all partitions, with the number of each row's partition as _part: written out, so that it stays."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())


def _earlier(placed: DataFrame, sums: list[str], group: list[str]) -> DataFrame:
    """(group, _part) with the sums of earlier partitions: a row per partition that holds rows of the group."""
    totals = placed.groupBy(*group, "_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))


def running(df: DataFrame, order: str, sums: list[str], group: list[str] | None = None) -> DataFrame:
    """df with ``{c}_below`` for each of sums: its total over the rows of the group with a smaller order value, values being
    distinct within a group. A range-partitioned sort, sums per partition and offsets: no task sees more than its range."""
    group = group or []
    placed = ranged(df, *group, order)
    inside = Window.partitionBy(*group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(_earlier(placed, sums, group)) if not group else _earlier(placed, sums, group), [*group, "_part"])
    return out.withColumns({f"{c}_below": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).drop("_part", *(f"_{c}" for c in sums))


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the place of each row in the whole order, from 1."""
    placed = ranged(df.withColumn("_one", F.lit(1)), *order)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(_earlier(placed, ["_one"], [])), "_part").withColumn(name, (F.col("__one") + inside).cast("long")).drop("_part", "_one", "__one")


def low_ranks(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): the value at floor(share * (n - 1)) of the group's sorted values, never
    interpolated. Values are counted first and never gathered."""
    per = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    below = running(per, value, ["_n"], [group])
    total = per.groupBy(group).agg(F.sum("_n").alias("_all"))
    at = lambda q: F.floor(F.lit(q) * (F.col("_all") - 1))
    pick = lambda q: F.max(F.when((F.col("_n_below") <= at(q)) & (at(q) < F.col("_n_below") + F.col("_n")), F.col(value)))
    return below.join(total, group).groupBy(group).agg(*(pick(q).alias(name) for name, q in shares.items()))


def must_join(left: DataFrame, right: DataFrame, on: list[str], what: str) -> DataFrame:
    """An inner join in which a row of left without a partner fails, naming its key."""
    failed = F.raise_error(F.concat(F.lit(f"{what}: "), F.concat_ws(",", *(F.col(c).cast("string") for c in on)))).cast("boolean")
    joined = left.join(right.withColumn("_found", F.lit(True)), on, "left")
    return joined.where(F.when(F.col("_found").isNull(), failed).otherwise(F.lit(True))).drop("_found")


def require_count(df: DataFrame, least: int, most: int, what: str) -> int:
    """The number of rows; fails outside the given range."""
    n = df.count()
    if not least <= n <= most:
        raise ValueError(f"{what}: {n} rows, not {least} to {most}")
    return n


def not_subset(df: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    """(key, extra): rows whose array ``part`` holds what ``whole`` lacks."""
    return df.select(key, F.array_except(part, whole).alias("extra")).where(F.size("extra") > 0)


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right, moved) of two tables (pos, key): keys of one side only, and keys at another place."""
    both = left.select(key, F.col("pos").alias("_l")).join(right.select(key, F.col("pos").alias("_r")), key, "full_outer")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(F.col("_l") != F.col("_r")).alias("moved"))


def page(df: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    """Rows from an offset on in an order; a limit of 0 means all."""
    check(offset >= 0 and limit >= 0, "offset and limit must be at least 0")
    out = df.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def most_common(df: DataFrame, keys: list[str], k: int, seq: Column) -> DataFrame:
    """The k most frequent keys with their count, ties by which was seen first."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, seed: str) -> DataFrame:
    """``total`` rows, dealt by stratified_quotas and drawn in hash order within each stratum."""
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key)
    ranked = df.withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.join(F.broadcast(stratified_quotas(df, stratum, total).select(stratum, "quota")), stratum).where("place <= quota").drop("quota")


def batch_counts(tables: dict[str, DataFrame], size: int) -> DataFrame:
    """(relation, rows, batches)."""
    check(size >= 1, "batch size must be at least 1")
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("relation"), "rows", F.ceil(F.col("rows") / size).cast("long").alias("batches"))
        out = one if out is None else out.unionByName(one)
    return out
