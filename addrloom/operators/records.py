"""Operators on record tables: first-wins dedupe, cache probes, last-value folding, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's smallest `order` and its number of rows: (key, first, copies). Pre-aggregated, so no hot key gathers."""
    return df.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def pointed(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with `first`, the smallest order of its key, and is_first. Rows with an empty key are their own first."""
    firsts = first_of_key(df.where(F.col(key) != ""), key, order).select(key, "first")
    out = df.join(firsts, key, "left").withColumn("first", F.coalesce("first", order))
    return out.withColumn("is_first", F.col("first") == F.col(order))


def split_by_cache(df: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, rows whose key the cache lacks)."""
    return df.join(cache, key), df.join(cache.select(key), key, "left_anti")


def fold_last(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each key's last non-null value of every column by `order`, and its number of rows n."""
    last = [F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    return df.groupBy(key).agg(*last, F.count("*").alias("n"))


def unique_parent(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Children that occur under one parent only, with it: what a lower unit tells about the higher one."""
    return df.groupBy(child).agg(F.min(parent).alias(parent), F.max(parent).alias("_last")).where(F.col(parent) == F.col("_last")).drop("_last")


def fuzzy_pairs(left: DataFrame, right: DataFrame, cutoff: int) -> DataFrame:
    """(l, r, distance) of names within `cutoff` edits with equal first letter and word count: blocks, then distance."""
    block = lambda df, c: df.select(F.col(c), F.substring(c, 1, 1).alias("_c"), F.size(F.split(c, " ")).alias("_w"))
    near = block(left, "l").join(block(right, "r"), ["_c", "_w"]).withColumn("distance", F.levenshtein("l", "r", cutoff))
    return near.where("distance >= 0").select("l", "r", "distance")


def flag_score(flags: Column, penalties: dict[str, float], default: float = 0.03) -> Column:
    """1 less each flag's penalty, within 0 and 1, to three places."""
    table = F.create_map(*[F.lit(x) for pair in penalties.items() for x in pair])
    total = F.aggregate(flags, F.lit(0.0), lambda acc, f: acc + F.coalesce(F.element_at(table, f), F.lit(default)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - total)), 3)


def batches(df: DataFrame, order: str, size: int, most: int) -> DataFrame:
    """The first `most` rows by `order` (the feature: a request cap) with their 0-based batch of `size`."""
    capped = df.orderBy(order).limit(most)
    return capped.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("bigint"))


def components(df: DataFrame, lists: list[str], key: str) -> DataFrame:
    """One row for each distinct non-empty value of the list columns, in order; one row with a null where there is none.

    Null lists are empty.
    """
    tag = lambda c: lambda v: F.struct(F.lit(c).alias("kind"), v.alias("value"))  # noqa: E731  a second argument would be the index
    tagged = [F.transform(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: v != "")), tag(c)) for c in lists]
    return df.select(key, F.posexplode_outer(F.concat(*tagged)).alias("position", "item")).select(key, F.col("position").cast("bigint").alias("position"), "item.kind", "item.value")
