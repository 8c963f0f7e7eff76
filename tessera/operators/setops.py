"""Unions, keyed deduplication, set differences and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__tessera_rank"


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, columns matched by name, missing ones null."""
    if not parts:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(w)).filter(F.col(_RANK) == 1).drop(_RANK)


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys (null keys are equal) the last by ``order``.

    Key columns that the table lacks are left out; without any the table stays as it is. ``order``
    has to be total (file, row number), or the choice among equals is open.
    """
    present = [k for k in keys if k in df.columns]
    return _first_by(df, present, [F.col(f"`{c}`").desc_nulls_last() for c in order]) if present else df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows ``dedup_keep_last`` removes."""
    present = [F.col(f"`{k}`") for k in keys if k in df.columns]
    sizes = df.groupBy(*present).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the first; rows with a null in a key are all kept."""
    known = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
    first = _first_by(df.filter(known), keys, [F.col(f"`{c}`").asc_nulls_first() for c in order])
    return first.unionByName(df.filter(~known))


def merge_snapshots(rows: DataFrame, session: str, item: str, file_order: str, position: str) -> DataFrame:
    """U4: rows of one session from several files; each item once (first file wins), numbered anew.

    Adds ``sequence``, from 1 in each session in order of (file, position).
    """
    kept = dedup_keep_first(rows, [session, item], [file_order, position])
    w = Window.partitionBy(session).orderBy(file_order, position, item)
    return kept.withColumn("sequence", F.row_number().over(w).cast("long"))


def insert_if_absent(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first part that has their key; parts stand in order of precedence."""
    ranked = [p.withColumn("__priority", F.lit(k)) for k, p in enumerate(parts)]
    both = union_by_name(ranked)
    rest = sorted(c for c in both.columns if c not in (key, "__priority"))
    order = [F.col("__priority"), *[F.col(f"`{c}`").cast("string").asc_nulls_last() for c in rest]]
    return _first_by(both, [key], order).drop("__priority")


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key isn't in ``b``."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def also_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is in ``b`` too."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def sample_rows(df: DataFrame, picks: dict[str, tuple[Column, list[Column]]], key: str) -> DataFrame:
    """One row for each pick (a condition and an order), each key once, with the picks' names.

    A pick without rows is left out. Each is a top-1, so nothing is sorted as a whole.
    """
    parts = [df.filter(where).orderBy(*order).limit(1).withColumn("pick", F.lit(name)) for name, (where, order) in picks.items()]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    names = both.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("pick")), ",").alias("picks"))
    one = _first_by(both, [key], [F.col("pick")]).drop("pick")
    return one.join(names, key)


def sample_per_value(df: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """The first row of each value of ``column``."""
    return _first_by(df, [column], order)
