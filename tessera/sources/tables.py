"""Processed and unified tables, views, logs and incremental intake."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.setops import dedup_keep_last, union_by_name
from tessera.schema import KEYS, TABLES, conform

#: Groups of sources.
PRESETS: dict[str, tuple[str, ...] | None] = {
    "web": ("chatgpt", "claude_ai", "deepseek", "gemini", "grok", "kimi", "perplexity", "qwen"),
    "cli": ("claude_code", "codex", "gemini_cli"),
    "rag": ("notebooklm",),
    "all": None,
}


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def table_of(file_name: Column) -> Column:
    """The table that a file name ends in; the longest name wins, others have none."""
    longest_first = sorted(KEYS, key=len, reverse=True)
    return F.nullif(F.regexp_extract(file_name, rf"(?:^|_)({'|'.join(longest_first)})\.parquet$", 1), F.lit(""))


def source_of_file(file_name: Column, table: Column) -> Column:
    """What stands before the table's name, without ``_manual``."""
    stem = F.regexp_replace(file_name, r"\.parquet$", "")
    return F.regexp_replace(F.substring(stem, F.lit(1), F.length(stem) - F.length(table) - 1), "_manual$", "")


def discover_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every Parquet file below ``folder`` with its table (null: unknown), source, size and time.

    Only the listing is read; contents stay where they are.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    ).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("file_name", name).withColumn("table_name", table_of(name)).withColumn(
        "source", F.when(F.col("table_name").isNotNull(), source_of_file(name, F.col("table_name")))
    )


def read_parts(spark: SparkSession, paths: Iterable[str], default_source: str | None = None) -> DataFrame:
    """The files as one table by name, each row with its file and place in it."""
    parts = []
    for path in paths:
        one = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        if "source" not in one.columns:
            file_name = F.element_at(F.split("__file", "/"), -1)
            one = one.withColumn("source", F.lit(default_source) if default_source else source_of_file(file_name, table_of(file_name)))
        parts.append(one)
    return union_by_name(parts)


def unify(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    """One table from all its files; of equal keys the last row of the last file stays."""
    return dedup_keep_last(read_parts(spark, sorted(paths)), list(KEYS[table]), ["__file", "__row"]).drop("__file", "__row")


def register_views(
    spark: SparkSession, folder: str, source: str, tables: Iterable[str], account: str | None = None
) -> dict[str, dict[str, int]]:
    """A view for each table over its automatic and manual part; tables without a part get none.

    ``account`` keeps the rows of one account in tables that have the column. Returns the parts' row counts.
    """
    found: dict[str, dict[str, int]] = {}
    for table in tables:
        parts = {"extractor": _there(spark, f"{folder}/{source}_{table}.parquet"), "manual": _there(spark, f"{folder}/{source}_manual_{table}.parquet")}
        there = {k: p for k, p in parts.items() if p is not None}
        if not there:
            continue
        found[table] = {k: p.count() for k, p in there.items()}
        view = union_by_name(list(there.values()))
        if account is not None and "account" in view.columns:
            view = view.filter(F.col("account") == F.lit(account))
        view.createOrReplaceTempView(table)
    return found


def read_table(spark: SparkSession, folder: str, table: str, sources: Iterable[str] | str | None = None) -> DataFrame:
    """A unified table, of some sources only (a preset's name, or a list); the filter prunes partitions."""
    df = spark.read.parquet(f"{folder}/{table}")
    chosen = PRESETS[sources] if isinstance(sources, str) else sources
    return df if chosen is None else df.filter(F.col("source").isin(*chosen))


def write_table(df: DataFrame, folder: str, table: str, by_source: bool = True, keep_empty: bool = True) -> bool:
    """Overwrite a table, partitioned by source; an empty one is written with its schema or not at all."""
    whole = conform(df, table) if table in TABLES else df
    if not keep_empty and whole.isEmpty():
        return False
    writer = whole.write.mode("overwrite")
    (writer.partitionBy("source") if by_source and "source" in whole.columns else writer).parquet(f"{folder}/{table}")
    return True


def read_index(spark: SparkSession, path: str, key: str, schema: str | None = None) -> DataFrame:
    """An index or manifest (a JSON array of records); records without a key are left out."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", "true").json(path).filter(F.col(key).isNotNull())


def append_log(entry: DataFrame, path: str) -> None:
    """Add run entries to a JSON-lines log."""
    entry.write.mode("append").json(path)


def newest_runs(log: DataFrame, k: int = 10, at: str = "at") -> DataFrame:
    """The newest entries first."""
    return log.orderBy(F.desc_nulls_last(at)).limit(k)


def rotated(log: DataFrame, cap: int, keep: int, at: str = "at") -> DataFrame:
    """All entries, or the newest ``keep`` once there are more than ``cap``."""
    return newest_runs(log, keep, at) if log.count() > cap else log


def new_files(listing: DataFrame, taken: DataFrame) -> DataFrame:
    """Files of ``listing`` (path, modificationTime) that ``taken`` lacks or has in an older state."""
    old = taken.groupBy("path").agg(F.max("modificationTime").alias("__taken"))
    fresh = listing.join(old, "path", "left").filter(F.col("__taken").isNull() | (F.col("modificationTime") > F.col("__taken")))
    return fresh.withColumn("state", F.when(F.col("__taken").isNull(), "new").otherwise("updated")).drop("__taken")


def file_statistics(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """M9: number, bytes and newest time of files; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("length", "modificationTime").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")
    )


def latest_per(files: DataFrame, prefix: Column, order: str = "modificationTime") -> DataFrame:
    """Of files with one prefix the newest."""
    w = Window.partitionBy("__prefix").orderBy(F.desc(order), F.desc("path"))
    return files.withColumn("__prefix", prefix).withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__prefix")
