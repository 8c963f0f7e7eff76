"""Raw documents: one document a file, JSON lines, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.trees import tree_texts


def _decoded(name: Column) -> Column:
    """A file's name as it is on disk; the reader gives it in URL form, in which a plus is a plus."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _texts(spark: SparkSession, path: str, glob: str, by_tasks: bool) -> DataFrame:
    """Whole files; ``by_tasks`` for trees whose file names are too many for the driver (see ``tree_texts`` for the paths)."""
    if by_tasks:
        return tree_texts(spark, path, glob)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"), _decoded(F.col("_metadata.file_name")).alias("file_name"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def json_documents(spark: SparkSession, path: str, glob: str = "*.json", by_tasks: bool = False) -> DataFrame:
    """A file a document, as (path, file_name, modified, doc); ``rejected`` has the files that don't parse."""
    return _texts(spark, path, glob, by_tasks).withColumn("doc", F.try_parse_json("value"))


def rejected(documents: DataFrame) -> DataFrame:
    """What was no JSON."""
    return documents.filter(F.col("doc").isNull() & (F.trim("value") != "")).select("path", "value")


def account_of(path: Column) -> Column:
    """The account that a path names (``account-<name>``), null without one."""
    return F.nullif(F.regexp_extract(path, r"account-([^/]+)", 1), F.lit(""))


def with_account(documents: DataFrame, id_col: str) -> DataFrame:
    """The account, and ids that no other account has."""
    account = account_of(F.col("path"))
    scoped = F.when(account.isNotNull(), F.concat(F.lit("account-"), account, F.lit("_"), F.col(id_col))).otherwise(F.col(id_col))
    return documents.withColumn("account", account).withColumn(id_col, scoped)


def json_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Session logs as (path, file, parent_file, line_no, doc, value); ids come from file names.

    ``line_no`` counts from 0 within each file, which may be split over tasks: within a block of a file
    lines are numbered by the scan, and each block's first number is the sum of the blocks before it.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    rows = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    blocks = blocks.select("path", "block", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return (
        rows.join(blocks, ["path", "block"])
        .withColumn("line_no", F.col("at") + F.col("shift"))
        .withColumn("file", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))
        .withColumn("parent_file", F.nullif(F.regexp_extract("path", r"/([^/]+)/subagents/[^/]+$", 1), F.lit("")))
        .withColumn("doc", F.try_parse_json("value"))
        .drop("at", "block", "shift")
    )


def text_files(spark: SparkSession, path: str, glob: str = "*.md", by_tasks: bool = False) -> DataFrame:
    """Whole texts with name and time."""
    return _texts(spark, path, glob, by_tasks).withColumnRenamed("value", "content")


def latest_snapshot(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """The newest file below ``path``, by modification time."""
    files = json_documents(spark, path, glob)
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(1)


def run_logs(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """Lines of the run logs of all platforms, (platform, folder, account, value, doc), in one read.

    A platform's log lies in its folder below ``root``, or in folders one level below that, one for each account; where both are, the
    platform's own counts. ``account`` is the folder's, without one null; a line's own account is up to M1. Blank lines are left out,
    lines that are no JSON have a null ``doc`` and are what ``rejected_lines`` gives. Logs in other places are none.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_name)
    lines = reader.text(root).select("value", _decoded(F.col("_metadata.file_path")).alias("path")).filter(F.trim("value") != "")
    place = F.split(F.split_part("path", F.lit(f"{base}/"), F.lit(2)), "/")
    placed = lines.select("value", "path", place.alias("place")).filter(F.size("place").isin(2, 3)).withColumn("platform", F.col("place")[0])
    own = placed.filter(F.size("place") == 2).select("platform").distinct().withColumn("flat", F.lit(True))
    chosen = placed.join(own, "platform", "left").filter((F.size("place") == 2) | F.col("flat").isNull())
    folder = F.when(F.size("place") == 3, F.col("place")[1])
    return chosen.select("platform", folder.alias("folder"), F.nullif(F.regexp_extract(folder, "^account-(.+)$", 1), F.lit("")).alias("account"), "value", F.try_parse_json("value").alias("doc"))


def rejected_lines(log: DataFrame) -> DataFrame:
    """Lines of run logs that are no JSON."""
    return log.filter("doc is null").select("platform", "folder", "value")
