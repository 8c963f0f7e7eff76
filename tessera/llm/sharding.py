"""Contiguous shards of near-equal byte size from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored


def shard_by_bytes(
    docs: DataFrame,
    num_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Cut the documents, in order of id, into ``num_shards`` runs of near-equal byte size.

    The ids are range-partitioned and sorted; each partition's byte total goes into a prefix sum
    over partitions (one row each), and a row's global start is its partition's prefix plus a
    running sum inside the partition. A row belongs to the shard in whose equal slice of all bytes
    it starts, so a shard's size is off by less than one document at each end. No task holds more
    than a range of ids, and only (id, size, checksum) rows are shuffled, never texts.

    Returns doc_id, size, text_crc32, shard, slot (position in the shard, from 0), start (bytes of
    all documents before it).

    Defined cases: a null text has no bytes, size 1 and the checksum of no bytes (0), as has an
    empty one; rows with equal ids are ordered by checksum and size, so repeated rows are
    interchangeable; null ids come first; an empty table gives no rows; columns other than the
    two named are ignored.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    partitions = partitions or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written once: the cut points of a range partitioning come from a sample, and every later
    # step has to see the same ones even when tasks run again.
    ranged = stored(
        rows.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "shard-ranges"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    whole = Window.partitionBy()
    prefix = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(whole).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("pos", F.row_number().over(inside))
        .join(F.broadcast(prefix), "part")
        .withColumn("start", F.col("bytes_before") + F.col("run") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("pos") - 1)
        .withColumn("shard", F.expr(f"cast((start * {int(num_shards)}) div all_bytes as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"), "start"
    )
