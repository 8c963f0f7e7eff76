"""Canonical tables for the registered queries, derived from the given tables.

Orders stand in for conversations, conversation turns for messages, events for tool events. The
DuckDB twins define the same views as common table expressions.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source_of(number) -> Column:
    rest = number % 4
    return F.when(rest == 0, "chatgpt").when(rest == 1, "claude_ai").when(rest == 2, "gemini").otherwise("codex")


@dataclass
class Views:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @functools.cached_property
    def conversations(self) -> DataFrame:
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            key.cast("string").alias("conversation_id"),
            source_of(key).alias("source"),
            (customer % 3 + 1).cast("string").alias("account"),
            F.expr("timestampadd(HOUR, cast(o_orderkey % 24 as int), o_orderdate)").alias("created_at"),
            F.expr(
                "timestampadd(HOUR, cast((o_custkey * 37) % 3000 as int), timestampadd(HOUR, cast(o_orderkey % 24 as int), o_orderdate))"
            ).alias("updated_at"),
            (customer % 230).cast("long").alias("message_count"),
            F.when(key % 10 != 0, F.col("o_orderpriority")).alias("model"),
            F.when((key % 4 != 2) & (customer % 3 == 0), F.concat(F.lit("p"), (customer % 50).cast("string"))).alias("project_id"),
            (F.col("o_orderstatus") == "F").alias("is_preserved_missing"),
            F.when(key % 4 != 3, key % 17 == 0).alias("is_pinned"),
            F.when(key % 20 == 0, "manual_copypaste").when(key % 2 != 0, "extractor").alias("capture_method"),
        )

    @functools.cached_property
    def messages(self) -> DataFrame:
        conv, turn = F.col("conv_id").cast("string"), F.col("turn")
        node = lambda t: F.concat(conv, F.lit("_"), t.cast("string"))
        return self.table("conversations").select(
            node(turn).alias("message_id"),
            conv.alias("conversation_id"),
            source_of(F.col("conv_id")).alias("source"),
            (turn + 1).cast("long").alias("sequence"),
            "role",
            F.col("text").alias("content"),
            F.when(turn == 0, None).when(turn % 3 == 2, node(turn - 2)).otherwise(node(turn - 1)).alias("parent_id"),
            (F.col("role") == "system").alias("is_hidden"),
            F.when((F.col("role") == "assistant") & (turn % 5 == 1), F.col("text")).alias("thinking"),
            F.when(F.col("role") == "assistant", F.length("text").cast("long")).alias("token_count"),
            F.when(F.col("role") == "assistant", F.concat(F.lit("m"), (F.col("conv_id") % 7).cast("string"))).alias("model"),
            F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long").alias("word_count"),
        )

    @functools.cached_property
    def tool_events(self) -> DataFrame:
        event = F.col("event_id")
        kind = F.col("event_type")
        return self.table("events").select(
            event.cast("string").alias("event_id"),
            F.col("user_id").cast("string").alias("conversation_id"),
            kind,
            F.when(kind != "view", F.concat(F.lit("tool_"), (event % 30).cast("string"))).alias("tool_name"),
            F.when(event % 5 != 0, F.floor(F.col("value") * 10).cast("long")).alias("duration_ms"),
            F.when(kind == "error", False).when(kind == "view", None).otherwise(True).alias("success"),
            source_of(event).alias("source"),
            F.col("ts").alias("created_at"),
            F.col("props").alias("metadata_json"),
        )


# The same views for DuckDB.
_SOURCE = "CASE {0} % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude_ai' WHEN 2 THEN 'gemini' ELSE 'codex' END"
SQL_VIEWS = {
    "c": f"""SELECT CAST(o_orderkey AS VARCHAR) AS conversation_id, {_SOURCE.format("o_orderkey")} AS source,
        CAST(o_custkey % 3 + 1 AS VARCHAR) AS account,
        o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created_at,
        o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_hours(CAST((o_custkey * 37) % 3000 AS INTEGER)) AS updated_at,
        CAST(o_custkey % 230 AS BIGINT) AS message_count,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS model,
        CASE WHEN o_orderkey % 4 <> 2 AND o_custkey % 3 = 0 THEN 'p' || CAST(o_custkey % 50 AS VARCHAR) END AS project_id,
        o_orderstatus = 'F' AS is_preserved_missing,
        CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 17 = 0 END AS is_pinned,
        CASE WHEN o_orderkey % 20 = 0 THEN 'manual_copypaste' WHEN o_orderkey % 2 <> 0 THEN 'extractor' END AS capture_method
        FROM orders""",
    "m": f"""SELECT conv_id || '_' || turn AS message_id, CAST(conv_id AS VARCHAR) AS conversation_id,
        {_SOURCE.format("conv_id")} AS source, CAST(turn + 1 AS BIGINT) AS sequence, role, text AS content,
        CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN conv_id || '_' || (turn - 2) ELSE conv_id || '_' || (turn - 1) END AS parent_id,
        role = 'system' AS is_hidden, CASE WHEN role = 'assistant' AND turn % 5 = 1 THEN text END AS thinking,
        CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) END AS token_count,
        CASE WHEN role = 'assistant' THEN 'm' || (conv_id % 7) END AS model,
        CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count
        FROM conversations""",
    "e": f"""SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS conversation_id, event_type,
        CASE WHEN event_type <> 'view' THEN 'tool_' || (event_id % 30) END AS tool_name,
        CASE WHEN event_id % 5 <> 0 THEN CAST(FLOOR(value * 10) AS BIGINT) END AS duration_ms,
        CASE WHEN event_type = 'error' THEN FALSE WHEN event_type = 'view' THEN NULL ELSE TRUE END AS success,
        {_SOURCE.format("event_id")} AS source, ts AS created_at, props AS metadata_json FROM events""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` below the named views; its own CTEs may follow as ``WITH``."""
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {sql[len('WITH RECURSIVE'):]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {ctes}, {sql[len('WITH'):]}"
    return f"WITH {ctes} {sql}"
