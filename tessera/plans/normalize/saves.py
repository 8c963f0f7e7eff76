"""Hand-made saves (N14 to N16) and agent memories (N18): texts to canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.text import tool_lines, transcript_turns
from tessera.schema import MEMORY_KINDS, conform

_FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$"

# What a file's name begins with, and an author's name, by source.
NAME_SOURCES = {"chatgpt": "chatgpt", "claude": "claude_ai", "gemini": "gemini", "perplexity": "perplexity", "grok": "grok", "qwen": "qwen", "kimi": "kimi", "deepseek": "deepseek"}


def front_value(content: Column, name: str) -> Column:
    """The value of a flat ``name: value`` line of a text's front matter; null without one."""
    head = F.regexp_extract(content, _FRONT, 1)
    return F.nullif(F.trim(F.regexp_extract(head, rf'(?m)^{name}:\s*"?([^"\n]*?)"?\s*$', 1)), F.lit(""))


def body(content: Column) -> Column:
    """The text behind the front matter."""
    return F.when(content.rlike(_FRONT), F.regexp_extract(content, _FRONT, 2)).otherwise(content)


def named_source(text: Column, default: str) -> Column:
    out = F.lit(default)
    for begin, source in NAME_SOURCES.items():
        out = F.when(F.lower(text).contains(begin), source).otherwise(out)
    return out


def _tables(files: DataFrame, turns: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    said = turns.join(files.select("path", "conversation_id", "source"), "path").withColumn(
        "sequence", F.expr("row_number() over (partition by conversation_id order by turn)")
    )
    messages = conform(said.withColumn("message_id", F.concat_ws("_", "conversation_id", F.col("sequence").cast("string"))), "messages")
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"))
    return conform(files.join(counts, "conversation_id").withColumn("capture_method", F.lit(method)), "conversations"), messages


def clipped_notes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips with front matter; the author names the source, the address ends in the id, quoted lines are the user's."""
    content = F.col("content")
    url = front_value(content, "source")
    heads = files.select(
        "path", F.coalesce(F.nullif(F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1), F.lit("")), F.substring(F.sha2("path", 256), 1, 16)).alias("conversation_id"),
        named_source(F.coalesce(front_value(content, "author"), F.lit("")), "chatgpt").alias("source"), url.alias("url"),
        F.coalesce(front_value(content, "title"), F.regexp_replace(F.regexp_replace("file_name", r"\.md$", ""), r"^\d{4}-\d{2}-\d{2}[ _-]*", "")).alias("title"),
        front_value(content, "created").try_cast("timestamp").alias("created_at"), body(content).alias("content"),
    )
    return _tables(heads, transcript_turns(heads, "blockquote"), "manual_clipping_obsidian")


def pasted_chats(files: DataFrame, style: str = "delimited") -> tuple[DataFrame, DataFrame]:
    """Pasted texts; the file's name begins with the source."""
    heads = files.select(
        "path", F.substring(F.sha2("path", 256), 1, 16).alias("conversation_id"), named_source(F.col("file_name"), "chatgpt").alias("source"),
        F.regexp_replace("file_name", r"\.[a-z]+$", "").alias("title"), F.col("modified").alias("created_at"), "content",
    )
    return _tables(heads, transcript_turns(heads, style), "manual_copypaste")


def terminal_transcripts(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terminal saves; printed tool lines become events."""
    heads = files.select(
        "path", F.substring(F.sha2("path", 256), 1, 16).alias("conversation_id"), F.lit("claude_code").alias("source"),
        F.regexp_replace("file_name", r"\.[a-z]+$", "").alias("title"), F.col("modified").alias("created_at"), "content",
    )
    marked = transcript_turns(heads.withColumn("content", F.regexp_replace("content", r"(?m)^(\s*)[⏺●](\s*[A-Z][A-Za-z_]*\()", "$1⏺$2")), "terminal")
    convs, messages = _tables(heads, marked, "manual_terminal_cc")
    lines = tool_lines(heads.select("path", "content")).join(heads.select("path", "conversation_id", "source"), "path")
    number = F.expr("row_number() over (partition by conversation_id order by line_no) - 1").cast("string")
    events = lines.withColumn("event_id", F.concat_ws("_evt_", "conversation_id", number)).withColumn("event_type", F.lower("tool_name"))
    return convs, messages, conform(events, "tool_events")


def agent_memories(files: DataFrame, source: str, listing: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """Memory files with their kind: the index file, a valid type, else other; size in UTF-8 bytes.

    ``listing`` (path) tells which files still are there, ``projects`` (project_key, project_path) where a project lies.
    """
    content = F.col("content")
    key = F.regexp_extract("path", r"/([^/]+)/memory/[^/]+$", 1)
    kind = front_value(content, "type")
    out = files.select(
        F.concat_ws(":", F.lit(source), key, "file_name").alias("memory_id"), F.lit(source).alias("source"), key.alias("project_key"), "file_name", "path",
        front_value(content, "name").alias("name"), front_value(content, "description").alias("description"),
        F.when(F.col("file_name") == "MEMORY.md", "index").when(kind.isin(*MEMORY_KINDS), kind).otherwise("other").alias("kind"),
        body(content).alias("content"), F.octet_length(content).cast("long").alias("content_size"), F.col("modified").alias("updated_at"),
    )
    if listing is not None:
        there = listing.select("path", F.lit(True).alias("__there")).distinct()
        out = out.join(there, "path", "left").withColumn("is_preserved_missing", F.col("__there").isNull()).drop("__there")
    if projects is not None:
        out = out.join(projects.groupBy("project_key").agg(F.min("project_path").alias("project_path")), "project_key", "left")
    return conform(out, "agent_memories")
