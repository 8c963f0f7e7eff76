"""The canonical tables: columns and types, keys, allowed values, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The allowed sources, roles, modes, kinds and output types of the canonical schema.
SOURCES = (
    "chatgpt", "claude_ai", "claude_code", "codex", "deepseek", "gemini",
    "gemini_cli", "grok", "kimi", "notebooklm", "perplexity", "qwen",
)
ROLES = ("user", "assistant", "system")
MODES = ("chat", "search", "research", "copilot", "concise", "dalle", "cli")
INTERACTION_TYPES = ("human_ai", "ai_ai")
MEMORY_KINDS = ("user", "feedback", "project", "reference", "index", "other")
NOTE_KINDS = ("note", "brief")

#: Primary keys; only the columns that a table has are used.
KEYS: dict[str, tuple[str, ...]] = {
    "conversations": ("source", "conversation_id"),
    "messages": ("source", "conversation_id", "message_id"),
    "tool_events": ("source", "conversation_id", "event_id"),
    "branches": ("source", "conversation_id", "branch_id"),
    "sources": ("source", "project_id", "doc_id"),
    "notes": ("source", "conversation_id", "note_id"),
    "outputs": ("source", "conversation_id", "output_id"),
    "guide_questions": ("source", "conversation_id", "question_id"),
    "source_guides": ("source", "conversation_id", "source_id"),
    "project_metadata": ("source", "project_id"),
    "project_docs": ("source", "project_id", "doc_id"),
    "conversation_projects": ("source", "conversation_id", "project_tag"),
    "agent_memories": ("source", "memory_id"),
}


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from "name type" pairs; needs no session, so tables can be declared at import."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


TABLES: dict[str, T.StructType] = {
    "conversations": struct(
        "conversation_id string, source string, title string, created_at timestamp, updated_at timestamp, message_count long, "
        "model string, account string, mode string, project string, url string, interaction_type string, parent_session_id string, "
        "project_id string, gizmo_id string, gizmo_name string, gizmo_resolved boolean, is_preserved_missing boolean, "
        "last_seen_in_server timestamp, is_pinned boolean, is_archived boolean, is_temporary boolean, summary string, "
        "settings_json string, capture_method string"
    ),
    "messages": struct(
        "message_id string, conversation_id string, source string, sequence long, role string, content string, model string, "
        "created_at timestamp, account string, token_count long, word_count long, attachment_names string, content_types string, "
        "thinking string, tool_results string, branch_id string, asset_paths array<string>, finish_reason string, is_hidden boolean, "
        "hidden_reason string, is_voice boolean, voice_direction string, citations_json string, attachments_json string, "
        "start_timestamp timestamp, stop_timestamp timestamp"
    ),
    "tool_events": struct(
        "event_id string, conversation_id string, message_id string, source string, event_type string, tool_name string, "
        "file_path string, command string, duration_ms long, success boolean, metadata_json string, result string"
    ),
    "branches": struct(
        "branch_id string, conversation_id string, source string, root_message_id string, leaf_message_id string, "
        "is_active boolean, created_at timestamp, parent_branch_id string"
    ),
    "conversation_projects": struct("conversation_id string, project_tag string, tagged_by string, confidence double, source string"),
    "project_docs": struct(
        "doc_id string, project_id string, source string, file_name string, content string, content_size long, "
        "estimated_token_count long, created_at timestamp"
    ),
    "agent_memories": struct(
        "memory_id string, source string, project_path string, project_key string, file_name string, name string, description string, "
        "kind string, content string, content_size long, created_at timestamp, updated_at timestamp, is_preserved_missing boolean"
    ),
    "notes": struct(
        "note_id string, conversation_id string, source string, account string, title string, content string, kind string, "
        "source_refs_json string, created_at timestamp"
    ),
    "outputs": struct(
        "output_id string, conversation_id string, source string, account string, output_type int, output_type_name string, "
        "title string, status string, asset_path array<string>, content string, source_refs_json string, created_at timestamp"
    ),
    "source_guides": struct(
        "source_id string, conversation_id string, source string, account string, summary string, tags_json string, questions_json string"
    ),
    "guide_questions": struct(
        "question_id string, conversation_id string, source string, account string, question_text string, full_prompt string, order long"
    ),
}

#: Values that take a missing column's or a null's place.
DEFAULTS: dict[str, dict[str, object]] = {
    "conversations": {
        "interaction_type": "human_ai", "gizmo_resolved": True, "is_preserved_missing": False, "capture_method": "extractor",
    },
    "messages": {"is_hidden": False, "is_voice": False},
    "tool_events": {},
    "branches": {"is_active": False},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns and types of ``table``; missing columns are null or their default.

    An empty ``branch_id`` of a message becomes the conversation's main branch.
    """
    defaults = DEFAULTS.get(table, {})
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`").cast(field.dataType) if field.name in have else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            c = F.coalesce(c, F.lit(defaults[field.name]).cast(field.dataType))
        if table == "messages" and field.name == "branch_id":
            main = F.concat(F.col("conversation_id").cast("string"), F.lit("_main"))
            c = F.when(F.coalesce(c, F.lit("")) == "", main).otherwise(c)
        return c.alias(field.name)

    return df.select(*[column(f) for f in TABLES[table].fields])


def rules(table: str, output_types: dict[int, str] | None = None) -> dict[str, Column]:
    """Named conditions that a row of ``table`` must not meet."""
    out_of = lambda c, allowed: F.col(c).isNotNull() & ~F.col(c).isin(*allowed)
    found = {"source": out_of("source", SOURCES)}
    if table == "conversations":
        found |= {"mode": out_of("mode", MODES), "interaction_type": out_of("interaction_type", INTERACTION_TYPES)}
    if table == "messages":
        found |= {"role": out_of("role", ROLES) | F.col("role").isNull()}
    if table == "agent_memories":
        found |= {"kind": out_of("kind", MEMORY_KINDS)}
    if table == "notes":
        found |= {"kind": out_of("kind", NOTE_KINDS)}
    if table == "outputs" and output_types:
        names = F.create_map(*[F.lit(x) for pair in output_types.items() for x in pair])
        found |= {"output_type": ~names[F.col("output_type")].eqNullSafe(F.col("output_type_name"))}
    for key in KEYS.get(table, ()):
        found[f"{key} is missing"] = F.col(key).isNull()
    return found


def validate(df: DataFrame, table: str, **more) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rejected rows with ``violations``: the broken rules, comma-separated)."""
    broken = [F.when(condition, F.lit(name)) for name, condition in rules(table, **more).items()]
    marked = df.withColumn("violations", F.concat_ws(",", *broken))
    return marked.filter("violations = ''").drop("violations"), marked.filter("violations <> ''")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# Output type numbers and their names.
OUTPUT_TYPES = {
    1: "audio_overview",
    2: "blog_post",
    3: "video_overview",
    4: "flashcards_quiz",
    7: "data_table",
    8: "slide_deck",
    9: "infographic",
    10: "mind_map",
}
