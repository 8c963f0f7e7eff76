"""Session logs of coding agents (N3 to N5): JSON lines to sessions, messages and tool events.

Lines come as (path, file, parent_file, line_no, doc) of ``sources.json_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.operators.enrich import attach_reasoning, exec_ends, tool_results
from tessera.operators.setops import dedup_keep_first, merge_snapshots
from tessera.schema import conform


def _get(path: str, kind: str = "string"):
    return F.try_variant_get("doc", path, kind)


def _sessions(messages: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Conversations from their messages: counts and time window, then other known columns, which come first."""
    each = messages.groupBy("conversation_id", "source").agg(
        F.count("*").alias("message_count"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
    ).withColumn("mode", F.lit("cli"))
    if extra is not None:
        both = [c for c in extra.columns if c in each.columns and c != "conversation_id"]
        joined = each.join(extra.withColumnsRenamed({c: f"__{c}" for c in both}), "conversation_id", "left")
        each = joined.withColumns({c: F.coalesce(f"__{c}", c) for c in both}).drop(*[f"__{c}" for c in both])
    return conform(each, "conversations")


def _joined(texts, between: str = "\n\n"):
    """The texts with a blank line between them; null without any."""
    return F.when(F.size(texts) > 0, F.array_join(texts, between))


def claude_code_sessions(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, tool events). Replayed lines count once; side chains count in sub-sessions only.

    Every line of the assistant is a message, with text or without; a user line that holds neither text nor a picture is
    none: the results in it go to their calls. Conversations are named by their file; chains of files are joined by G4 and G5.
    """
    rows = lines.filter(F.col("doc").isNotNull() & _get("$.type").isin("user", "assistant"))
    side = F.coalesce(_get("$.isSidechain", "boolean"), F.lit(False))
    rows = rows.filter(~side | F.col("parent_file").isNotNull()).withColumn("uuid", F.nullif(_get("$.uuid"), F.lit("")))
    rows = rows.withColumn("replay", F.coalesce("uuid", F.concat(F.lit("line "), F.col("line_no").cast("string"))))
    rows = dedup_keep_first(rows, ["path", "replay"], ["line_no"]).drop("replay")
    whole = F.schema_of_variant(F.try_variant_get("doc", "$.message.content", "variant")) == "STRING"
    rows = rows.withColumn("blocks", F.try_variant_get("doc", "$.message.content", "array<variant>")).withColumn("text", F.when(whole, _get("$.message.content")))
    block = lambda b, p: F.try_variant_get(b, p, "string")
    texts_of = lambda kind, field: _joined(
        F.transform(F.filter("blocks", lambda b: block(b, "$.type") == kind), lambda b: F.coalesce(block(b, f"$.{field}"), F.lit("")))
    )
    role = _get("$.type")
    shown = F.when(role == "user", F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("text"), F.lit("thinking"), F.lit("tool_use")))
    types = F.filter(F.array_distinct(F.transform("blocks", lambda b: block(b, "$.type"))), lambda t: F.array_contains(shown, t))
    has = lambda kind: F.coalesce(F.exists("blocks", lambda b: block(b, "$.type") == kind), F.lit(False))
    spoken = (role == "assistant") | (F.trim(F.coalesce("text", F.lit(""))) != "") | has("text") | has("image")
    used = lambda k: F.coalesce(F.try_variant_get("doc", f"$.message.usage.{k}_tokens", "long"), F.lit(0))
    said = rows.filter(spoken).select(
        F.col("file").alias("conversation_id"), F.lit("claude_code").alias("source"), F.col("uuid").alias("message_id"), "line_no", role.alias("role"),
        F.coalesce(texts_of("text", "text"), "text", F.lit("")).alias("content"), F.when(role == "assistant", texts_of("thinking", "thinking")).alias("thinking"),
        F.when(role == "assistant", _get("$.message.model")).alias("model"), X.to_ts(_get("$.timestamp")).alias("created_at"),
        F.when(role == "assistant", F.nullif(used("input") + used("output"), F.lit(0))).alias("token_count"),
        F.coalesce(F.nullif(F.array_join(F.array_sort(types), ","), F.lit("")), F.lit("text")).alias("content_types"),
    )
    said = said.withColumn("sequence", F.expr("row_number() over (partition by conversation_id order by line_no)"))
    messages = conform(said.withColumn("message_id", F.coalesce("message_id", F.concat_ws("_", "conversation_id", "sequence"))), "messages")
    parts = rows.select(F.col("file").alias("session"), F.col("uuid").alias("message_id"), "line_no", role.alias("role"), F.posexplode("blocks").alias("at", "b"))
    calls = parts.filter((F.col("role") == "assistant") & (F.try_variant_get("b", "$.type", "string") == "tool_use")).select(
        "session", F.coalesce("message_id", F.lit("")).alias("message_id"), "line_no", "at", F.try_variant_get("b", "$.id", "string").alias("call_id"), F.try_variant_get("b", "$.name", "string").alias("tool_name"),
        F.try_variant_get("b", "$.input.command", "string").alias("command"), F.try_variant_get("b", "$.input.file_path", "string").alias("file_path"),
    )
    results = parts.filter((F.col("role") == "user") & (F.try_variant_get("b", "$.type", "string") == "tool_result")).select(
        "session", F.try_variant_get("b", "$.tool_use_id", "string").alias("call_id"), F.try_variant_get("b", "$.is_error", "boolean").alias("is_error"),
        F.try_variant_get("b", "$.content", "string").alias("content"), F.struct("line_no", "at").alias("ord"),
    )
    done = tool_results(calls, results)
    number = F.expr("row_number() over (partition by session order by line_no, at) - 1").cast("string")
    events = done.withColumn("event_id", F.coalesce(F.nullif("call_id", F.lit("")), F.concat_ws("_tool_", "session", number))).withColumn("event_type", F.lit("tool_call")).withColumn("source", F.lit("claude_code"))
    first = lambda path: F.min_by(_get(path), F.when(F.coalesce(_get(path), F.lit("")) != "", F.col("line_no")))
    facts = rows.groupBy(F.col("file").alias("conversation_id")).agg(first("$.cwd").alias("project"), first("$.slug").alias("title"), F.max("parent_file").alias("parent_session_id"))
    facts = facts.withColumn("interaction_type", F.when(F.col("parent_session_id").isNotNull(), "ai_ai").otherwise("human_ai"))
    return _sessions(messages, facts), messages, conform(events.withColumnRenamed("session", "conversation_id"), "tool_events")


def codex_sessions(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages of both sides in order of time, reasoning attached (E7), calls with the end of their execution.

    A session has the id of its last meta line, and the model of its first context; sessions without a meta line or
    without a message are left out. Of calls with one id the last counts.
    """
    kind, payload = _get("$.type"), _get("$.payload.type")
    rows = lines.filter(F.col("doc").isNotNull())
    by_line = lambda pick, value, where: pick(value, F.when(where, F.col("line_no")))
    model = _get("$.payload.model")
    time = _get("$.timestamp")
    meta = rows.groupBy("file").agg(
        by_line(F.max_by, F.coalesce(_get("$.payload.id"), F.col("file")), kind == "session_meta").alias("session"), by_line(F.max_by, _get("$.payload.cwd"), kind == "session_meta").alias("project"),
        by_line(F.min_by, model, (kind == "turn_context") & (F.coalesce(model, F.lit("")) != "")).alias("model"),
        by_line(F.min_by, X.to_ts(time), time != "").alias("created_at"), by_line(F.max_by, X.to_ts(time), time != "").alias("updated_at"),
    ).filter("session is not null")
    named = rows.join(meta.select("file", "session", F.col("model").alias("of_model")), "file")
    spoken = F.when(kind == "event_msg", F.when(payload == "user_message", "user").when(payload == "agent_message", "agent").when(payload == "agent_reasoning", "reasoning"))
    events = named.select(
        "session", F.struct("line_no", F.coalesce(time, F.lit("")).alias("time"), "of_model").alias("ord"), spoken.alias("kind"), F.coalesce(_get("$.payload.message"), _get("$.payload.text"), F.lit("")).alias("text")
    ).filter("kind is not null")
    said = attach_reasoning(events)
    agent = F.col("kind") == "agent"
    messages = said.select(
        F.col("session").alias("conversation_id"), F.lit("codex").alias("source"), F.when(agent, "assistant").otherwise("user").alias("role"),
        F.col("text").alias("content"), "thinking", F.when(agent, F.col("ord.of_model")).alias("model"), X.to_ts(F.col("ord.time")).alias("created_at"),
        F.when(F.coalesce("thinking", F.lit("")) != "", "thinking,text").otherwise("text").alias("content_types"),
        F.expr("row_number() over (partition by session order by ord.time, kind = 'agent', ord.line_no)").alias("sequence"),
    )
    messages = conform(messages.withColumn("message_id", F.concat_ws("_", "conversation_id", F.col("sequence").cast("string"))), "messages")
    argument = lambda name: F.get_json_object(_get("$.payload.arguments"), f"$.{name}")
    call_id = F.nullif(_get("$.payload.call_id"), F.lit(""))
    calls = named.filter((kind == "response_item") & (payload == "function_call") & call_id.isNotNull()).groupBy("session", call_id.alias("call_id")).agg(
        F.max_by(F.struct(_get("$.payload.name").alias("tool_name"), F.nullif(argument("cmd"), F.lit("")).alias("command"), argument("file_path").alias("file_path")), "line_no").alias("c")
    ).select("session", "call_id", "c.*")
    ends = named.filter((kind == "event_msg") & (payload == "exec_command_end") & call_id.isNotNull()).select(
        "session", call_id.alias("call_id"), F.coalesce(F.try_variant_get("doc", "$.payload.duration.secs", "long"), F.lit(0)).alias("secs"),
        F.try_variant_get("doc", "$.payload.duration.nanos", "long").alias("nanos"), F.coalesce(F.try_variant_get("doc", "$.payload.exit_code", "int"), F.lit(-1)).alias("exit_code"),
        F.coalesce(_get("$.payload.command"), F.to_json(_get("$.payload.command", "variant"))).alias("command"), F.col("line_no").alias("ord"),
    )
    done = exec_ends(calls, ends).select(
        "*", F.col("call_id").alias("event_id"), F.concat_ws("_tool_", "session", "call_id").alias("message_id"), F.lit("tool_call").alias("event_type"), F.lit("codex").alias("source")
    )
    facts = meta.drop("file").withColumnRenamed("session", "conversation_id")
    known = messages.select("conversation_id").distinct()
    return _sessions(messages, facts), messages, conform(done.withColumnRenamed("session", "conversation_id").join(known, "conversation_id", "left_semi"), "tool_events")


def gemini_cli_sessions(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, tool events) from snapshot files (file_name, doc).

    Snapshots of one session are merged (U4); of calls with one id the first file's counts.
    """
    docs = documents.filter(F.col("doc").isNotNull() & (F.coalesce(_get("$.sessionId"), F.lit("")) != ""))
    rows = docs.select(_get("$.sessionId").alias("conversation_id"), "file_name", F.filter(_get("$.messages", "array<variant>"), lambda m: F.try_variant_get(m, "$.type", "string").isin("user", "gemini")).alias("ms"))
    rows = rows.select("conversation_id", "file_name", F.posexplode("ms").alias("pos", "m"))
    get = lambda p, kind="string": F.try_variant_get("m", p, kind)
    parts = F.transform(F.filter(get("$.content", "array<variant>"), lambda p: F.schema_of_variant(p).startswith("OBJECT")), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    is_list = F.schema_of_variant(get("$.content", "variant")).startswith("ARRAY")
    content = F.coalesce(F.when(is_list, F.array_join(parts, "\n\n")).otherwise(get("$.content")), F.lit(""))
    agent = get("$.type") == "gemini"
    field = lambda t, k: F.coalesce(F.try_variant_get(t, f"$.{k}", "string"), F.lit(""))
    thoughts = F.transform(F.filter(get("$.thoughts", "array<variant>"), lambda t: field(t, "description") != ""), lambda t: F.concat(F.lit("**"), field(t, "subject"), F.lit("**: "), field(t, "description")))
    calls = F.coalesce(get("$.toolCalls", "array<variant>"), F.array().cast("array<variant>"))
    said = rows.select(
        "conversation_id", F.lit("gemini_cli").alias("source"), "file_name", "pos", F.when(agent, "assistant").otherwise("user").alias("role"), content.alias("content"),
        F.coalesce(get("$.id"), F.concat_ws("_", "conversation_id", (F.col("pos") + 1).cast("string"))).alias("message_id"), X.to_ts(get("$.timestamp")).alias("created_at"),
        F.when(agent, get("$.tokens.total", "long")).alias("token_count"), F.when(agent, get("$.model")).alias("model"), F.when(agent, _joined(thoughts)).alias("thinking"), F.when(agent, calls).alias("calls"),
    )
    types = F.concat_ws(",", F.when(F.col("thinking").isNotNull(), "thinking"), F.lit("text"), F.when(F.size("calls") > 0, "tool_use"))
    messages = conform(merge_snapshots(said.withColumn("content_types", types).drop("calls"), "conversation_id", "message_id", "file_name", "pos"), "messages")
    each = said.select("conversation_id", "source", "file_name", "pos", "message_id", F.posexplode("calls").alias("at", "c"))
    of = lambda p: F.try_variant_get("c", p, "string")
    more = F.map_filter(F.try_variant_get("c", "$", "map<string,variant>"), lambda k, _: ~k.isin("id", "name", "args", "status", "timestamp"))
    events = each.select(
        "conversation_id", "source", "message_id", "file_name", "pos", "at", F.coalesce(of("$.id"), F.concat_ws("_tool_", "message_id", F.col("at").cast("string"))).alias("event_id"), F.lit("tool_call").alias("event_type"),
        F.coalesce(of("$.name"), F.lit("")).alias("tool_name"), F.coalesce(F.nullif(of("$.args.file_path"), F.lit("")), of("$.args.dir_path")).alias("file_path"), of("$.args.command").alias("command"),
        F.when(F.coalesce(of("$.status"), F.lit("")) != "", of("$.status") == "success").alias("success"), F.when(F.size(more) > 0, F.to_json(more)).alias("metadata_json"),
    )
    events = dedup_keep_first(events, ["conversation_id", "event_id"], ["file_name", "pos", "at"])
    facts = docs.groupBy(_get("$.sessionId").alias("conversation_id")).agg(F.min(X.to_ts(_get("$.startTime"))).alias("created_at"), F.max(X.to_ts(_get("$.lastUpdated"))).alias("updated_at"))
    first = messages.filter("model is not null").groupBy("conversation_id").agg(F.min_by("model", "sequence").alias("model"))
    return _sessions(messages, facts.join(first, "conversation_id", "left")), messages, conform(events, "tool_events")
