"""Report queries (R) over the canonical views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import setops
from tessera.plans import reports as R
from tessera.plans.registry import register

SOURCES = ["chatgpt", "claude_ai", "codex", "gemini"]


def _pivot(column: str, of: str, values: list[str]) -> str:
    return ", ".join(f"CAST(count(*) FILTER (WHERE {of} = '{v}') AS BIGINT) AS \"{v}\"" for v in values)


def _bins(value: str, bins, op: str) -> str:
    parts = " ".join(f"WHEN {value} {op} {end} THEN '{name}'" for name, end in bins[:-1])
    return f"CASE {parts} ELSE '{bins[-1][0]}' END"


def _places(value: str, bins, op: str) -> str:
    parts = " ".join(f"WHEN {value} {op} {end} THEN {k}" for k, (_, end) in enumerate(bins[:-1]))
    return f"CASE {parts} ELSE {len(bins) - 1} END"


register(
    "r01_row_counts",
    lambda v: R.row_counts({"conversations": v.conversations, "messages": v.messages, "tool_events": v.tool_events}),
    """SELECT 'conversations' AS table_name, count(*) AS rows FROM c UNION ALL SELECT 'messages', count(*) FROM m
       UNION ALL SELECT 'tool_events', count(*) FROM e""",
    "c", "m", "e",
)
register(
    "r02_period",
    lambda v: R.period(v.conversations),
    "SELECT min(created_at) AS first_created, max(created_at) AS last_created, max(updated_at) AS last_updated FROM c",
    "c",
)
register(
    "r03_coverage_conversations",
    lambda v: R.coverage(v.conversations, ["model", "project_id", "capture_method"], ["is_preserved_missing", "is_pinned"]),
    """SELECT count(*) AS total, count(model) AS model, count(project_id) AS project_id, count(capture_method) AS capture_method,
       CAST(sum(is_preserved_missing::INT) AS BIGINT) AS is_preserved_missing, CAST(sum(is_pinned::INT) AS BIGINT) AS is_pinned FROM c""",
    "c",
)
register(
    "r03_coverage_messages",
    lambda v: R.coverage(v.messages, ["thinking", "token_count", "model"], ["is_hidden"]),
    """SELECT count(*) AS total, count(thinking) AS thinking, count(token_count) AS token_count, count(model) AS model,
       CAST(sum(is_hidden::INT) AS BIGINT) AS is_hidden FROM m""",
    "m",
)
register(
    "r03_coverage_tool_events",
    lambda v: R.coverage(v.tool_events, ["tool_name", "duration_ms", "success", "metadata_json"]),
    """SELECT count(*) AS total, count(tool_name) AS tool_name, count(duration_ms) AS duration_ms, count(success) AS success,
       count(metadata_json) AS metadata_json FROM e""",
    "e",
)
register(
    "r04_full_coverage",
    lambda v: R.full_coverage(v.tool_events).select("column_name", "filled", "pct"),
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS filled, round(count({c}) * 100.0 / nullif(count(*), 0), 1) AS pct FROM e"
        for c in ("event_id", "conversation_id", "event_type", "tool_name", "duration_ms", "success", "source", "created_at", "metadata_json")
    ),
    "e",
)
register(
    "r05_interaction_split",
    lambda v: R.interaction_split(v.conversations),
    "SELECT count(*) AS human_ai, CAST(0 AS BIGINT) AS ai_ai, count(DISTINCT account) AS accounts FROM c",
    "c",
)
register(
    "r06_sample_conversations",
    lambda v: setops.sample_rows(
        v.conversations,
        {
            "longest": (F.lit(True), [F.desc("message_count"), F.asc("conversation_id")]),
            "no_model": (F.col("model").isNull(), [F.desc("created_at"), F.asc("conversation_id")]),
            "pinned": (F.col("is_pinned"), [F.asc("conversation_id")]),
            "preserved": (F.col("is_preserved_missing"), [F.asc("updated_at"), F.asc("conversation_id")]),
            "recent": (F.lit(True), [F.desc("created_at"), F.asc("conversation_id")]),
            "shortest": (F.col("message_count") > 0, [F.asc("message_count"), F.asc("conversation_id")]),
        },
        "conversation_id",
    ).select("conversation_id", "source", "message_count", "picks"),
    """WITH p AS (
        (SELECT *, 'longest' AS pick FROM c ORDER BY message_count DESC, conversation_id LIMIT 1) UNION ALL
        (SELECT *, 'no_model' FROM c WHERE model IS NULL ORDER BY created_at DESC, conversation_id LIMIT 1) UNION ALL
        (SELECT *, 'pinned' FROM c WHERE is_pinned ORDER BY conversation_id LIMIT 1) UNION ALL
        (SELECT *, 'preserved' FROM c WHERE is_preserved_missing ORDER BY updated_at, conversation_id LIMIT 1) UNION ALL
        (SELECT *, 'recent' FROM c ORDER BY created_at DESC, conversation_id LIMIT 1) UNION ALL
        (SELECT *, 'shortest' FROM c WHERE message_count > 0 ORDER BY message_count, conversation_id LIMIT 1))
       SELECT conversation_id, source, message_count, string_agg(pick, ',' ORDER BY pick) AS picks FROM p GROUP BY 1, 2, 3""",
    "c",
)
register(
    "r07_sample_per_event_type",
    lambda v: setops.sample_per_value(v.tool_events, "event_type", [F.asc("created_at"), F.asc("event_id")]).select(
        "event_type", "event_id", "tool_name", "duration_ms", "success"
    ),
    """SELECT event_type, event_id, tool_name, duration_ms, success FROM e
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY created_at, event_id) = 1""",
    "e",
)
register(
    "r08_capture_methods",
    lambda v: R.capture_methods(v.conversations),
    "SELECT coalesce(capture_method, 'extractor') AS method, count(*) AS n FROM c GROUP BY 1",
    "c",
)
register(
    "r08_capture_methods_by_source",
    lambda v: R.capture_methods(v.conversations, by_source=True),
    "SELECT coalesce(capture_method, 'extractor') AS method, source AS platform, count(*) AS n FROM c GROUP BY 1, 2",
    "c",
)
register(
    "r09_model_by_role",
    lambda v: R.model_by_role(v.messages),
    """SELECT role, count(*) AS total, count(model) AS with_model, count(*) - count(model) AS without_model,
       round(count(model) * 100.0 / nullif(count(*), 0), 1) AS pct FROM m GROUP BY role""",
    "m",
)
register(
    "r10_thinking_coverage",
    lambda v: R.thinking_coverage(v.messages),
    "SELECT count(*) AS total_asst, count(thinking) AS with_thinking FROM m WHERE role = 'assistant'",
    "m",
)
register(
    "r11_token_coverage",
    lambda v: R.token_coverage(v.messages),
    "SELECT count(*) AS total, count(token_count) AS with_tokens, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM m",
    "m",
)
register(
    "r11_token_coverage_cumulative",
    lambda v: R.token_coverage(v.messages, cumulative=True),
    """WITH x AS (SELECT conversation_id, count(*) AS n, count(token_count) AS k, max(token_count) AS t FROM m GROUP BY 1)
       SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(k) AS BIGINT) AS with_tokens, CAST(sum(t) AS BIGINT) AS total_tokens FROM x""",
    "m",
)
register(
    "r12_latency",
    lambda v: R.latency(
        v.conversations.select(F.lit("assistant").alias("role"), F.col("created_at").alias("start_timestamp"), F.col("updated_at").alias("stop_timestamp"))
    ),
    """SELECT count(*) AS n, round(median(epoch(updated_at - created_at)), 1) AS median_s, round(avg(epoch(updated_at - created_at)), 1) AS avg_s,
       round(max(epoch(updated_at - created_at)), 1) AS max_s FROM c WHERE updated_at IS NOT NULL AND created_at IS NOT NULL""",
    "c",
)
register(
    "r13_per_month",
    lambda v: R.per_month(v.conversations),
    """WITH x AS (SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM c WHERE created_at IS NOT NULL GROUP BY 1)
       SELECT month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS cumulative FROM x""",
    "c",
)
register(
    "r14_per_month_by_source",
    lambda v: R.per_month(v.conversations, by_source=True),
    """WITH x AS (SELECT source, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM c WHERE created_at IS NOT NULL GROUP BY 1, 2)
       SELECT source, month, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY month) AS BIGINT) AS cumulative FROM x""",
    "c",
)
register(
    "r14_month_by_source",
    lambda v: R.month_by_source(v.conversations, SOURCES),
    f"SELECT strftime(created_at, '%Y-%m') AS month, {_pivot('n', 'source', SOURCES)} FROM c WHERE created_at IS NOT NULL GROUP BY 1",
    "c",
)
register(
    "r15_activity",
    lambda v: R.activity(v.conversations),
    "SELECT CAST(d.dow AS INTEGER) AS dow, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE hour(c.created_at) = {h}) AS BIGINT) AS h{h}" for h in range(24))
    + " FROM range(1, 8) AS d(dow) LEFT JOIN c ON isodow(c.created_at) = d.dow GROUP BY 1",
    "c",
)
register(
    "r16_messages_by_role",
    lambda v: R.messages_by_role(v.messages),
    """SELECT role, count(*) AS total, count(*) FILTER (WHERE NOT is_hidden) AS visible, CAST(sum(is_hidden::INT) AS BIGINT) AS hidden,
       round(avg(word_count), 1) AS avg_words FROM m GROUP BY role""",
    "m",
)
for _by in (False, True):
    register(
        "r17_word_stats" + "_by_source" * _by,
        lambda v, by=_by: R.word_stats(v.messages, by),
        f"""SELECT {'source AS platform,' * _by} role, CAST(round(avg(word_count), 0) AS INTEGER) AS avg_words,
            CAST(median(word_count) AS INTEGER) AS median_words, max(word_count) AS max_words, CAST(sum(word_count) AS BIGINT) AS total_words
            FROM m WHERE NOT is_hidden AND word_count > 0 GROUP BY {'source,' * _by} role""",
        "m",
    )
register(
    "r18_events_by_type",
    lambda v: R.events_by_type(v.tool_events),
    "SELECT event_type, count(*) AS n, count(DISTINCT conversation_id) AS n_convs FROM e GROUP BY 1",
    "e",
)
_OUTCOMES = """count(*) FILTER (WHERE success) AS success, count(*) FILTER (WHERE success = false) AS error,
    count(*) FILTER (WHERE success IS NULL) AS unknown, count(*) AS total"""
register("r19_outcomes", lambda v: R.outcomes(v.tool_events), f"SELECT {_OUTCOMES} FROM e", "e")
register(
    "r19_outcomes_by_source",
    lambda v: R.outcomes(v.tool_events, by_source=True),
    f"SELECT source AS platform, {_OUTCOMES} FROM e GROUP BY 1 HAVING count(success) > 0",
    "e",
)
register(
    "r20_durations",
    lambda v: R.durations(v.tool_events),
    """SELECT count(duration_ms) AS n, CAST(round(avg(duration_ms)) AS INTEGER) AS avg_ms, CAST(median(duration_ms) AS INTEGER) AS median_ms,
       max(duration_ms) AS max_ms FROM e WHERE duration_ms IS NOT NULL""",
    "e",
)
register(
    "r21_top_tools",
    lambda v: R.top_tools(v.tool_events, 15),
    "SELECT tool_name, count(*) AS calls FROM e WHERE tool_name <> '' GROUP BY 1 ORDER BY calls DESC, tool_name LIMIT 15",
    "e",
)
register(
    "r21_top_tools_by_source",
    lambda v: R.top_tools(v.tool_events, 20, by_source=True),
    "SELECT tool_name, source, count(*) AS calls FROM e WHERE tool_name <> '' GROUP BY 1, 2 ORDER BY calls DESC, tool_name, source LIMIT 20",
    "e",
)
register(
    "r22_type_by_source",
    lambda v: R.type_by_source(v.tool_events, SOURCES),
    f"SELECT event_type, {_pivot('n', 'source', SOURCES)} FROM e GROUP BY 1",
    "e",
)
register(
    "r23_top_models",
    lambda v: R.top_models(v.conversations, 10),
    "SELECT model, count(*) AS n FROM c WHERE model IS NOT NULL GROUP BY 1 ORDER BY n DESC, model LIMIT 10",
    "c",
)
register(
    "r23_top_models_by_source",
    lambda v: R.top_models(v.conversations, 20, by_source=True),
    "SELECT model, source, count(*) AS n FROM c WHERE model IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, model, source LIMIT 20",
    "c",
)
register(
    "r24_models_by_source",
    lambda v: R.models_by_source(v.conversations, 3, SOURCES),
    f"""WITH t AS (SELECT model FROM c WHERE model IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, model LIMIT 3)
        SELECT model, {_pivot('n', 'source', SOURCES)} FROM c WHERE model IN (SELECT model FROM t) GROUP BY 1""",
    "c",
)
register(
    "r25_longest",
    lambda v: R.longest(v.conversations),
    """SELECT substr(conversation_id, 1, 8) AS conv_id, message_count AS msgs, model, strftime(created_at, '%Y-%m-%d') AS created
       FROM c ORDER BY message_count DESC, conversation_id LIMIT 10""",
    "c",
)
register(
    "r26_size_histogram",
    lambda v: R.size_histogram(v.conversations),
    f"""SELECT {_bins('message_count', R.SIZE_BINS, '<=')} AS bin, {_places('message_count', R.SIZE_BINS, '<=')} AS place, count(*) AS n
        FROM c GROUP BY 1, 2""",
    "c",
)
register(
    "r27_size_stats",
    lambda v: R.size_stats(v.conversations),
    """SELECT min(message_count) AS min, max(message_count) AS max, round(avg(message_count), 1) AS avg,
       CAST(median(message_count) AS INTEGER) AS median FROM c""",
    "c",
)
for _by in (False, True):
    register(
        "r28_lifetimes" + "_by_source" * _by,
        lambda v, by=_by: R.lifetimes(v.conversations, by),
        f"""WITH x AS (SELECT source, epoch(updated_at - created_at) / 86400 AS days FROM c WHERE updated_at IS NOT NULL AND created_at IS NOT NULL)
            SELECT {'source AS platform,' * _by} {_bins('days', R.LIFETIME_BINS, '<')} AS bin, {_places('days', R.LIFETIME_BINS, '<')} AS place,
            count(*) AS n FROM x GROUP BY ALL""",
        "c",
    )
register(
    "r30_accounts",
    lambda v: R.accounts(v.conversations),
    """SELECT coalesce(account, '(no account)') AS account, count(*) AS convs, CAST(sum(message_count) AS BIGINT) AS total_msgs,
       round(avg(message_count), 1) AS avg_msgs FROM c GROUP BY 1""",
    "c",
)
register(
    "r31_project_coverage",
    lambda v: R.project_coverage(v.conversations, ["project_id", "project"]),
    "SELECT count(*) AS total, count(project_id) AS project_id, count(project_id) AS with_any FROM c",
    "c",
)
_PROJECTS = """SELECT project_id, count(*) AS n_convs, min(created_at) AS first_conv, max(created_at) AS last_conv FROM c
    WHERE project_id IS NOT NULL {} GROUP BY 1 ORDER BY n_convs DESC, project_id LIMIT {}"""
register("r32_top_projects", lambda v: R.top_projects(v.conversations), _PROJECTS.format("", 20), "c")
register("r32_distinct_projects", lambda v: R.distinct_projects(v.conversations), "SELECT count(DISTINCT project_id) AS projects FROM c", "c")
register(
    "r33_preservation",
    lambda v: R.preservation(v.conversations),
    "SELECT is_preserved_missing, count(*) AS n, min(updated_at) AS first_seen, max(updated_at) AS last_seen FROM c GROUP BY 1",
    "c",
)
register(
    "r33_oldest_preserved",
    lambda v: R.oldest_preserved(v.conversations),
    "SELECT conversation_id, source, updated_at FROM c WHERE is_preserved_missing ORDER BY updated_at, conversation_id LIMIT 50",
    "c",
)
_STATES = "CAST(sum(is_pinned::INT) AS BIGINT) AS is_pinned, CAST(sum(is_preserved_missing::INT) AS BIGINT) AS is_preserved_missing"
_FLAGS = ["is_pinned", "is_preserved_missing"]
register("r34_states", lambda v: R.states(v.conversations, _FLAGS), f"SELECT count(*) AS total, {_STATES} FROM c", "c")
register(
    "r34_states_by_source",
    lambda v: R.states(v.conversations, _FLAGS, by_source=True),
    f"""SELECT source AS platform, count(*) AS total, {_STATES} FROM c GROUP BY 1
        HAVING sum(is_pinned::INT) + sum(is_preserved_missing::INT) > 0""",
    "c",
)
register(
    "r35_listing",
    lambda v: R.listing(v.conversations),
    """SELECT source, conversation_id, message_count AS msgs, model, project_id, strftime(created_at, '%Y-%m-%d') AS created,
       strftime(updated_at, '%Y-%m-%d') AS updated, is_preserved_missing AS preserved FROM c""",
    "c",
)
register(
    "r36_source_comparison",
    lambda v: R.source_comparison(v.conversations),
    """SELECT source AS platform, count(*) AS convs, CAST(sum(message_count) AS BIGINT) AS msgs_total, round(avg(message_count), 1) AS avg_msgs,
       CAST(sum(is_preserved_missing::INT) AS BIGINT) AS preserved, CAST(sum(is_pinned::INT) AS BIGINT) AS pinned,
       strftime(min(created_at), '%Y-%m-%d') AS oldest, strftime(max(created_at), '%Y-%m-%d') AS newest FROM c GROUP BY 1""",
    "c",
)
register(
    "r37_tools_by_source",
    lambda v: R.tools_by_source(v.tool_events),
    """SELECT source AS platform, count(*) AS tool_events, count(DISTINCT tool_name) AS unique_tools,
       count(*) FILTER (WHERE success) AS success, count(*) FILTER (WHERE success = false) AS error FROM e GROUP BY 1""",
    "e",
)
register(
    "r38_preserved_by_source",
    lambda v: R.preserved_by_source(v.conversations),
    """SELECT source AS platform, CAST(sum(is_preserved_missing::INT) AS BIGINT) AS preserved, count(*) AS total,
       round(sum(is_preserved_missing::INT) * 100.0 / nullif(count(*), 0), 1) AS pct FROM c GROUP BY 1 HAVING sum(is_preserved_missing::INT) > 0""",
    "c",
)
register(
    "r39_project_coverage_by_source",
    lambda v: R.project_coverage_by_source(v.conversations, {"chatgpt": "native", "claude_ai": "native", "codex": "cli"}),
    """SELECT source, count(*) AS convs, count(project_id) AS linked, round(count(project_id) * 100.0 / nullif(count(*), 0), 1) AS pct,
       CASE WHEN source IN ('chatgpt', 'claude_ai') THEN 'native' WHEN source = 'codex' THEN 'cli' ELSE 'none' END AS bucket FROM c GROUP BY source""",
    "c",
)
for _s in ("chatgpt", "claude_ai", "codex"):
    register(f"r40_top_projects_{_s}", lambda v, s=_s: R.top_projects(v.conversations, 15, source=s), _PROJECTS.format(f"AND source = '{_s}'", 15), "c")
register(
    "r40_named_projects",
    lambda v: R.named_projects(v.conversations.withColumn("project", F.concat(F.lit("name "), "project_id")), "claude_ai"),
    """SELECT project_id, 'name ' || project_id AS project, count(*) AS n_convs, min(created_at) AS first_conv, max(created_at) AS last_conv FROM c WHERE source = 'claude_ai' AND project_id IS NOT NULL GROUP BY 1""",
    "c",
)
register(
    "r41_path_fragmentation",
    lambda v: R.path_fragmentation(v.conversations, "project_id"),
    """WITH x AS (SELECT source, project_id, count(*) AS n FROM c WHERE project_id IS NOT NULL GROUP BY 1, 2)
       SELECT source, count(*) AS unique_paths, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 1) AS avg_per_path FROM x GROUP BY 1""",
    "c",
)
register(
    "r42_projects_with_metadata",
    lambda v: R.projects_with_metadata(v.conversations.filter("project_id is not null")),
    "SELECT source, count(DISTINCT project_id) AS projects FROM c WHERE project_id IS NOT NULL GROUP BY 1",
    "c",
)
register(
    "r43_project_gaps",
    lambda v: R.project_gaps(v.conversations, ["gemini"]),
    """SELECT count(*) AS total, count(*) FILTER (WHERE project_id IS NULL) AS orphans,
       count(*) FILTER (WHERE project_id IS NULL AND source = 'gemini') AS by_design,
       count(*) FILTER (WHERE project_id IS NULL AND source <> 'gemini') AS real_gap,
       round(count(*) FILTER (WHERE project_id IS NULL AND source <> 'gemini') * 100.0 / nullif(count(*), 0), 1) AS real_pct FROM c""",
    "c",
)
register(
    "r44_group_lengths",
    lambda v: R.group_lengths(v.messages, "role"),
    """SELECT role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, round(avg(length(content)), 1) AS avg_chars,
       CAST(max(length(content)) AS BIGINT) AS max_chars FROM m GROUP BY 1""",
    "m",
)
register(
    "r45_recent_rows",
    lambda v: R.recent_rows(v.conversations.select("conversation_id", "source", "model", "created_at"), ties=["conversation_id"]).drop("created_at"),
    """SELECT substr(conversation_id, 1, 80) AS conversation_id, substr(source, 1, 80) AS source, substr(model, 1, 80) AS model
       FROM (SELECT * FROM c ORDER BY created_at DESC, conversation_id LIMIT 3)""",
    "c",
)
register(
    "r46_platform_stats",
    lambda v: R.platform_stats(v.conversations),
    """SELECT source, count(*) AS total, count(*) FILTER (WHERE NOT is_preserved_missing) AS active,
       count(*) FILTER (WHERE is_preserved_missing) AS preserved, count(project_id) AS in_project, count(*) - count(project_id) AS standalone,
       count(DISTINCT project_id) AS projects, CAST(sum(message_count) AS BIGINT) AS messages, min(created_at) AS oldest, max(created_at) AS newest
       FROM c GROUP BY 1""",
    "c",
)
register(
    "r47_raw_document_stats",
    lambda v: R.raw_document_stats(v.messages),
    """SELECT source, count(DISTINCT conversation_id) AS conversations, count(*) AS message_nodes, count(DISTINCT model) AS models
       FROM m WHERE role IN ('user', 'assistant') GROUP BY 1""",
    "m",
)
register(
    "r48_project_source_stats",
    lambda v: R.project_source_stats(
        v.conversations.filter("project_id is not null").select(
            "project_id", F.col("model").alias("file_name"), F.col("message_count").alias("size"), "is_preserved_missing"
        )
    ),
    """WITH p AS (SELECT project_id, count(model) AS f, count(*) FILTER (WHERE model IS NOT NULL AND is_preserved_missing) AS g,
            coalesce(sum(message_count) FILTER (WHERE model IS NOT NULL), 0) AS b FROM c WHERE project_id IS NOT NULL GROUP BY 1)
       SELECT count(*) AS projects, count(*) FILTER (WHERE f > 0) AS with_files, count(*) FILTER (WHERE f = 0) AS empty,
       count(*) FILTER (WHERE f > 0 AND g = f) AS all_preserved, CAST(sum(f - g) AS BIGINT) AS active_files,
       CAST(sum(g) AS BIGINT) AS preserved_files, CAST(sum(b) AS BIGINT) AS bytes FROM p""",
    "c",
)
