"""Queries of functions, text operators, monitoring and windowed counts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera import streaming
from tessera.operators import text
from tessera.plans import monitor, reports
from tessera.plans.registry import register
from tessera.plans.views import Views
from tessera.sources import PRESETS

# --- S6, F ------------------------------------------------------------------------------------

register(
    "s6_preset_counts",
    lambda v: v.conversations.filter(F.col("source").isin(*PRESETS["web"])).groupBy("source", "account").agg(F.count("*").alias("n")),
    "SELECT source, account, count(*) AS n FROM c WHERE source IN ('chatgpt', 'claude_ai', 'gemini') GROUP BY 1, 2",
    "c",
)
register(
    "f04_word_count",
    lambda v: v.table("documents").select("doc_id", X.word_count(F.col("text")).alias("words")),
    "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents",
)
register(
    "f01_epoch_times",
    lambda v: v.tool_events.select("event_id", F.date_format(X.to_ts(F.col("event_id")), "yyyy-MM-dd HH:mm:ss").alias("at")),
    "SELECT event_id, strftime(make_timestamp(CAST(event_id AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM e",
    "e",
)
register(
    "f22_slugs",
    lambda v: v.table("customer").select("c_custkey", X.slug(F.col("c_name")).alias("slug")),
    "SELECT c_custkey, substr(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM customer",
)
register(
    "f23_external_addresses",
    lambda v: v.table("pages").groupBy(X.is_external(F.col("url"), ("example.com",)).alias("external")).agg(F.count("*").alias("n")),
    """WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, url FROM pages)
       SELECT url IS NOT NULL AND host <> '' AND host <> 'example.com' AND NOT ends_with(host, '.example.com') AS external, count(*) AS n FROM h GROUP BY 1""",
)
register(
    "f24_formatted",
    lambda v: v.conversations.groupBy("source").agg(F.count("project_id").alias("a"), F.count("*").alias("b")).select(
        "source", X.fmt_pct(F.col("a"), F.col("b")).alias("share"), X.fmt_bytes(F.col("b") * 1000, largest="MB").alias("size")  # as the twin, which knows no larger unit
    ),
    """SELECT source, CASE WHEN count(*) = 0 THEN '—' ELSE format('{:,}', count(project_id)) || ' (' || printf('%.1f%%', count(project_id) * 100.0 / count(*)) || ')' END AS share,
       CASE WHEN count(*) * 1000 < 1024 THEN (count(*) * 1000) || ' B' WHEN count(*) * 1000 < 1048576 THEN printf('%.1f KB', count(*) * 1000 / 1024.0)
       ELSE printf('%.1f MB', count(*) * 1000 / 1048576.0) END AS size FROM c GROUP BY 1""",
    "c",
)
register(
    "f26_outcome_of_events",
    lambda v: v.tool_events.select("event_id", X.succeeded(is_error=F.col("event_type") == "error").alias("ok")).groupBy("ok").agg(F.count("*").alias("n")),
    "SELECT event_type <> 'error' AS ok, count(*) AS n FROM e GROUP BY 1",
    "e",
)

# --- T ----------------------------------------------------------------------------------------

_HTML_URL = "(https?://[^\\s\"''<>\\\\)\\]]+)"
register(
    "t3_addresses",
    lambda v: v.table("pages").select("page_id", F.size(text.addresses(F.col("html"))).cast("long").alias("n")),
    f"""SELECT page_id, CAST(len(list_distinct(regexp_extract_all(replace(replace(html, '&amp;', '&'), '\\/', '/'), '{_HTML_URL}', 1))) AS BIGINT) AS n FROM pages""",
)
register(
    "t4_address_kinds",
    lambda v: v.table("pages").select(text.address_kind(F.col("url")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    """WITH p AS (SELECT lower(regexp_replace(url, '[?#].*$', '')) AS p FROM pages)
       SELECT CASE WHEN p LIKE '%/upload%' THEN 'upload' WHEN regexp_matches(p, '/generated|/output/') THEN 'generated'
           WHEN regexp_matches(p, '\\.(png|jpe?g|gif|webp|svg)$') THEN 'image' WHEN regexp_matches(p, '\\.(mp4|webm|mov)$') THEN 'video'
           WHEN p LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(p, '\\.(md|markdown)$') THEN 'markdown' ELSE 'other' END AS kind, count(*) AS n FROM p GROUP BY 1""",
)
register(
    "t5_versions",
    lambda v: text.artifact_counts(
        text.artifact_versions(
            v.tool_events.filter("tool_name is not null").select(
                "conversation_id", F.col("tool_name").alias("artifact_id"), F.when(F.col("event_type") == "click", "update").otherwise("create").alias("command"),
                F.col("source").alias("artifact_type"), "event_id",
            ),
            ["event_id"],
        )
    ),
    """SELECT source AS artifact_type, count(DISTINCT (conversation_id, tool_name)) AS artifacts, count(*) FILTER (WHERE event_type <> 'click') AS versions,
       count(*) FILTER (WHERE event_type = 'click') AS patches FROM e WHERE tool_name IS NOT NULL GROUP BY 1""",
    "e",
)
register(
    "t7_inventory",
    lambda v: text.inventory(v.tool_events.filter("tool_name is not null").select("conversation_id", F.col("tool_name").alias("file_id"), F.col("event_type").alias("kind")))[1],
    """WITH o AS (SELECT conversation_id, tool_name, min(event_type) AS kind FROM e WHERE tool_name IS NOT NULL GROUP BY 1, 2)
       SELECT conversation_id, kind, count(*) AS n FROM o GROUP BY 1, 2""",
    "e",
)
register(
    "t10_voice_candidates",
    lambda v: text.voice_candidates(v.messages.select("conversation_id", F.when(~F.col("is_hidden") & (F.col("role") == "user"), F.col("content")).alias("content"))),
    """WITH x AS (SELECT conversation_id, count(*) AS nodes,
            avg(CASE WHEN coalesce(trim(CASE WHEN NOT is_hidden AND role = 'user' THEN content END), '') = '' THEN 1.0 ELSE 0.0 END) AS without_text FROM m GROUP BY 1)
       SELECT * FROM x WHERE without_text >= 0.5""",
    "m",
)
register(
    "t12_note_kinds",
    lambda v: v.messages.select(text.note_kind(F.col("content")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    """SELECT CASE WHEN length(trim(content)) = 36 AND length(regexp_replace(trim(content), '[^-]', '', 'g')) = 4 THEN NULL
           WHEN regexp_matches(trim(content), '(?i)^(#\\s*)?(briefing|brief|study guide|timeline|faq)\\b') THEN 'brief' ELSE 'note' END AS kind, count(*) AS n FROM m GROUP BY 1""",
    "m",
)

# --- M: a day of a source's events stands in for a run of a platform ------------------------------


def _runs(v: Views) -> DataFrame:
    user = F.col("conversation_id").cast("long")
    return v.tool_events.groupBy(F.col("source").alias("platform"), (user % 3).cast("string").alias("account"), F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("started_at")).agg(
        F.count("*").alias("discovery_total"), F.lit(None).cast("string").alias("mode")
    )


_RUNS = """runs AS (SELECT source AS platform, CAST(CAST(conversation_id AS BIGINT) % 3 AS VARCHAR) AS account, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS started_at,
    count(*) AS discovery_total FROM e GROUP BY 1, 2, 3)"""
register(
    "m3_latest_runs",
    lambda v: monitor.latest_runs(v.tool_events.groupBy(F.col("source").alias("platform"), F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("started_at")).agg(F.count("*").alias("discovery_total")), F.lit("2024-02-15").cast("timestamp_ntz")),
    """WITH d AS (SELECT source AS platform, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS t, count(*) AS n FROM e GROUP BY 1, 2),
            l AS (SELECT platform, max(t) AS latest, arg_max(n, t) AS discovery_total FROM d GROUP BY 1)
       SELECT *, CASE WHEN epoch(TIMESTAMP '2024-02-15' - latest) / 86400 < 7 THEN 'green' WHEN epoch(TIMESTAMP '2024-02-15' - latest) / 86400 < 30 THEN 'yellow' ELSE 'red' END AS freshness FROM l""",
    "e",
)
register(
    "m4_drop_flags",
    lambda v: monitor.drop_flags(_runs(v)),
    f"""WITH {_RUNS}, a AS (SELECT platform, account, count(*) AS runs, max(discovery_total) AS largest, arg_max(discovery_total, started_at) AS latest FROM runs GROUP BY 1, 2)
        SELECT platform, bool_or(runs >= 2 AND latest < largest * 0.8) AS dropped, CAST(sum(runs) AS BIGINT) AS runs FROM a GROUP BY 1""",
    "e",
)
register(
    "m6_discovery_series",
    lambda v: monitor.discovery_series(_runs(v)),
    f"WITH {_RUNS} SELECT platform, started_at, discovery_total FROM runs",
    "e",
)
register(
    "m7_named_top",
    lambda v: monitor.named_top(v.conversations, "project_id", v.conversations.select("project_id", F.col("model").alias("name")).filter("name is not null")),
    """WITH t AS (SELECT project_id, count(*) AS n FROM c WHERE project_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, project_id LIMIT 15),
            k AS (SELECT project_id, min(model) AS name FROM c WHERE model IS NOT NULL GROUP BY 1)
       SELECT t.project_id, t.n, coalesce(k.name, t.project_id) AS name FROM t LEFT JOIN k ON k.project_id = t.project_id""",
    "c",
)
register(
    "m8_stale",
    lambda v: monitor.stale(
        v.conversations.filter("is_pinned").select(F.col("source").alias("name"), F.col("created_at").alias("rendered_at")),
        v.conversations.select(F.col("source").alias("name"), F.col("created_at").alias("modified")),
    ),
    """SELECT source AS name, max(created_at) AS newest_input, max(created_at) FILTER (WHERE is_pinned) AS rendered_at,
       max(created_at) FILTER (WHERE is_pinned) IS NULL OR max(created_at) > max(created_at) FILTER (WHERE is_pinned) AS stale FROM c GROUP BY 1""",
    "c",
)
register(
    "m10_roster",
    lambda v: monitor.roster(
        v.conversations.filter("is_pinned").select(F.col("source").alias("platform")).distinct(), v.tool_events.select(F.col("event_type").alias("platform")).distinct()
    ),
    "SELECT DISTINCT source AS platform, true AS known FROM c WHERE is_pinned UNION ALL SELECT DISTINCT event_type, false FROM e WHERE event_type NOT IN (SELECT source FROM c WHERE is_pinned)",
    "c", "e",
)

# --- ST6 as a batch: the form that the stream has to reach -------------------------------------

register(
    "st6_tumbling_counts",
    lambda v: streaming.windowed_counts(v.tool_events.withColumn("created_at", F.col("created_at").cast("timestamp")), "created_at", F.col("event_type"), "1 day").select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "key", "n"
    ),
    "SELECT strftime(created_at, '%Y-%m-%d') AS day, event_type AS key, count(*) AS n FROM e GROUP BY 1, 2",
    "e",
)
register(
    "st6_activity_sessions",
    lambda v: streaming.activity_sessions(v.tool_events.withColumn("created_at", F.col("created_at").cast("timestamp")), "created_at", "conversation_id", "12 hours")
    .groupBy("conversation_id")
    .agg(F.count("*").alias("sessions"), F.sum("n").alias("events")),
    """WITH g AS (SELECT conversation_id, CASE WHEN created_at >= lag(created_at) OVER (PARTITION BY conversation_id ORDER BY created_at) + INTERVAL 12 HOUR
            OR lag(created_at) OVER (PARTITION BY conversation_id ORDER BY created_at) IS NULL THEN 1 ELSE 0 END AS opens FROM e)
       SELECT conversation_id, CAST(sum(opens) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1""",
    "e",
)
register("r01_events_per_month", lambda v: v.tool_events.groupBy(reports.month().alias("month")).agg(F.count("*").alias("n")),
    "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM e GROUP BY 1", "e")
