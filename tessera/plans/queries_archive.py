"""Queries of the archive operators (U, P, G, E) over the canonical views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import enrich, graph, reconcile, setops
from tessera.plans import reports
from tessera.plans.registry import register
from tessera.plans.views import Views

# --- U: unions and dedup -----------------------------------------------------------------------

register(
    "u1_union_by_name",
    lambda v: setops.union_by_name(
        [v.conversations.filter("source = 'chatgpt'").drop("capture_method"), v.conversations.filter("source = 'codex'").drop("is_pinned")]
    )
    .groupBy("source")
    .agg(F.count("*").alias("n"), F.count("capture_method").alias("methods"), F.count("is_pinned").alias("pins")),
    """SELECT source, count(*) AS n, count(CASE WHEN source = 'codex' THEN capture_method END) AS methods,
       count(CASE WHEN source = 'chatgpt' THEN is_pinned END) AS pins FROM c WHERE source IN ('chatgpt', 'codex') GROUP BY 1""",
    "c",
)
_LINE = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
register(
    "u2_dedup_keep_last",
    lambda v: setops.dedup_keep_last(v.table("lineitem"), _LINE, _LINE_ORDER).select(*_LINE, "l_partkey", "l_suppkey", "l_quantity"),
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (
       PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""",
)
register(
    "u2_duplicates",
    lambda v: setops.duplicates(v.table("lineitem"), _LINE),
    "WITH x AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM x",
)
register(
    "u3_dedup_keep_first",
    lambda v: setops.dedup_keep_first(v.tool_events, ["tool_name", "conversation_id"], ["created_at", "event_id"]).select("event_id", "tool_name", "conversation_id"),
    """SELECT event_id, tool_name, conversation_id FROM e WHERE tool_name IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY tool_name, conversation_id ORDER BY created_at, event_id) = 1
       UNION ALL SELECT event_id, tool_name, conversation_id FROM e WHERE tool_name IS NULL""",
    "e",
)
register(
    "u4_merge_snapshots",
    lambda v: setops.merge_snapshots(
        v.tool_events.select("conversation_id", "tool_name", F.col("source").alias("file"), F.col("created_at").alias("pos")).filter("tool_name is not null"),
        "conversation_id", "tool_name", "file", "pos",
    ),
    """WITH k AS (SELECT conversation_id, tool_name, source AS file, created_at AS pos FROM e WHERE tool_name IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY conversation_id, tool_name ORDER BY source, created_at) = 1)
       SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY file, pos, tool_name) AS sequence FROM k""",
    "e",
)
register(
    "u5_insert_if_absent",
    lambda v: setops.insert_if_absent(
        [
            v.conversations.filter("source = 'chatgpt'").groupBy("project_id").agg(F.max("model").alias("model")),
            v.conversations.filter("source <> 'chatgpt'").groupBy("project_id").agg(F.max("model").alias("model")),
        ],
        "project_id",
    ),
    """WITH a AS (SELECT project_id, max(model) AS model FROM c WHERE source = 'chatgpt' GROUP BY 1),
            b AS (SELECT project_id, max(model) AS model FROM c WHERE source <> 'chatgpt' GROUP BY 1)
       SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.project_id IS NOT DISTINCT FROM b.project_id)""",
    "c",
)
register(
    "u6_set_difference",
    lambda v: setops.only_in(v.table("customer").select(F.col("c_custkey").alias("k")), v.table("supplier").select(F.col("s_suppkey").alias("k")), ["k"]),
    "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
register(
    "u6_set_intersection",
    lambda v: setops.also_in(v.table("customer").select(F.col("c_custkey").alias("k")), v.table("orders").select(F.col("o_custkey").alias("k")), ["k"]),
    "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)

# --- P: snapshots ------------------------------------------------------------------------------
# The archive lacks every tenth order, the snapshot every seventh; every fifth was updated an hour later.


def _archive(v: Views) -> DataFrame:
    rows = v.conversations.select("conversation_id", "updated_at", F.col("model").alias("title"), "source", F.col("is_pinned").alias("pinned"))
    stamp = F.when(F.col("conversation_id").cast("long") % 11 == 0, "2024-01-01").otherwise("2024-02-01")
    return rows.filter("cast(conversation_id as long) % 10 <> 0").withColumn(reconcile.SEEN, stamp)


def _snapshot(v: Views) -> DataFrame:
    number = F.col("conversation_id").cast("long")
    rows = v.conversations.select("conversation_id", "updated_at", F.col("model").alias("title"), "source", F.col("is_pinned").alias("pinned"))
    rows = rows.filter(number % 7 != 0)
    return rows.withColumn("updated_at", F.when(number % 5 == 0, F.expr("updated_at + interval 1 hour")).otherwise(F.col("updated_at"))).withColumn(
        "title", F.when(number % 13 == 0, "renamed").otherwise(F.col("title"))
    )


_RULE = reconcile.either(reconcile.later("updated_at"), reconcile.differs("title"))
_SNAPSHOTS = """o AS (SELECT conversation_id, updated_at, model AS title, source, is_pinned AS pinned,
        CASE WHEN CAST(conversation_id AS BIGINT) % 11 = 0 THEN '2024-01-01' ELSE '2024-02-01' END AS seen
        FROM c WHERE CAST(conversation_id AS BIGINT) % 10 <> 0),
    n AS (SELECT conversation_id, CASE WHEN CAST(conversation_id AS BIGINT) % 5 = 0 THEN updated_at + INTERVAL 1 HOUR ELSE updated_at END AS updated_at,
        CASE WHEN CAST(conversation_id AS BIGINT) % 13 = 0 THEN 'renamed' ELSE model END AS title, source, is_pinned AS pinned
        FROM c WHERE CAST(conversation_id AS BIGINT) % 7 <> 0),
    j AS (SELECT coalesce(n.conversation_id, o.conversation_id) AS conversation_id, n.conversation_id IS NOT NULL AS here, o.conversation_id IS NOT NULL AS kept,
        CASE WHEN n.conversation_id IS NULL THEN 'preserved_missing' WHEN o.conversation_id IS NULL OR n.updated_at > o.updated_at
            OR n.title IS DISTINCT FROM o.title THEN 'to_use' ELSE 'to_copy' END AS action,
        n.updated_at AS nu, o.updated_at AS ou, n.title AS nt, o.title AS ot, o.seen FROM n FULL JOIN o ON n.conversation_id = o.conversation_id)"""
register(
    "p1_build_plan",
    lambda v: reconcile.build_plan(_snapshot(v), _archive(v), ["conversation_id"], _RULE),
    f"WITH {_SNAPSHOTS} SELECT conversation_id, action, NOT kept AS is_new FROM j",
    "c",
)
register(
    "p4_reconcile",
    lambda v: reconcile.reconcile(_snapshot(v), _archive(v), ["conversation_id"], _RULE, "2024-03-01").select(
        "conversation_id", "updated_at", "title", F.col(reconcile.SEEN).alias("seen"), F.col(reconcile.GONE).alias("gone"), "action"
    ),
    f"""WITH {_SNAPSHOTS} SELECT conversation_id, CASE WHEN action = 'to_use' THEN nu ELSE ou END AS updated_at,
        CASE WHEN action = 'to_use' THEN nt ELSE ot END AS title, CASE WHEN here THEN '2024-03-01' ELSE seen END AS seen, NOT here AS gone, action FROM j""",
    "c",
)
register(
    "p3_reconcile_all",
    lambda v: reconcile.report(reconcile.reconcile(_snapshot(v), _archive(v), ["conversation_id"], _RULE, "2024-03-01", force_all=True)),
    f"""WITH {_SNAPSHOTS} SELECT count(*) FILTER (WHERE here AND NOT kept) AS added, count(*) FILTER (WHERE here AND kept) AS updated,
        CAST(0 AS BIGINT) AS copied, count(*) FILTER (WHERE NOT here) AS preserved, count(*) AS total FROM j""",
    "c",
)
register(
    "p19_report",
    lambda v: reconcile.report(reconcile.reconcile(_snapshot(v), _archive(v), ["conversation_id"], _RULE, "2024-03-01")),
    f"""WITH {_SNAPSHOTS} SELECT count(*) FILTER (WHERE action = 'to_use' AND NOT kept) AS added, count(*) FILTER (WHERE action = 'to_use' AND kept) AS updated,
        count(*) FILTER (WHERE action = 'to_copy') AS copied, count(*) FILTER (WHERE action = 'preserved_missing') AS preserved, count(*) AS total FROM j""",
    "c",
)
for _name, _strict, _op in (("p6_not_latest", True, "<>"), ("p7_before_latest", False, "<")):
    register(
        _name,
        lambda v, strict=_strict: reconcile.preserved_if_not_latest(
            v.conversations.select("conversation_id", F.date_format("updated_at", "yyyy-MM").alias("last_seen")), strict=strict
        ),
        f"""WITH x AS (SELECT conversation_id, strftime(updated_at, '%Y-%m') AS last_seen FROM c)
            SELECT *, coalesce(last_seen {_op} (SELECT max(last_seen) FROM x), false) AS is_preserved_missing FROM x""",
        "c",
    )
register(
    "p8_flag_only",
    lambda v: v.conversations.groupBy("source").agg(F.count_if("is_preserved_missing").alias("preserved")),
    "SELECT source, count(*) FILTER (WHERE is_preserved_missing) AS preserved FROM c GROUP BY 1",
    "c",
)
register(
    "p9_preserved_files",
    lambda v: reconcile.preserved_files(
        v.conversations.select(
            F.col("account").alias("parent_session_id"), F.col("project_id").alias("conversation_id"), F.col("conversation_id").alias("file")
        ).filter("conversation_id is not null"),
        v.conversations.filter("cast(conversation_id as long) % 100 = 1").select(F.col("conversation_id").alias("file")),
    ),
    """SELECT project_id AS conversation_id, NOT bool_or(CAST(conversation_id AS BIGINT) % 100 = 1) AS is_preserved_missing FROM c
       WHERE project_id IS NOT NULL GROUP BY 1""",
    "c",
)
register(
    "p11_cumulative_index",
    lambda v: reconcile.cumulative_index(_snapshot(v).select("conversation_id", "title"), _archive(v).select("conversation_id", "title"), ["conversation_id"], "gone"),
    f"WITH {_SNAPSHOTS} SELECT conversation_id, CASE WHEN here THEN nt ELSE ot END AS title, NOT here AS gone FROM j",
    "c",
)
register(
    "p12_membership",
    lambda v: reconcile.membership(
        *[
            v.conversations.filter(f"project_id is not null and cast(conversation_id as long) % {k} <> 0").select("project_id", "conversation_id")
            for k in (7, 9)
        ],
        v.conversations.filter("cast(conversation_id as long) % 4 <> 1").select("conversation_id"),
        "project_id", "conversation_id",
    ),
    """SELECT project_id, conversation_id, k % 4 = 1 AS orphan, k % 7 = 0 AND k % 4 <> 1 AS removed_from_group,
       k % 7 = 0 AND k % 4 = 1 AS preserved_from_previous FROM (SELECT *, CAST(conversation_id AS BIGINT) AS k FROM c)
       WHERE project_id IS NOT NULL AND (k % 7 <> 0 OR k % 9 <> 0)""",
    "c",
)
register(
    "p13_merge_files",
    lambda v: reconcile.merge_files(
        v.conversations.filter("project_id is not null and cast(conversation_id as long) % 7 <> 0").select("project_id", F.col("conversation_id").alias("file_id")),
        v.conversations.filter("project_id is not null").select(
            "project_id", F.col("conversation_id").alias("file_id"), F.when(F.col("is_preserved_missing"), "2024-01-01").alias("preserved_since")
        ),
        "2024-03-01",
    ),
    """SELECT project_id, conversation_id AS file_id, CASE WHEN CAST(conversation_id AS BIGINT) % 7 = 0 THEN
           CASE WHEN is_preserved_missing THEN '2024-01-01' ELSE '2024-03-01' END END AS preserved_since,
       CAST(conversation_id AS BIGINT) % 7 = 0 AND NOT is_preserved_missing AS newly_preserved FROM c WHERE project_id IS NOT NULL""",
    "c",
)
register(
    "p15_capture_drop",
    lambda v: reconcile.capture_drop(
        v.conversations.groupBy(reports.month().alias("month")).agg(F.count("*").alias("discovery_total")), 100
    ),
    """WITH x AS (SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM c GROUP BY 1)
       SELECT max(n) AS largest, (max(n) - 100) / max(n) > 0.2 AS dropped FROM x""",
    "c",
)
register(
    "p16_incremental_targets",
    lambda v: reconcile.incremental_targets(
        _snapshot(v).select(F.col("conversation_id").alias("id"), "title", F.col("updated_at").alias("update_time")),
        _archive(v).select(F.col("conversation_id").alias("id"), "title"),
        F.lit("1998-07-01").cast("timestamp_ntz"),
    ),
    f"""WITH {_SNAPSHOTS} SELECT conversation_id AS id FROM j WHERE here AND (NOT kept OR nu > TIMESTAMP '1998-07-01' OR nt IS DISTINCT FROM ot)""",
    "c",
)
register(
    "p17_tagged_targets",
    lambda v: reconcile.tagged_targets(
        _snapshot(v).select(F.col("conversation_id").alias("id"), "title"), _archive(v).select(F.col("conversation_id").alias("id"), "title", F.col("source").alias("body")), "title"
    ),
    f"WITH {_SNAPSHOTS} SELECT conversation_id AS id FROM j WHERE here AND (nt IS DISTINCT FROM ot OR NOT kept)",
    "c",
)
register(
    "p20_discovered",
    lambda v: reconcile.discovered(
        [
            (v.conversations.filter("source = 'chatgpt'").select(F.col("project_id").alias("id"), F.lit("t").alias("title")).distinct(), "main"),
            (v.conversations.filter("is_pinned").select(F.col("project_id").alias("id"), F.lit("t").alias("title")).distinct(), "archived"),
        ]
    ).filter("id is not null"),
    """SELECT project_id AS id, 't' AS title, CASE WHEN bool_or(is_pinned) THEN 'archived' ELSE 'main' END AS listing FROM c
       WHERE (source = 'chatgpt' OR is_pinned) AND project_id IS NOT NULL GROUP BY 1""",
    "c",
)
register(
    "p22_groups_of_members",
    lambda v: reconcile.groups_of_members(
        v.conversations.filter("project_id is not null").select(F.col("project_id").alias("group_id"), F.col("model").alias("id")),
        v.conversations.select(F.col("model").alias("id")).filter("id is not null").distinct(),
        v.conversations.filter("is_pinned").select(F.col("model").alias("id")),
    ).select("id", F.array_join("groups", ",").alias("groups"), "is_pinned"),
    """SELECT model AS id, coalesce(string_agg(DISTINCT project_id, ',' ORDER BY project_id), '') AS groups, coalesce(bool_or(is_pinned), false) AS is_pinned
       FROM c WHERE model IS NOT NULL GROUP BY 1""",
    "c",
)
register(
    "p23_truncated",
    lambda v: v.messages.groupBy("conversation_id")
    .agg(F.max("sequence").alias("declared"), F.count_if("is_hidden").alias("present"))
    .withColumn("truncated", reconcile.is_truncated(F.col("declared"), F.col("present"))),
    """SELECT conversation_id, max(sequence) AS declared, count(*) FILTER (WHERE is_hidden) AS present,
       max(sequence) > 5 AND count(*) FILTER (WHERE is_hidden) <= 1 AS truncated FROM m GROUP BY 1""",
    "m",
)
register(
    "p25_accumulate_children",
    lambda v: reconcile.accumulate_children(
        v.tool_events.select("event_id", "conversation_id"),
        v.tool_events.filter("event_type = 'click'").select("event_id", "conversation_id"),
        v.tool_events.filter("event_type = 'error'").select("conversation_id"),
        "conversation_id", ["event_id"],
    ),
    """SELECT event_id, conversation_id FROM e WHERE event_type = 'click'
       OR conversation_id IN (SELECT conversation_id FROM e WHERE event_type = 'error')""",
    "e",
)

# --- G: branches -------------------------------------------------------------------------------


def _nodes(v: Views) -> DataFrame:
    return v.messages.select("conversation_id", F.col("message_id").alias("node"), F.col("parent_id").alias("parent"), F.col("sequence").alias("ord"))


def _current(v: Views) -> DataFrame:
    return v.messages.groupBy("conversation_id").agg(F.max_by("message_id", "sequence").alias("current_node"))


_BRANCHES = """k AS (SELECT conversation_id, parent_id AS node, count(*) AS n FROM m WHERE parent_id IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT m.conversation_id, m.message_id AS node, m.parent_id, m.message_id AS head, 0 AS depth FROM m WHERE m.parent_id IS NULL
        UNION ALL SELECT m.conversation_id, m.message_id, m.parent_id, CASE WHEN k.n > 1 THEN m.message_id ELSE t.head END,
            CASE WHEN k.n > 1 THEN 0 ELSE t.depth + 1 END
        FROM t JOIN m ON m.conversation_id = t.conversation_id AND m.parent_id = t.node JOIN k ON k.conversation_id = m.conversation_id AND k.node = m.parent_id),
    h AS (SELECT conversation_id, node, parent_id, depth, head,
        CASE WHEN head = conversation_id || '_0' THEN conversation_id || '_main' ELSE conversation_id || '_' || head END AS branch_id FROM t),
    cur AS (SELECT conversation_id, arg_max(message_id, sequence) AS node FROM m GROUP BY 1),
    b AS (SELECT h.conversation_id, h.branch_id, arg_min(h.node, h.depth) AS root_message_id, arg_max(h.node, h.depth) AS leaf_message_id,
        arg_min(coalesce(h.parent_id, ''), h.depth) AS fork, count(*) AS n_messages, bool_or(h.node = cur.node) AS is_active
        FROM h JOIN cur ON cur.conversation_id = h.conversation_id GROUP BY 1, 2)"""
register(
    "g1_branch_forks",
    lambda v: graph.branch_forks(_nodes(v), _current(v)),
    f"""WITH RECURSIVE {_BRANCHES} SELECT b.conversation_id, b.branch_id, b.root_message_id, b.leaf_message_id, b.is_active,
        p.branch_id AS parent_branch_id, b.n_messages FROM b LEFT JOIN h AS p ON p.conversation_id = b.conversation_id AND p.node = b.fork""",
    "m",
)
register(
    "r29_branch_histogram",
    lambda v: reports.branch_histogram(graph.branch_forks(_nodes(v), _current(v))),
    f"""WITH RECURSIVE {_BRANCHES}, x AS (SELECT conversation_id, count(*) AS branches_per_conv FROM b GROUP BY 1)
        SELECT branches_per_conv, count(*) AS n_convs FROM x GROUP BY 1""",
    "m",
)
register(
    "r03_coverage_branches",
    lambda v: reports.coverage(
        graph.branch_forks(_nodes(v), _current(v)).withColumn("is_main", F.col("parent_branch_id").isNull()), ["parent_branch_id"], ["is_active", "is_main"]
    ),
    f"""WITH RECURSIVE {_BRANCHES} SELECT count(*) AS total, count(nullif(fork, '')) AS parent_branch_id, CAST(sum(is_active::INT) AS BIGINT) AS is_active,
        CAST(sum((fork = '')::INT) AS BIGINT) AS is_main FROM b""",
    "m",
)
register(
    "g2_leaf_traced",
    lambda v: graph.leaf_traced(_nodes(v), _current(v)),
    """WITH RECURSIVE n AS (SELECT conversation_id AS c, message_id AS node, parent_id AS parent, sequence AS ord FROM m),
        leaf AS (SELECT c, arg_max(node, ord) AS node FROM n GROUP BY 1),
        spine AS (SELECT n.* FROM n JOIN leaf ON leaf.c = n.c AND leaf.node = n.node UNION ALL SELECT n.* FROM spine JOIN n ON n.c = spine.c AND n.node = spine.parent),
        rest AS (SELECT n.*, n.parent IN (SELECT node FROM spine) AS hung FROM n WHERE n.node NOT IN (SELECT node FROM spine)),
        below AS (SELECT c, node AS top, node, ord, hung FROM rest WHERE hung OR parent IS NULL
            UNION ALL SELECT r.c, below.top, r.node, r.ord, below.hung FROM below JOIN rest AS r ON r.c = below.c AND r.parent = below.node),
        child AS (SELECT c, parent, arg_max(node, ord) AS node FROM n WHERE parent IS NOT NULL GROUP BY 1, 2),
        walk AS (SELECT c, top, top AS node FROM (SELECT DISTINCT c, top FROM below) UNION ALL SELECT walk.c, walk.top, child.node FROM walk JOIN child ON child.c = walk.c AND child.parent = walk.node),
        ends AS (SELECT walk.c, walk.top, walk.node FROM walk LEFT JOIN child ON child.c = walk.c AND child.parent = walk.node WHERE child.node IS NULL)
       SELECT s.c AS conversation_id, s.c || '_main' AS branch_id, arg_min(s.node, s.ord) AS root_message_id, arg_max(s.node, s.ord) AS leaf_message_id, true AS is_active,
           CAST(NULL AS VARCHAR) AS parent_branch_id, count(*) AS n_messages FROM spine AS s GROUP BY 1
       UNION ALL SELECT b.c, b.c || '_' || arg_min(b.node, b.ord), b.top, e.node, false, CASE WHEN b.hung THEN b.c || '_main' END, count(*)
           FROM below AS b JOIN ends AS e ON e.c = b.c AND e.top = b.top GROUP BY b.c, b.top, e.node, b.hung""",
    "m",
)
register(
    "g3_single_branches",
    lambda v: graph.single_branches(v.messages.select("conversation_id").distinct(), v.messages, ["sequence"]),
    """SELECT conversation_id, conversation_id || '_main' AS branch_id, arg_min(message_id, sequence) AS root_message_id,
       arg_max(message_id, sequence) AS leaf_message_id, true AS is_active, CAST(NULL AS VARCHAR) AS parent_branch_id FROM m GROUP BY 1""",
    "m",
)
register(
    "g4_chain_roots",
    lambda v: graph.chain_roots(
        v.messages.select(F.col("message_id").alias("file"), F.col("parent_id").alias("previous"))
    ).select("file", "root", "in_cycle"),
    "SELECT message_id AS file, conversation_id || '_0' AS root, false AS in_cycle FROM m",
    "m",
)

# --- E: enrichment -----------------------------------------------------------------------------


def _calls(v: Views) -> tuple[DataFrame, DataFrame]:
    event = F.col("event_id").cast("long")
    rows = v.tool_events.select(F.col("conversation_id").alias("session"), (event % 100).cast("string").alias("call_id"), "event_id", "event_type", event.alias("ord"))
    calls = rows.filter("event_type = 'click'").select("session", "call_id", "event_id", "ord")
    ends = rows.filter("event_type <> 'click'").select(
        "session", "call_id", "ord", (F.col("event_type") == "error").alias("is_error"), F.col("event_id").alias("content")
    )
    return calls, ends


_CALLS = """a AS (SELECT conversation_id AS session, CAST(CAST(event_id AS BIGINT) % 100 AS VARCHAR) AS call_id, event_id, CAST(event_id AS BIGINT) AS ord, event_type FROM e),
    z AS (SELECT session, call_id, arg_max(event_type, ord) AS kind, arg_max(event_id, ord) AS result FROM a WHERE event_type <> 'click' GROUP BY 1, 2)"""
register(
    "e1_tool_results",
    lambda v: enrich.tool_results(*_calls(v)),
    f"""WITH {_CALLS} SELECT a.session, a.call_id, a.event_id, a.ord, z.result, z.kind <> 'error' AS success
        FROM a LEFT JOIN z ON z.session = a.session AND z.call_id = a.call_id WHERE a.event_type = 'click'""",
    "e",
)
register(
    "e2_exec_ends",
    lambda v: enrich.exec_ends(
        _calls(v)[0].withColumn("command", F.when(F.col("ord") % 2 == 0, "own")),
        _calls(v)[1].select(
            "session", "call_id", "ord", (F.col("ord") % 9).alias("secs"), (F.col("ord") * 1_000_003 % 1_000_000_000).alias("nanos"),
            F.col("is_error").cast("int").alias("exit_code"), F.col("content").alias("command"),
        ),
    ),
    f"""WITH {_CALLS}, y AS (SELECT session, call_id, max(ord) AS o FROM a WHERE event_type <> 'click' GROUP BY 1, 2)
        SELECT a.session, a.call_id, a.event_id, a.ord, coalesce(CASE WHEN a.ord % 2 = 0 THEN 'own' END, z.result) AS command,
        CAST((y.o % 9) * 1000 + (y.o * 1000003 % 1000000000) // 1000000 AS BIGINT) AS duration_ms, z.kind <> 'error' AS success
        FROM a LEFT JOIN z ON z.session = a.session AND z.call_id = a.call_id LEFT JOIN y ON y.session = a.session AND y.call_id = a.call_id
        WHERE a.event_type = 'click'""",
    "e",
)
register(
    "e4_numbered_events",
    lambda v: enrich.numbered_events(v.tool_events.drop("event_id").withColumn("n", F.col("metadata_json")), ["created_at", "event_type", "n", "duration_ms"]).select(
        "conversation_id", "created_at", "event_no", "event_id"
    ),
    """WITH x AS (SELECT conversation_id, created_at, row_number() OVER (PARTITION BY conversation_id
            ORDER BY created_at, event_type, metadata_json, duration_ms NULLS FIRST) - 1 AS event_no FROM e)
       SELECT *, conversation_id || '_evt_' || event_no AS event_id FROM x""",
    "e",
)
register(
    "e8_last_models",
    lambda v: enrich.conversation_models(v.messages),
    "SELECT conversation_id, arg_max(model, sequence) AS model FROM m WHERE role = 'assistant' AND model IS NOT NULL GROUP BY 1",
    "m",
)
register(
    "e8_greatest_models",
    lambda v: enrich.conversation_models(v.conversations.select(F.col("source").alias("conversation_id"), "model", F.lit(1).alias("sequence")), "greatest"),
    "SELECT source AS conversation_id, max(model) AS model FROM c WHERE model IS NOT NULL GROUP BY 1",
    "c",
)
register(
    "e9_prompt_only_sessions",
    lambda v: enrich.prompt_only_sessions(
        v.tool_events.select(F.col("conversation_id").alias("session_id"), F.col("created_at").alias("ts"), F.col("event_id").alias("text")),
        v.tool_events.filter("cast(event_id as long) % 97 = 0").select(F.col("conversation_id").alias("session_id")),
    ),
    """SELECT conversation_id AS session_id, count(*) AS message_count, min(created_at) AS created_at, max(created_at) AS updated_at,
       (arg_min(event_id, (created_at, event_id))) AS first_prompt FROM e
       WHERE conversation_id NOT IN (SELECT conversation_id FROM e WHERE CAST(event_id AS BIGINT) % 97 = 0) GROUP BY 1""",
    "e",
)
register(
    "e10_with_group",
    lambda v: enrich.with_group(
        v.conversations.select("conversation_id", "project_id"),
        v.conversations.filter("project_id is not null").groupBy("project_id").agg(F.min("model").alias("label")), "project_id", ["label"],
    ),
    """WITH g AS (SELECT project_id, min(model) AS label FROM c WHERE project_id IS NOT NULL GROUP BY 1)
       SELECT c.conversation_id, c.project_id, g.label FROM c LEFT JOIN g ON g.project_id = c.project_id""",
    "c",
)
_NORM = "substr(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), 1, 80)"
register(
    "e11_prefix_join",
    lambda v: enrich.match_status(
        enrich.prefix_join(
            v.messages.filter("role = 'user'").select("conversation_id", F.col("sequence").alias("ord"), F.col("content").alias("text")),
            v.messages.filter("role = 'user' and sequence % 2 = 1").select(F.concat(F.substring("content", 1, 45), F.lit(" tail")).alias("text"), F.col("sequence").alias("ts")),
        )
    ),
    f"""WITH a AS (SELECT {_NORM.format("substr(content, 1, 45) || ' tail'")} AS n, sequence AS ts FROM m WHERE role = 'user' AND sequence % 2 = 1),
        p AS (SELECT conversation_id, {_NORM.format("content")} AS n FROM m WHERE role = 'user'),
        k AS (SELECT 60 AS w, substr(n, 1, 60) AS x FROM a WHERE n <> '' UNION SELECT 40, substr(n, 1, 40) FROM a WHERE n <> '' UNION SELECT 25, substr(n, 1, 25) FROM a WHERE n <> ''),
        q AS (SELECT conversation_id, n <> '' AND (substr(n, 1, 60) IN (SELECT x FROM k WHERE w = 60) OR substr(n, 1, 40) IN (SELECT x FROM k WHERE w = 40)
            OR substr(n, 1, 25) IN (SELECT x FROM k WHERE w = 25)) AS hit FROM p)
        SELECT conversation_id, count(*) AS prompts, count(*) FILTER (WHERE hit) AS matched,
        CASE WHEN count(*) = count(*) FILTER (WHERE hit) THEN 'FULL' WHEN count(*) FILTER (WHERE hit) > 0 THEN 'PARTIAL' ELSE 'NONE' END AS status FROM q GROUP BY 1""",
    "m",
)
register(
    "e12_fill_times",
    lambda v: enrich.fill_times(
        v.messages.select("conversation_id", F.col("sequence").alias("ord"), F.when(F.col("sequence") % 3 == 2, F.col("sequence") * 10).alias("ts"))
    ),
    """WITH x AS (SELECT conversation_id, sequence AS ord, CASE WHEN sequence % 3 = 2 THEN sequence * 10 END AS ts, count(*) OVER (PARTITION BY conversation_id) AS n FROM m),
        f AS (SELECT *, coalesce(last_value(ts IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY ord),
            first_value(ts IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM x)
       SELECT conversation_id, ord, CASE WHEN n >= 2 THEN g ELSE ts END AS ts, ts IS NULL AND n >= 2 AND g IS NOT NULL AS interpolated FROM f""",
    "m",
)
register(
    "e14_with_conversation",
    lambda v: enrich.with_conversation(
        v.tool_events.select("event_id", "conversation_id", F.col("tool_name").alias("model"), F.lit(None).cast("timestamp_ntz").alias("created_at")),
        v.conversations.select("conversation_id", "model", "created_at"),
    ).select("event_id", "conversation_id", "model", "created_at"),
    "SELECT e.event_id, e.conversation_id, coalesce(e.tool_name, c.model) AS model, c.created_at FROM e LEFT JOIN c ON c.conversation_id = e.conversation_id",
    "e", "c",
)
