"""Queries of column functions, text and join operators, snapshot rules and logs, over cases that the given tables are turned into.

Each case is made of a row's numbers and texts, so that every branch of a rule is met by many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.operators import deep, enrich, graph, reconcile, text
from tessera.plans import monitor
from tessera.plans.registry import register
from tessera.plans.views import Views


def pick(number: Column, *values: object) -> Column:
    """One of the values by number, in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def sql_pick(number: str, *values: object) -> str:
    literal = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper()
    return f"[{', '.join(map(literal, values))}][CAST({number} % {len(values)} + 1 AS INTEGER)]"


def js(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _n() -> Column:
    return F.col("event_id").cast("long")


_E = "WITH x AS (SELECT CAST(event_id AS BIGINT) AS n, * FROM e)"

# --- F: column functions ------------------------------------------------------------------------

register(
    "f03_pair_times",
    lambda v: v.tool_events.select(
        "event_id",
        F.date_format(X.pair_ts(F.parse_json(F.when(_n() % 3 == 0, F.lit('"2024-02-03T04:05:06Z"')).otherwise(F.format_string("[%d, 5]", _n() + 1_700_000_000)))), "yyyy-MM-dd HH:mm:ss").alias("at"),
    ),
    f"{_E} SELECT event_id, CASE WHEN n % 3 = 0 THEN '2024-02-03 04:05:06' ELSE strftime(make_timestamp((n + 1700000000) * 1000000), '%Y-%m-%d %H:%M:%S') END AS at FROM x",
    "e",
)


def _content(v: Views) -> DataFrame:
    text_, kind = js(F.col("content")), F.col("sequence") % 4
    doc = (
        F.when(kind == 0, F.concat(F.lit('{"content_type":"text","parts":['), text_, F.lit(',"",'), js(F.col("role")), F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('{"content_type":"code","text":'), text_, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"content_type":"thoughts","thoughts":[{"summary":'), js(F.col("role")), F.lit(',"content":'), text_, F.lit("}]}")))
        .otherwise(F.concat(F.lit('{"content_type":"multimodal_text","parts":[{"content_type":"image_asset_pointer","metadata":{"dalle":{"prompt":" p "}}},'), text_, F.lit("]}")))
    )
    return v.messages.select("message_id", F.parse_json(doc).alias("doc"))


register(
    "f05_content_texts",
    lambda v: _content(v).select("message_id", X.content_text(F.col("doc")).alias("content")),
    """SELECT message_id, CASE sequence % 4 WHEN 0 THEN content || chr(10) || chr(10) || role WHEN 1 THEN content
       WHEN 2 THEN '**' || role || '**' || chr(10) || chr(10) || content ELSE '[imagem gerada: p]' || chr(10) || chr(10) || content END AS content FROM m""",
    "m",
)


def _blocks(v: Views) -> DataFrame:
    one = F.struct("sequence", F.col("role").alias("type"), F.col("content").alias("text"), F.col("sequence").cast("string").alias("start_timestamp"), (F.col("sequence") * 60).cast("string").alias("stop_timestamp"))
    return v.messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(one)).alias("blocks"))


register(
    "f06_joined_texts",
    lambda v: _blocks(v).select("conversation_id", X.joined_texts(F.col("blocks"), "user").alias("said")),
    "SELECT conversation_id, string_agg(content, chr(10) || chr(10) ORDER BY sequence) FILTER (WHERE role = 'user' AND content <> '') AS said FROM m GROUP BY 1",
    "m",
)
register(
    "f07_types_and_markers",
    lambda v: _blocks(v).select(
        "conversation_id", X.distinct_types(F.transform("blocks", lambda b: b["type"])).alias("types"),
        X.markers(("long", F.size("blocks") > 4), ("even", F.size("blocks") % 2 == 0)).alias("marks"),
    ),
    """SELECT conversation_id, string_agg(DISTINCT role, ',' ORDER BY role) AS types,
       nullif(concat_ws(',', CASE WHEN count(*) > 4 THEN 'long' END, CASE WHEN count(*) % 2 = 0 THEN 'even' END), '') AS marks FROM m GROUP BY 1""",
    "m",
)
register(
    "f08_packed_fields",
    lambda v: v.messages.select("message_id", X.packed(model=F.col("model"), tokens=F.col("token_count")).alias("packed")),
    """SELECT message_id, CASE WHEN model IS NOT NULL OR token_count IS NOT NULL THEN '{' || concat_ws(',', '"model":"' || model || '"', '"tokens":' || token_count) || '}' END AS packed FROM m""",
    "m",
)
register(
    "f08_citations_and_names",
    lambda v: v.messages.groupBy("conversation_id")
    .agg(F.array_sort(F.collect_list(F.struct("sequence", F.when(F.col("sequence") % 2 == 0, F.array("role")).alias("citations"), F.concat(F.col("role"), F.lit(".txt")).alias("file_name")))).alias("b"))
    .select("conversation_id", X.citations(F.col("b")).alias("cited"), X.attachment_names(F.col("b")).alias("names")),
    """SELECT conversation_id, '["' || string_agg(role, '","' ORDER BY sequence) FILTER (WHERE sequence % 2 = 0) || '"]' AS cited,
       string_agg(role || '.txt', ',' ORDER BY sequence) AS names FROM m GROUP BY 1""",
    "m",
)
register(
    "f09_block_times",
    lambda v: _blocks(v).select("conversation_id", *[F.date_format(t, "HH:mm:ss").alias(n) for t, n in zip(X.epoch_bounds(F.col("blocks")), ("opens", "ends"))]),
    """SELECT conversation_id, strftime(make_timestamp(CAST(min(sequence) * 1000000 AS BIGINT)), '%H:%M:%S') AS opens,
       strftime(make_timestamp(CAST(max(sequence) * 60000000 AS BIGINT)), '%H:%M:%S') AS ends FROM m GROUP BY 1""",
    "m",
)
_TOOLS = ("browser.search", "web.run", "python", "canmore.create", "research_kickoff_tool.x", "dalle.text2im", "bio", "file_search.q", "computer.do", "container.exec", "voice_mode.on", "odd")
_TOOL_KINDS = ("search", "search", "code", "canvas", "deep_research", "image_generation", "memory", "file_search", "computer_use", "computer_use", "voice", "other")
register(
    "f10_tool_categories",
    lambda v: v.tool_events.select("event_id", X.tool_category(pick(_n(), *_TOOLS)).alias("category")),
    f"{_E} SELECT event_id, {sql_pick('n', *_TOOL_KINDS)} AS category FROM x",
    "e",
)
register(
    "f11_tool_event_types",
    lambda v: v.tool_events.select("event_id", X.tool_event_type(pick(_n(), "web_search", "repl", "Notion:list-pages", "", "create_file", "memory", "jira_update", "ping"), _n() % 16 >= 8).alias("kind")),
    f"""{_E} SELECT event_id, CASE WHEN n % 16 >= 8 THEN {sql_pick('n', 'mcp_search', 'mcp_other', 'mcp_search', 'other', 'mcp_write', 'mcp_other', 'mcp_write', 'mcp_other')}
        ELSE {sql_pick('n', 'search', 'code', 'other', 'other', 'code', 'memory', 'other', 'other')} END AS kind FROM x""",
    "e",
)
register(
    "f12_modes",
    lambda v: v.tool_events.select(
        "event_id", X.lookup(pick(_n(), *X.CHAT_MODES, "new"), X.CHAT_MODES, "chat").alias("mode"), X.lookup(pick(_n(), *X.SEARCH_MODES, None), X.SEARCH_MODES).alias("searched"),
        X.scenario_mode(pick(_n(), "SCENARIO_SEARCH", "scenario_research", "K2", None)).alias("scenario"),
    ),
    f"""{_E} SELECT event_id, {sql_pick('n', *X.CHAT_MODES.values(), 'chat')} AS mode, {sql_pick('n', *X.SEARCH_MODES.values(), None)} AS searched,
        {sql_pick('n', 'search', 'research', 'chat', 'chat')} AS scenario FROM x""",
    "e",
)
register(
    "f13_hidden_reasons",
    lambda v: v.tool_events.select("event_id", X.hidden_reason(pick(_n(), True, False, None), pick(_n(), 0.0, 1.0, 0.0, None, 1.0), pick(_n(), "all", None, "", "python")).alias("why")),
    f"""{_E} SELECT event_id, CASE WHEN n % 3 = 0 THEN 'visually_hidden' WHEN n % 5 IN (0, 2) THEN 'weight_zero' WHEN n % 4 < 3 THEN NULL ELSE 'internal_recipient' END AS why FROM x""",
    "e",
)
register(
    "f14_voice",
    lambda v: v.messages.select(
        "message_id",
        F.from_json(F.when(F.col("sequence") % 3 == 0, F.lit('["x"]')).otherwise(F.concat(F.lit('["x",{"content_type":"audio_transcription","direction":"'), F.when(F.col("role") == "user", "in").otherwise("out"), F.lit('"}]'))), "array<variant>").alias("parts"),
    ).select("message_id", *[c.alias(n) for c, n in zip(X.voice_direction(F.col("parts")), ("spoken", "direction"))]),
    "SELECT message_id, sequence % 3 <> 0 AS spoken, CASE WHEN sequence % 3 <> 0 THEN CASE WHEN role = 'user' THEN 'in' ELSE 'out' END END AS direction FROM m",
    "m",
)
register(
    "f15_canvas_and_research",
    lambda v: v.tool_events.select(
        "event_id", X.is_canvas(pick(_n(), "canmore.x", "all", None), pick(_n() % 5, "canmore.y", "a", None), pick(_n() % 7, "gpt-4o-canmore", "m")).alias("canvas"),
        X.is_deep_research(pick(_n(), "research_kickoff_tool.a", None), pick(_n() % 3, "a", None), pick(_n() % 5, "o3-Research", "m", None), pick(_n() % 7, "", "v1", None), pick(_n() % 11, None, False, True)).alias("research"),
    ),
    f"""{_E} SELECT event_id, n % 3 = 0 OR n % 5 IN (0, 3) OR n % 7 IN (0, 2, 4, 6) AS canvas,
        n % 2 = 0 OR n % 5 IN (0, 3) OR n % 7 IN (1, 4) OR n % 11 IN (2, 5, 8) AS research FROM x""",
    "e",
)
register(
    "f16_projects_and_assistants",
    lambda v: v.tool_events.select("event_id", *[c.alias(n) for c, n in zip(X.project_or_assistant(pick(_n(), "g-p-1", "g-2", "other", None)), ("project_id", "gizmo_id", "resolved"))]),
    f"{_E} SELECT event_id, {sql_pick('n', 'g-p-1', None, None, None)} AS project_id, {sql_pick('n', None, 'g-2', None, None)} AS gizmo_id, n % 4 <> 2 AS resolved FROM x",
    "e",
)
register(
    "f17_finish_reasons",
    lambda v: v.tool_events.select("event_id", X.finish_reason(pick(_n(), "FINISHED", "INCOMPLETE", "stop", "Done", None)).alias("why")),
    f"{_E} SELECT event_id, {sql_pick('n', 'stop', 'incomplete', 'stop', 'stop', None)} AS why FROM x",
    "e",
)
register(
    "f18_asset_ids",
    lambda v: v.tool_events.select("event_id", X.asset_id(F.concat(pick(_n(), "file-service://", "sediment://", "", None), pick(_n() % 3, "a", "b", ""))).alias("asset")),
    f"{_E} SELECT event_id, CASE WHEN n % 4 < 2 THEN nullif({sql_pick('n % 3', 'a', 'b', '')}, '') END AS asset FROM x",
    "e",
)
register(
    "f19_first_lists",
    lambda v: v.tool_events.select(
        "event_id", F.size(X.first_list(F.parse_json(pick(_n(), '{"a":[1,2]}', '{"b":{"c":[1]}}', '{"a":1,"b":{"c":[]}}', "{}")), "$.a", "$.b.c")).alias("n")
    ),
    f"{_E} SELECT event_id, {sql_pick('x.n', 2, 1, 0, None)} AS n FROM x",
    "e",
)
register(
    "f22_names_and_endings",
    lambda v: v.table("customer").select(
        "c_custkey", X.safe_file_name(F.concat(F.lit(" a/b:"), F.col("c_name"), F.lit("?"))).alias("name"),
        X.extension(pick(F.col("c_custkey"), "text/markdown; charset=utf-8", "IMAGE/PNG", "application/x-odd", None)).alias("ending"),
    ),
    f"SELECT c_custkey, 'a_b_' || c_name || '_' AS name, {sql_pick('c_custkey', 'md', 'png', 'bin', 'bin')} AS ending FROM customer",
)
register(
    "f24_relative_times",
    lambda v: v.tool_events.select("event_id", X.relative_time(F.timestamp_seconds(F.lit(2_000_000_000) - pick(_n(), 5, 90, 7200, 200_000)), F.timestamp_seconds(F.lit(2_000_000_000))).alias("ago")),
    f"{_E} SELECT event_id, {sql_pick('n', 'just now', '1 min ago', '2 h ago', '2 d ago')} AS ago FROM x",
    "e",
)
register(
    "f25_paths",
    lambda v: v.tool_events.select("event_id", X.path_get(F.parse_json(F.concat(F.lit('[{"a":[0,'), F.col("metadata_json"), F.lit("]}]"))), 0, "a", 1, "k").alias("k"), X.path_get(F.parse_json("metadata_json"), 3).alias("none")),
    "SELECT event_id, json_extract_string(metadata_json, '$.k') AS k, CAST(NULL AS VARCHAR) AS none FROM e",
    "e",
)
register(
    "f27_answers",
    lambda v: v.messages.select(
        "message_id", F.concat(F.lit('[{"'), pick(F.col("sequence"), "answer", "markdown", "text", "content", "other"), F.lit('":'), js(F.col("content")), F.lit('},{"text":""}]')).alias("b"), F.concat(F.lit('{"answer":"'), F.col("role"), F.lit('"}')).alias("j")
    ).select("message_id", X.answer_text(F.from_json("b", "array<variant>"), F.col("j")).alias("answer")),
    "SELECT message_id, CASE WHEN sequence % 5 = 4 OR content = '' THEN role ELSE content END AS answer FROM m",
    "m",
)

# --- T: texts ----------------------------------------------------------------------------------

_MARKS = {
    "delimited": ("--- USER ---\n", "--- ASSISTANT ---\n"),
    "said": ("You said:\n", "ChatGPT said:\n"),
}
for _style, (_user, _other) in _MARKS.items():
    register(
        f"t1_turns_{_style}",
        lambda v, style=_style, user=_user, other=_other: text.transcript_turns(
            v.messages.groupBy(F.col("conversation_id").alias("path")).agg(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", F.concat(F.when(F.col("role") == "user", user).otherwise(other), F.col("content")).alias("x")))), lambda p: p["x"]), "\n").alias("content")
            ),
            style,
        ),
        r"""SELECT conversation_id AS path, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence) AS turn,
            CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, trim(content, E' \n\t') AS content FROM m WHERE trim(content, E' \n\t') <> ''""",
        "m",
    )
register(
    "t1_blank_split",
    lambda v: text.blank_split_turns(
        v.messages.groupBy(F.col("conversation_id").alias("path")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", F.concat(F.col("role"), F.col("sequence").cast("string")).alias("x")))), lambda p: p["x"]), "\n\n\n\n").alias("content")
        )
    ),
    """SELECT conversation_id AS path, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY sequence) AS INTEGER) AS turn,
       CASE WHEN row_number() OVER (PARTITION BY conversation_id ORDER BY sequence) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, role || sequence AS content FROM m""",
    "m",
)
register(
    "t2_tool_lines",
    lambda v: text.tool_lines(
        v.tool_events.select("event_id", F.concat(F.lit("note\n⏺ "), pick(_n(), "Read", "Bash", "Edit"), F.lit("(x "), F.col("event_type"), F.lit(")\nSearched for "), F.col("source"), F.lit("\n⏺ plain words")).alias("content"))
    ),
    f"""{_E} SELECT event_id, 1 AS line_no, {sql_pick('n', 'Read', 'Bash', 'Edit')} AS tool_name, CASE WHEN n % 3 <> 1 THEN 'x ' || event_type END AS file_path,
        CASE WHEN n % 3 = 1 THEN 'x ' || event_type END AS command FROM x UNION ALL SELECT event_id, 2, 'Search', NULL, source FROM x""",
    "e",
)
register(
    "t4_address_ladder",
    lambda v: v.table("pages").select(
        "page_id", text.address_kind(F.concat(F.regexp_replace("url", "[?#].*", ""), pick(F.col("page_id"), "/uploads/x.png", "/generated/a.png", "/a.PNG?v=1", "/b.mp4#t", "/c.pdf", "/d.markdown", "/e"))).alias("kind")
    ),
    f"SELECT page_id, {sql_pick('page_id', 'upload', 'generated', 'image', 'video', 'pdf', 'markdown', 'other')} AS kind FROM pages",
)
register(
    "t6_long_reports",
    lambda v: text.long_reports(v.table("documents").select("doc_id", F.concat(pick(F.col("doc_id"), "## On it\nhttps://a.org/x https://b.org ", "no heading "), F.col("text")).alias("content"))).select("doc_id", "title"),
    "SELECT doc_id, 'On it' AS title FROM documents WHERE doc_id % 2 = 0 AND length('## On it' || chr(10) || 'https://a.org/x https://b.org ' || text) >= 2500",
)
register(
    "t8_expected_files",
    lambda v: text.expected_artifacts(v.tool_events.select("event_id", pick(_n(), *text.ARTIFACT_FILES, "odd").alias("output_type_name"))).select("event_id", "ending"),
    f"""{_E} SELECT event_id, unnest([{', '.join(str(list(x)) for x in [*text.ARTIFACT_FILES.values(), []])}][CAST(n % 9 + 1 AS INTEGER)]) AS ending FROM x""",
    "e",
)
register(
    "t9_redacted",
    lambda v: v.tool_events.select(
        "event_id", text.redacted_json(F.concat(F.lit('{"text":"'), F.col("event_type"), F.lit('","kind":"k","in":{"apiKey":"'), F.col("source"), F.lit('"}}')), ("text", "kind"), ("kind",)).alias("j"),
        F.map_values(text.redacted_map(F.create_map(F.lit("my_token"), F.col("source"), F.lit("name"), F.col("source"))))[1].alias("kept"),
    ),
    """SELECT event_id, '{"text":"[REDACTED]","kind":"k","in":{"apiKey":"[REDACTED]"}}' AS j, source AS kept FROM e""",
    "e",
)
register(
    "t11_progress",
    lambda v: v.tool_events.select("event_id", text.progress(F.concat(F.lit("got "), (_n() % 7).cast("string"), pick(_n(), "/", " / ", " of "), (_n() % 4).cast("string"))).alias("done")),
    f"{_E} SELECT event_id, CASE WHEN n % 3 < 2 THEN (n % 7)::DOUBLE / nullif(n % 4, 0) END AS done FROM x",
    "e",
)
register(
    "t12_note_ladder",
    lambda v: v.tool_events.select("event_id", text.note_kind(pick(_n(), "12345678-1234-1234-1234-123456789012", "# Study guide: x", "FAQ", "just a note", "briefly")).alias("kind")),
    f"{_E} SELECT event_id, {sql_pick('n', None, 'brief', 'brief', 'note', 'note')} AS kind FROM x",
    "e",
)

# --- E: joins ----------------------------------------------------------------------------------

register(
    "e3_call_and_result_rows",
    lambda v: enrich.call_and_result_rows(
        v.tool_events.select(
            "conversation_id", F.col("event_id").alias("message_id"), _n().alias("ord"), pick(_n(), "tool_use", "tool_result", "text").alias("type"), F.when(_n() % 3 == 0, F.col("event_id")).alias("id"),
            F.when(_n() % 3 == 1, (_n() - 1).cast("string")).alias("tool_use_id"), F.col("tool_name").alias("name"), pick(_n() % 5, "code", None).alias("category"), F.col("source").alias("content"), pick(_n() % 7, True, False, None).alias("is_error"),
        )
    ),
    f"""{_E} SELECT conversation_id, event_id AS message_id, n AS ord, CASE WHEN n % 5 % 2 = 0 THEN 'code' ELSE 'tool' END || CASE WHEN n % 3 = 0 THEN '_call' ELSE '_result' END AS event_type,
        CASE WHEN n % 3 = 0 THEN event_id ELSE CAST(n - 1 AS VARCHAR) END AS call_id, tool_name, CASE WHEN n % 3 = 1 THEN NOT coalesce({sql_pick('n % 7', True, False, None)}, false) END AS success,
        CASE WHEN n % 3 = 1 THEN source END AS result FROM x WHERE n % 3 < 2""",
    "e",
)
register(
    "e5_local_paths",
    lambda v: enrich.local_paths(
        v.tool_events.select(F.col("event_id").alias("message_id"), F.array(F.concat(F.lit("http://x/"), (_n() % 50).cast("string")), F.concat(F.lit("http://x/"), (_n() % 7 + 60).cast("string"))).alias("urls")),
        v.tool_events.select((_n() % 55).alias("n")).distinct().select(F.concat(F.lit("http://x/"), F.col("n").cast("string")).alias("url"), F.concat(F.lit("p/"), F.col("n").cast("string")).alias("path"), (F.col("n") % 5 == 0).alias("failed")),
    ).select("message_id", F.array_join("asset_paths", " ").alias("paths")),
    f"{_E} SELECT event_id AS message_id, CASE WHEN n % 50 % 5 = 0 THEN 'http://x/' ELSE 'p/' END || n % 50 || ' http://x/' || (n % 7 + 60) AS paths FROM x",
    "e",
)
register(
    "e6_asset_files",
    lambda v: enrich.asset_files(
        v.tool_events.select("conversation_id", F.concat(F.lit("f"), (_n() % 11).cast("string")).alias("file_id")).distinct(),
        v.tool_events.select("conversation_id", pick(_n(), "assets", "previews", "junk").alias("folder"), F.concat(F.lit("f"), (_n() % 13).cast("string"), pick(_n() % 5, "", "__thumbnail.png", "__page.png")).alias("name")),
        ["previews", "assets"],
    ),
    f"""{_E}, l AS (SELECT conversation_id, {sql_pick('n', 'assets', 'previews', 'junk')} AS folder, 'f' || n % 13 AS f, 'f' || n % 13 || {sql_pick('n % 5', '', '__thumbnail.png', '__page.png')} AS name FROM x),
        b AS (SELECT conversation_id, f, arg_min(folder || '/' || name, (CASE folder WHEN 'previews' THEN 1 ELSE 2 END, CASE WHEN name LIKE '%thumbnail%' THEN 1 ELSE 0 END, name)) AS path FROM l WHERE folder <> 'junk' GROUP BY 1, 2),
        p AS (SELECT DISTINCT conversation_id, 'f' || n % 11 AS file_id FROM x)
        SELECT p.conversation_id, p.file_id, b.path FROM p LEFT JOIN b ON b.conversation_id = p.conversation_id AND b.f = p.file_id""",
    "e",
)
register(
    "e13_activity_entries",
    lambda v: enrich.activity_entries(
        v.messages.select(
            F.concat(
                F.lit("<div>Prompted "), F.col("message_id"), F.lit("<br>"),
                F.when(F.col("sequence") % 2 == 0, F.format_string("Mar %d, 2025, %d:04:05 PM", F.col("sequence"), F.col("sequence") % 12 + 1)).otherwise(F.format_string("%d de out. de 2024, 1%d:04:05", F.col("sequence"), F.col("sequence") % 10)), F.lit("</div>"),
            ).alias("html")
        )
    ).select("prompt", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")),
    """SELECT message_id AS prompt, CASE WHEN sequence % 2 = 0 THEN printf('2025-03-%02d %02d:04:05', sequence, (sequence % 12 + 1) % 12 + 12) ELSE printf('2024-10-%02d 1%d:04:05', sequence, sequence % 10) END AS at FROM m""",
    "m",
)
register(
    "e15_project_names",
    lambda v: enrich.project_names(
        v.conversations.select(F.col("project_id").alias("folder")).filter("folder is not null").distinct(),
        v.conversations.filter("project_id is not null").select(F.col("project_id").alias("folder"), F.when(F.col("is_pinned"), F.concat(F.lit(" "), F.col("model"))).otherwise("  ").alias("content")),
    ),
    "SELECT project_id AS folder, coalesce(max(CASE WHEN is_pinned THEN nullif(trim(model), '') END), project_id) AS project FROM c WHERE project_id IS NOT NULL GROUP BY 1",
    "c",
)

# --- G: threads --------------------------------------------------------------------------------


def _pointers(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    to = F.when(k % 10 == 0, k + 9).when(k % 10 == 9, k - 9).when(k % 10 == 1, None).when(k % 10 == 5, -k).otherwise(k - 1)
    return v.table("customer").select(k.alias("file"), to.alias("previous"))


register(
    "g4_chains_with_cycles",
    lambda v: graph.chain_roots(_pointers(v)).select("file", "root", "in_cycle"),
    """WITH t AS (SELECT c_custkey AS k, c_custkey % 10 = 9 AND c_custkey - 9 < (SELECT min(c_custkey) FROM customer)
            OR c_custkey % 10 = 0 AND c_custkey + 9 > (SELECT max(c_custkey) FROM customer) AS ends FROM customer)
       SELECT k AS file, CAST(CASE WHEN k % 10 IN (1, 2, 3, 4) THEN k - k % 10 + 1 WHEN k % 10 IN (5, 6, 7, 8) THEN -(k - k % 10 + 5)
           WHEN ends AND k % 10 = 0 THEN k + 9 ELSE k - k % 10 END AS BIGINT) AS root, k % 10 IN (0, 9) AND NOT ends AS in_cycle FROM t""",
)
_ROOTS = lambda v: v.messages.select(F.col("conversation_id").alias("file"), (F.col("conversation_id").cast("long") - F.col("conversation_id").cast("long") % 3).cast("string").alias("root")).distinct()


def _merged(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = v.messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.min("sequence").alias("created_at"), F.max("sequence").alias("updated_at"))
    number = F.col("conversation_id").cast("long")
    heads = rows.select("*", number.alias("file_ord"), F.when(number % 3 == 1, F.concat(F.lit("t"), "conversation_id")).alias("title"), F.when(number % 3 == 2, F.col("conversation_id")).alias("project"))
    return graph.merge_chains(heads, _ROOTS(v), v.messages.select("conversation_id", "message_id", "sequence"))


_THREES = """k AS (SELECT *, CAST(conversation_id AS BIGINT) AS n, CAST(CAST(conversation_id AS BIGINT) - CAST(conversation_id AS BIGINT) % 3 AS VARCHAR) AS root FROM m)"""
register(
    "g5_merged_conversations",
    lambda v: _merged(v)[0],
    f"""WITH {_THREES} SELECT root AS conversation_id, max(CASE WHEN n % 3 = 1 THEN 't' || conversation_id END) AS title, max(CASE WHEN n % 3 = 2 THEN conversation_id END) AS project,
        min(sequence) AS created_at, max(sequence) AS updated_at, count(*) AS message_count, count(DISTINCT n) AS files FROM k GROUP BY 1""",
    "m",
)
register(
    "g5_merged_messages",
    lambda v: _merged(v)[1].select("conversation_id", "message_id", "sequence"),
    f"WITH {_THREES} SELECT root AS conversation_id, message_id, row_number() OVER (PARTITION BY root ORDER BY n, sequence) AS sequence FROM k",
    "m",
)
register(
    "g6_parent_stubs",
    lambda v: graph.parent_stubs(
        v.conversations.select("conversation_id", F.col("project_id").alias("parent_session_id")),
        v.conversations.filter("is_pinned").select(F.col("project_id").alias("conversation_id"), F.lit(None).cast("string").alias("title"), F.lit(9).alias("created_at"), F.lit(None).cast("int").alias("message_count")).filter("conversation_id is not null").distinct(),
        v.conversations.filter("project_id is not null").groupBy(F.col("project_id").alias("conversation_id")).agg(F.max("model").alias("title"), F.lit(4).alias("created_at"), F.count("*").cast("int").alias("message_count")),
    ),
    """WITH s AS (SELECT project_id AS id, max(model) AS title, CAST(count(*) AS INTEGER) AS n, coalesce(bool_or(is_pinned), false) AS known FROM c WHERE project_id IS NOT NULL GROUP BY 1)
       SELECT id AS conversation_id, title, 4 AS created_at, n AS message_count, NOT known AS is_stub FROM s""",
    "c",
)
register(
    "g7_linked_to_roots",
    lambda v: graph.link_to_roots(v.messages.select("message_id", F.when(F.col("sequence") % 2 == 0, F.col("conversation_id")).otherwise(F.when(F.col("sequence") % 3 == 0, "lost")).alias("parent_session_id")), _ROOTS(v)),
    f"""WITH {_THREES} SELECT message_id, CASE WHEN sequence % 2 = 0 THEN root WHEN sequence % 3 = 0 THEN 'lost' END AS parent_session_id,
        CASE WHEN sequence % 2 = 0 OR sequence % 3 = 0 THEN 'ai_ai' ELSE 'human_ai' END AS interaction_type FROM k""",
    "m",
)
register(
    "g8_deep_citations",
    lambda v: deep.deep_citations(
        v.table("pages").select("page_id", F.concat(F.lit('{"a":[0,{"b":[['), js(F.col("url")), F.lit(',"One",3],["https://z.org","Two"],['), js(F.col("url")), F.lit(',"Again"]]}],"c":["x","y"]}')).alias("doc")), "page_id", "doc"
    ),
    "SELECT page_id, url, 'One' AS title FROM pages UNION ALL SELECT page_id, 'https://z.org', 'Two' FROM pages",
)
register(
    "g8_long_texts",
    lambda v: deep.long_texts(v.table("documents").select("doc_id", F.concat(F.lit('[["a",'), js(F.concat(pick(F.col("doc_id"), "# Head\n", "plain "), F.coalesce("text", F.lit("")))), F.lit("]]")).alias("doc")), "doc_id", "doc").select("doc_id", F.length("text").alias("n")),
    "SELECT doc_id, CAST(length('# Head' || chr(10) || coalesce(text, '')) AS INTEGER) AS n FROM documents WHERE doc_id % 2 = 0 AND length('# Head' || chr(10) || coalesce(text, '')) >= 2500",
)

# --- P: rules of the sources -------------------------------------------------------------------


def _sides(v: Views) -> tuple[DataFrame, DataFrame]:
    """Each order as the server shows it and as the archive has it; the two differ in one field or another."""
    k = F.col("o_orderkey")
    base = v.table("orders").select(k.cast("string").alias("id"), k.alias("k"), F.col("o_orderpriority").alias("name"))
    later = lambda d: F.when(F.col("k") % 13 != 0, F.col("k") % 97 + F.when(F.col("k") % 3 == 0, d).otherwise(0))
    now = base.select(
        "id", F.when(F.col("k") % 5 == 0, "other").otherwise(F.col("name")).alias("title"), (F.col("k") % 97).cast("double").alias("at"), (F.col("k") % 11 == 0).alias("pinned"), (F.col("k") % 7).alias("queries"),
        F.create_map(F.lit("_a"), (F.col("k") % 7 == 0).cast("string"), F.lit("b"), F.col("id")).alias("extra"),
    )
    old = base.select(
        "id", F.col("name").alias("title"), later(-1).cast("double").alias("at"), F.lit(False).alias("pinned"), (F.col("k") % 7 - F.when(F.col("k") % 17 == 0, 1).otherwise(0)).alias("queries"),
        F.create_map(F.lit("_a"), F.lit("false"), F.lit("b"), F.lit("z"), F.lit("_last_seen_in_server"), F.col("id")).alias("extra"),
    )
    return now, old


_AT, _TITLE = "(k % 13 = 0 OR k % 3 = 0)", "k % 5 = 0"
#: For each source the fields of its rule, and the numbers for which it says that a row has changed.
_RULE_CASES = {
    "p2a_chatgpt": ({"update_time": "at", "title": "title", "extra": "extra"}, f"{_AT} OR {_TITLE} OR k % 7 = 0"),
    "p2b_claude_ai": ({"updated_at": "text_at", "name": "title"}, f"{_AT} OR {_TITLE}"),
    "p2c_perplexity": ({"last_query_datetime": "text_at", "query_count": "queries", "title": "title"}, f"{_AT} OR {_TITLE} OR k % 17 = 0"),
    "p2d_qwen": ({"updated_at": "at", "title": "title"}, f"{_AT} OR {_TITLE}"),
    "p2d_deepseek": ({"updated_at": "at", "title": "title"}, f"{_AT} OR {_TITLE}"),
    "p2e_gemini": ({"created_at_secs": "at", "title": "title", "pinned": "pinned"}, f"{_AT} OR {_TITLE} OR k % 11 = 0"),
    "p2f_grok": ({"modifyTime": "text_at", "title": "title"}, f"{_AT} OR {_TITLE}"),
    "p2g_kimi": ({"updateTime": "text_at", "name": "title"}, f"{_AT} OR {_TITLE}"),
}
for _name, (_fields, _changed) in _RULE_CASES.items():

    def _plan(v: Views, fields=_fields, source=_name.split("_", 1)[1]) -> DataFrame:
        sides = [s.withColumn("text_at", F.format_string("%03d", F.col("at").cast("int") + 2)).withColumn("text_at", F.when(F.col("at").isNotNull(), F.col("text_at"))) for s in _sides(v)]
        return reconcile.build_plan(*[s.select("id", *[F.col(c).alias(n) for n, c in fields.items()]) for s in sides], ["id"], reconcile.RULES[source])

    register(
        _name,
        _plan,
        f"SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN {_changed.replace('k', 'o_orderkey')} THEN 'to_use' ELSE 'to_copy' END AS action, false AS is_new FROM orders",
    )


def _bodies(v: Views) -> tuple[DataFrame, DataFrame]:
    n, props = F.col("event_id"), F.col("props")
    now = v.table("events").select(n.alias("id"), F.concat(F.lit('{ "p" : '), props, F.lit(' , "t":[17'), F.lpad((n % 100).cast("string"), 8, "0"), F.lit(',5],"s":"a b","u":[12345678'), F.lpad((n % 90 + 10).cast("string"), 2, "0"), F.lit("]}")).alias("body"))
    old = v.table("events").select(
        n.alias("id"), F.concat(F.lit('{"u":[12345678'), F.when(n % 3 == 0, "01").otherwise(F.lpad((n % 90 + 10).cast("string"), 2, "0")), F.lit('],"s":"'), F.when(n % 5 == 0, "ab").otherwise("a b"), F.lit('","t":[1700000099,77],"p":'), props, F.lit("}")).alias("body")
    )
    return now, old


register(
    "p2h_bodies",
    lambda v: reconcile.build_plan(*_bodies(v), ["id"], reconcile.RULES["notebooklm"]),
    "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'to_use' ELSE 'to_copy' END AS action, false AS is_new FROM events",
)
register(
    "p5_reappearing_rows",
    lambda v: reconcile.reconcile(
        v.conversations.filter("not is_preserved_missing or is_pinned").select("conversation_id", "updated_at"),
        v.conversations.select("conversation_id", "updated_at", F.lit("d0").alias(reconcile.SEEN), F.col("is_preserved_missing").alias(reconcile.GONE)), ["conversation_id"], reconcile.later("updated_at"), "d1",
    ).select("conversation_id", F.col(reconcile.SEEN).alias("seen"), F.col(reconcile.GONE).alias("gone"), "action"),
    """WITH x AS (SELECT conversation_id, NOT is_preserved_missing OR coalesce(is_pinned, false) AS here FROM c)
       SELECT conversation_id, CASE WHEN here THEN 'd1' ELSE 'd0' END AS seen, NOT here AS gone, CASE WHEN here THEN 'to_copy' ELSE 'preserved_missing' END AS action FROM x""",
    "c",
)
register(
    "p4b_bodies_kept",
    lambda v: reconcile.reconcile(
        v.conversations.select("conversation_id", "updated_at", F.when(F.col("is_pinned"), F.col("model")).alias("body")), v.conversations.select("conversation_id", "updated_at", F.col("project_id").alias("body")),
        ["conversation_id"], reconcile.later("updated_at"), "d1", force_all=True, body="body",
    ).select("conversation_id", "body", "body_missing"),
    """SELECT conversation_id, coalesce(CASE WHEN is_pinned THEN model END, project_id) AS body, coalesce(CASE WHEN is_pinned THEN model END, project_id) IS NULL AS body_missing FROM c""",
    "c",
)
register(
    "p8_flags_alone",
    lambda v: reconcile.preserved_if_not_latest(v.conversations.select("conversation_id", F.lit(None).cast("string").alias("last_seen"), F.nullif("is_preserved_missing", F.lit(False)).alias("gone")), flag="gone").select("conversation_id", "is_preserved_missing"),
    "SELECT conversation_id, is_preserved_missing FROM c",
    "c",
)
register(
    "p7_before_latest_or_flagged",
    lambda v: reconcile.preserved_if_not_latest(v.conversations.select("conversation_id", F.date_format("updated_at", "yyyy").alias("last_seen"), F.col("is_pinned").alias("gone")), flag="gone").select("conversation_id", "is_preserved_missing"),
    "SELECT conversation_id, coalesce(is_pinned, false) OR strftime(updated_at, '%Y') < (SELECT max(strftime(updated_at, '%Y')) FROM c) AS is_preserved_missing FROM c",
    "c",
)
register(
    "p10_active_today",
    lambda v: reconcile.active_today(v.conversations.select("conversation_id", F.date_format("updated_at", "yyyy-MM-dd'T'HH").alias("seen")), "1997-05", "seen").select("conversation_id", "is_active"),
    "SELECT conversation_id, strftime(updated_at, '%Y-%m') = '1997-05' AS is_active FROM c",
    "c",
)
register(
    "p18_overlay",
    lambda v: reconcile.overlay(
        v.conversations.select(F.col("conversation_id").alias("id"), F.col("model").alias("body"), F.create_map(F.lit("_own"), F.lit("1"), F.lit("k"), F.lit("old")).alias("extra")),
        v.conversations.filter("account = '1'").select(F.col("conversation_id").alias("id"), F.col("project_id").alias("body"), F.create_map(F.lit("k"), F.lit("new"), F.lit("_own"), F.lit("2")).alias("extra"), F.when(F.col("is_pinned"), "failed").alias("error")),
    ).select("id", "body", F.col("extra")["k"].alias("k"), F.col("extra")["_own"].alias("own"), "refreshed"),
    """WITH x AS (SELECT *, account = '1' AND NOT coalesce(is_pinned, false) AS hit FROM c)
       SELECT conversation_id AS id, CASE WHEN hit THEN coalesce(project_id, model) ELSE model END AS body, CASE WHEN hit THEN 'new' ELSE 'old' END AS k, '1' AS own, hit AS refreshed FROM x""",
    "c",
)
register(
    "p21_inferred_groups",
    lambda v: reconcile.inferred_groups(v.conversations.select(F.concat(pick(F.col("message_count"), "g-p-", "g-"), F.col("project_id")).alias("group_id")), v.conversations.filter("is_pinned").select(F.concat(F.lit("g-p-"), F.col("project_id")).alias("group_id"))),
    """SELECT DISTINCT 'g-p-' || project_id AS group_id FROM c WHERE message_count % 2 = 0 AND project_id IS NOT NULL
       AND 'g-p-' || project_id NOT IN (SELECT 'g-p-' || project_id FROM c WHERE is_pinned AND project_id IS NOT NULL)""",
    "c",
)
register(
    "p24_changed_payloads",
    lambda v: (lambda files: reconcile.payload_changed(files.withColumn("digest", F.when(F.col("source") == "gemini", F.concat("digest", F.lit("x"))).otherwise(F.col("digest"))), reconcile.payload_changed(files, files.limit(0).select("source", F.col("digest").alias("content_hash")))).select("source", "changed"))(
        v.conversations.select("source", F.col("conversation_id").alias("path"), F.md5("conversation_id").alias("digest"))
    ),
    "SELECT DISTINCT source, source = 'gemini' AS changed FROM c",
    "c",
)
register(
    "p26_slim_index",
    lambda v: reconcile.Index().slim("deepseek", v.conversations.select(F.nullif(F.col("project_id"), F.lit("p1")).alias("id"), F.col("model").alias("title"), F.col("message_count").alias("updated_at"), F.col("is_pinned").alias("pinned"), "account")),
    "SELECT project_id AS id, model AS title, message_count AS updated_at, is_pinned AS pinned FROM c WHERE project_id IS NOT NULL AND project_id <> 'p1'",
    "c",
)

# --- M: logs -----------------------------------------------------------------------------------

register(
    "m1_capture_runs",
    lambda v: monitor.capture_runs(
        v.tool_events.select(
            "event_id",
            F.parse_json(
                F.when(_n() % 3 == 0, F.format_string('{"run_started_at":"2024-01-01T00:00:00Z","run_finished_at":"2024-01-01T00:00:%02dZ","mode":"full","discovery":{"total":%d},"fetch":{"attempted":9,"succeeded":8}}', _n() % 60, _n() + 1))
                .when(_n() % 3 == 1, F.format_string('{"started_at":"2024-01-01T00:00:00Z","duration_seconds":%d.5,"totals":{"threads_discovered":%d,"threads_fetched":3}}', _n() % 60, _n() + 1))
                .otherwise(F.format_string('{"discovery_total":%d,"account":"a"}', _n() + 1))
            ).alias("doc"),
        )
    ).select("event_id", "duration_seconds", "mode", "account", "discovery_total", "fetch_attempted", "fetch_succeeded"),
    f"""{_E} SELECT event_id, CASE n % 3 WHEN 0 THEN (n % 60)::DOUBLE WHEN 1 THEN n % 60 + 0.5::DOUBLE END AS duration_seconds, CASE WHEN n % 3 = 0 THEN 'full' END AS mode, CASE WHEN n % 3 = 2 THEN 'a' END AS account,
        n + 1 AS discovery_total, CAST(CASE n % 3 WHEN 0 THEN 9 WHEN 1 THEN 3 END AS BIGINT) AS fetch_attempted, CAST(CASE n % 3 WHEN 0 THEN 8 WHEN 1 THEN 3 END AS BIGINT) AS fetch_succeeded FROM x""",
    "e",
)
register(
    "m2_reconcile_runs",
    lambda v: monitor.reconcile_runs(
        v.tool_events.select(
            "event_id",
            F.parse_json(F.when(_n() % 2 == 0, F.format_string('{"reconciled_at":"2024-01-01T00:00:00Z","added":%d,"updated":2,"copied":3,"preserved_missing":4}', _n())).otherwise(F.format_string('{"run_at":"2024-01-02T00:00:00Z","conversations":{"added":%d,"preserved":5}}', _n()))).alias("doc"),
        )
    ).select("event_id", F.date_format("reconciled_at", "yyyy-MM-dd").alias("day"), "added", "updated", "copied", "preserved"),
    f"""{_E} SELECT event_id, CASE WHEN n % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS day, n AS added, CAST(CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS updated, CAST(CASE WHEN n % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS copied,
        CAST(CASE WHEN n % 2 = 0 THEN 4 ELSE 5 END AS BIGINT) AS preserved FROM x""",
    "e",
)
register(
    "m5_global_kpis",
    lambda v: monitor.global_kpis(
        monitor.latest_runs(v.tool_events.groupBy(F.concat_ws("-", "source", "event_type").alias("platform"), F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("started_at")).agg(F.count("*").alias("discovery_total")), F.lit("2024-03-15").cast("timestamp_ntz"))
    ).select("platforms", "total", "overdue"),
    """WITH d AS (SELECT source || '-' || event_type AS platform, date_trunc('day', created_at) AS t, count(*) AS n FROM e GROUP BY 1, 2), l AS (SELECT platform, max(t) AS latest, arg_max(n, t) AS n FROM d GROUP BY 1)
       SELECT count(*) AS platforms, CAST(sum(n) AS BIGINT) AS total, coalesce(string_agg(platform, ',' ORDER BY platform) FILTER (WHERE epoch(TIMESTAMP '2024-03-15' - latest) / 86400 >= 30), '') AS overdue FROM l""",
    "e",
)
