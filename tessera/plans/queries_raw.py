"""Queries of sources, normalisers and streams: the given tables are turned into raw documents, logs and files, and read back.

Files go to a folder of their own below the shared one; streams read what is there and end.
"""

from __future__ import annotations

import contextlib
import functools
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera import sources, streaming
from tessera.lineage import scratch
from tessera.operators import reconcile
from tessera.plans import monitor, normalize
from tessera.plans.normalize import extras
from tessera.plans.queries_rules import js, pick, sql_pick
from tessera.plans.registry import register
from tessera.plans.views import Views
from tessera.schema import validate
from tessera.sources.tables import latest_per, rotated

# --- N: a conversation's turns as each platform's document -----------------------------------------


def _turns(v: Views, one: Column) -> DataFrame:
    """(id, turns): each conversation's turns, in order, as JSON values."""
    rows = v.table("conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", one.alias("x"))
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda t: t["x"]).alias("turns"))


def _json(**fields: Column | str) -> Column:
    """A JSON object of JSON values."""
    parts = [F.concat(F.lit(f'"{n}":'), c if isinstance(c, Column) else F.lit(c)) for n, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))


def _docs(v: Views, one: Column, document) -> DataFrame:
    """(id, doc): ``document`` makes the whole JSON text of the JSON list (or map entries) of turns."""
    return _turns(v, one).select("id", F.parse_json(document(F.col("turns"))).alias("doc"))


class _Row:
    """Columns of a turn; they are made when a query is built, for they need a session."""

    turn = property(lambda _: F.col("turn"))
    role = property(lambda _: F.col("role"))
    text = property(lambda _: js(F.col("text")))
    mute = property(lambda _: F.col("turn") % 5 == 4)  # turns without a text of their own
    said = property(lambda self: F.when(self.mute, '""').otherwise(self.text))
    line = property(lambda _: F.regexp_replace(F.trim("text"), r"\s+", " "))
    conv = property(lambda _: F.col("conv_id").cast("string"))
    id = property(lambda self: F.concat(self.conv, F.lit("_"), self.turn.cast("string")))
    at = property(lambda self: (self.turn + 1_700_000_000).cast("string"))
    stamp = property(lambda self: _quoted(F.date_format(F.timestamp_seconds(self.turn + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")))


R = _Row()
_quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
#: Times that run against the turns' order.
_backwards = lambda: _quoted(F.concat(F.lit("2024-01-01T00:00:"), F.lpad((59 - F.col("turn")).cast("string"), 2, "0"), F.lit("Z")))


def _chatgpt(v: Views) -> DataFrame:
    """Trees with forks (every third turn answers the one before the last), tools, quotes, canvas and research nodes, and nodes below a lost one."""
    t = R.turn
    above = F.when(t == 5, "lost").otherwise(F.concat(R.conv, F.lit("_"), (t - F.when(t % 3 == 2, 2).otherwise(1)).cast("string")))
    beside = (t == 1) & (R.role == "assistant")
    message = _json(
        id=_quoted(R.id), author=_json(role=_quoted(F.when(t == 3, "tool").otherwise(R.role)), name=F.when(t == 3, '"python"').otherwise("null")), create_time=R.at,
        content=_json(content_type=F.when((t == 4) & (F.col("conv_id") % 3 == 0), '"tether_quote"').otherwise('"text"'), parts=_list(F.array(F.when(t == 6, '""').otherwise(R.text))), text=R.text, url='"u"'),
        recipient=F.when(beside & (F.col("conv_id") % 2 == 0), '"canmore.update"').otherwise('"all"'),
        metadata=_json(model_slug=F.when(R.role == "assistant", '"m"').otherwise("null"), research_done=F.when(beside & (F.col("conv_id") % 2 == 1), "true").otherwise("null")),
    )
    node = F.concat(_quoted(R.id), F.lit(":"), _json(id=_quoted(R.id), parent=F.when(t == 0, "null").otherwise(_quoted(above)), message=message))
    current = _quoted(F.concat("id", F.lit("_1")))
    return _docs(v, node, lambda x: _json(title='"T"', create_time=F.lit("1700000000"), gizmo_id='"g-p-1"', is_archived="true", current_node=current, mapping=F.concat(F.lit("{"), F.array_join(x, ","), F.lit("}"))))


def _claude(v: Views) -> DataFrame:
    """Some turns have a tool's call alone; system turns are unknown there."""
    tool = _json(type='"tool_use"', name='"web_search"', id=F.when(R.turn % 2 == 0, _quoted(F.concat(F.lit("t_"), R.id))).otherwise("null"), input=_json(q=_quoted(R.role)))
    block = _json(type='"text"', text=R.text)
    blocks = _list(F.when(R.mute, F.array(tool)).when(R.turn % 3 == 1, F.array(block, tool)).otherwise(F.array(block)))
    one = _json(
        uuid=_quoted(R.id), sender=_quoted(F.when(R.role == "user", "human").otherwise(R.role)), created_at=F.lit('"2024-01-01T00:00:00Z"'), content=blocks, stop_reason=F.when(R.turn % 2 == 1, '"end"').otherwise("null"),
        attachments=F.when(R.turn % 4 == 2, '[{"file_name":"f.txt","extracted_content":"x"},{"file_name":""}]').otherwise("[]"),
    )
    return _docs(v, one, lambda t: _json(name='"N"', model='"cm"', is_starred="true", chat_messages=_list(t)))


def _qwen(v: Views) -> DataFrame:
    found = F.when(R.turn % 2 == 1, F.lit('{"search_results":[1,2]}')).otherwise("null")
    one = _json(id=_quoted(R.id), role=_quoted(R.role), content=R.said, timestamp=(1_700_000_000 - R.turn).cast("string"), model='"q"', info=found, files=F.when(R.mute, '[{"name":"f"}]').otherwise("[]"), is_stop=F.when(R.turn == 2, "true").otherwise("null"))
    return _docs(v, F.concat(_quoted(R.id), F.lit(":"), one), lambda t: _json(data=_json(title='"Q"', chat_type='"search"', meta='{"tags":["a"]}', chat=_json(history=_json(messages=F.concat(F.lit("{"), F.array_join(t, ","), F.lit("}")))))))


def _deepseek(v: Views) -> DataFrame:
    one = _json(
        message_id=F.when(R.turn == 6, "null").otherwise(R.turn.cast("string")), role=_quoted(F.upper(R.role)), content=R.said, inserted_at=R.at, status='"FINISHED"', accumulated_token_usage=(R.turn * 10).cast("string"),
        search_enabled=F.when(R.mute, "true").otherwise("false"), search_results=F.when((R.turn % 2 == 1) | R.mute, "[1]").otherwise("[]"), model=F.when(R.role == "assistant", '"d"').otherwise("null"),
    )
    return _docs(v, one, lambda t: _json(chat_session=_json(title='"D"', model_type=F.when(F.size(t) % 2 == 0, '"expert"').otherwise('"default"')), chat_messages=_list(t)))


def _gemini(v: Views) -> DataFrame:
    """Turns without texts have a picture alone, or nothing."""
    source = '["https://t.gstatic.com/faviconV2?a","https://site.org/a","Title","Snippet"]'
    picture = F.when(R.turn % 3 == 0, '"https://lh3.googleusercontent.com/p?x=1"').otherwise("null")
    answer = F.concat(F.lit('[["k",'), F.when(R.mute, "null").otherwise(_list(F.array(R.text))), F.lit(","), picture, F.lit(f",{source},{source}]]"))
    asked = F.when(R.mute, "null").otherwise(F.concat(F.lit("[["), R.text, F.lit("]]")))
    turn = F.concat(F.lit('[["c","'), R.id, F.lit('"],null,'), asked, F.lit(",["), answer, F.lit(",null,null,null,null,null,null,null,\"BR\"" + ",null" * 12 + ",\"g"), (R.turn % 3).cast("string"), F.lit('"],['), R.at, F.lit("]]"))
    return _docs(v, turn, lambda t: _json(uuid=_quoted(F.concat(F.lit("c_"), F.col("id"))), raw=_list(F.array(_list(t)))))


def _perplexity(v: Views) -> DataFrame:
    found = _json(web_result_block=_json(web_results='[{"url":"u1","name":"n1"},{"link":"u2"}]'))
    blocks = F.when(R.mute, _list(F.array(found))).otherwise(_list(F.array(_json(answer=R.text), found)))
    one = _json(uuid=_quoted(R.id), query_str=R.said, mode='"COPILOT"', display_model=F.when(R.turn == 0, '"p"').otherwise("null"), blocks=blocks, media_items='[{"url":"m"}]', first_answer=F.when(R.turn == 4, js(F.lit('{"answer":"first"}'))).otherwise("null"))
    return _docs(v, one, lambda t: _json(entries=_list(t)))


def _grok(v: Views) -> DataFrame:
    """Some responses have a picture alone, some were broken off; times run backwards."""
    sender = F.when(R.role == "user", " Human").otherwise(F.upper(R.role))
    one = _json(
        responseId=_quoted(R.id), sender=_quoted(sender), message=R.said, createTime=_backwards(), model=F.when(R.turn == 0, '"any"').otherwise("null"),
        webSearchResults=F.when(R.turn % 2 == 0, "[1,2]").otherwise("[]"), xposts=F.when(R.turn % 3 == 0, "[1]").otherwise("null"), generatedImageUrls=F.when(R.mute, '["u"]').otherwise("[]"),
        fileUris=F.when(R.turn == 3, '["a/b.pdf"]').otherwise("null"), imageAttachments=F.when(R.turn == 3, '[{"name":"i.png"},{}]').otherwise("null"),
        partial=F.when(R.turn == 1, "true").otherwise("false"), streamErrors=F.when(R.turn == 2, "[1]").otherwise("[]"),
    )
    head = _json(conversationId=_quoted(F.col("id")), title='"K"', workspaces='[{"workspaceId":"w1","name":"W"},{"workspaceId":"w2"}]', mediaTypes='["t"]')
    return _docs(v, one, lambda t: _json(conversation_v2=_json(conversation=head), responses=_json(responses=_list(t))))


def _kimi(v: Views) -> DataFrame:
    tool = _json(id='"b"', tool=_json(name='"search"', toolCallId='"t"', contents="[1]"))
    text, file = _json(text=_json(content=R.text)), '{"file":{"id":"f1","name":"n.pdf"}}'
    blocks = F.when(R.mute, F.array(F.lit(file))).when(R.turn % 2 == 0, F.array(text, tool)).otherwise(F.array(text))
    one = _json(id=_quoted(R.id), role=_quoted(R.role), createTime=_backwards(), blocks=_list(blocks), refs='{"usedSearchChunks":[1,2,3]}', status=F.when(R.turn == 1, '"MESSAGE_STATUS_CANCELLED"').otherwise('"MESSAGE_STATUS_COMPLETED"'))
    return _docs(v, one, lambda t: _json(chat=_json(name='"I"', lastRequest='{"scenario":"SCENARIO_K2_SEARCH"}'), messages=_list(t)))


_RAW = {"chatgpt": _chatgpt, "claude_ai": _claude, "qwen": _qwen, "deepseek": _deepseek, "gemini": _gemini, "perplexity": _perplexity, "grok": _grok, "kimi": _kimi}
_NODE = "conv_id || '_' || turn"
_MUTE, _SAID = "turn % 5 = 4", "CASE WHEN turn % 5 = 4 THEN '' ELSE text END"
_PEOPLE = "role IN ('user', 'assistant')"
#: A tree's nodes (parent's turn), those below the first (with the head of their branch), and the branch's name.
_TREE = """WITH RECURSIVE n AS (SELECT *, CASE WHEN turn = 0 OR turn = 5 THEN NULL WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS above FROM conversations),
    k AS (SELECT conv_id, above AS turn, count(*) AS children FROM n WHERE above IS NOT NULL GROUP BY ALL),
    r AS (SELECT conv_id, turn, 0 AS head FROM n WHERE turn = 0 UNION ALL
          SELECT n.conv_id, n.turn, CASE WHEN k.children > 1 THEN n.turn ELSE r.head END FROM r JOIN n ON n.conv_id = r.conv_id AND n.above = r.turn JOIN k ON k.conv_id = r.conv_id AND k.turn = r.turn),
    x AS (SELECT n.*, head, n.conv_id || '_' || CASE WHEN head = 0 THEN 'main' ELSE n.conv_id || '_' || head END AS branch_id, n.turn = 4 AND n.conv_id % 3 = 0 AS quote FROM n JOIN r USING (conv_id, turn)),
    said AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY branch_id, turn) AS seq FROM x WHERE turn <> 3 AND role IN ('user', 'assistant') AND NOT quote AND turn <> 6 AND text <> '')"""
#: For each platform: query of (turn, message_id, sequence, role, content, content_types, model, names, finish) over conversations.
_SAYS = {
    "chatgpt": f"""{_TREE} SELECT conv_id, {_NODE} AS message_id, seq AS sequence, role, text AS content, 'text' AS content_types, CASE WHEN role = 'assistant' THEN 'm' END AS model, NULL AS attachment_names, NULL AS finish_reason, branch_id FROM said""",
    "claude_ai": f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations)
        SELECT conv_id, {_NODE} AS message_id, seq AS sequence, role, {_SAID} AS content, CASE WHEN {_MUTE} THEN 'tool_use' WHEN turn % 3 = 1 THEN 'text,tool_use' ELSE 'text' END || CASE WHEN turn % 4 = 2 THEN ',attachment' ELSE '' END AS content_types,
            CASE WHEN role = 'assistant' THEN 'cm' END AS model, CASE WHEN turn % 4 = 2 THEN '["f.txt"]' END AS attachment_names, CASE WHEN turn % 2 = 1 THEN 'end' END AS finish_reason, conv_id || '_main' AS branch_id FROM x WHERE {_PEOPLE}""",
    "qwen": f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS seq FROM conversations)
        SELECT conv_id, {_NODE} AS message_id, seq AS sequence, role, {_SAID} AS content, concat_ws(',', CASE WHEN {_SAID} <> '' THEN 'text' END, CASE WHEN {_MUTE} THEN 'file' END, CASE WHEN turn % 2 = 1 THEN 'search' END) AS content_types,
            CASE WHEN role = 'assistant' THEN 'q' END AS model, CASE WHEN {_MUTE} THEN '["f"]' END AS attachment_names, CASE WHEN turn = 2 THEN 'user_stop' END AS finish_reason, conv_id || '_main' AS branch_id FROM x WHERE {_PEOPLE}""",
    "deepseek": f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations)
        SELECT conv_id, CAST(turn AS VARCHAR) AS message_id, seq AS sequence, role, {_SAID} AS content, CASE WHEN {_MUTE} THEN 'search' ELSE 'text' END AS content_types, CASE WHEN role = 'assistant' THEN 'd' END AS model,
            NULL AS attachment_names, 'stop' AS finish_reason, conv_id || '_main' AS branch_id FROM x WHERE {_PEOPLE} AND turn <> 6""",
    "grok": f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS seq FROM conversations)
        SELECT conv_id, {_NODE} AS message_id, seq AS sequence, role, {_SAID} AS content, concat_ws(',', CASE WHEN {_SAID} <> '' THEN 'text' END, CASE WHEN turn % 2 = 0 THEN 'search' END, CASE WHEN turn % 3 = 0 THEN 'xpost' END,
            CASE WHEN {_MUTE} THEN 'image_gen' END, CASE WHEN turn = 3 THEN 'attachment' END) AS content_types, CASE WHEN role = 'assistant' AND turn = 0 THEN 'any' END AS model,
            CASE WHEN turn = 3 THEN '["i.png","b.pdf"]' END AS attachment_names, CASE turn WHEN 1 THEN 'partial' WHEN 2 THEN 'stream_error' END AS finish_reason, conv_id || '_main' AS branch_id FROM x WHERE {_PEOPLE}""",
    "kimi": f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS seq FROM conversations)
        SELECT conv_id, {_NODE} AS message_id, seq AS sequence, role, {_SAID} AS content, CASE WHEN {_MUTE} THEN 'file' WHEN turn % 2 = 0 THEN 'text,tool' ELSE 'text' END AS content_types, NULL AS model,
            CASE WHEN {_MUTE} THEN '["n.pdf"]' END AS attachment_names, CASE WHEN turn = 1 THEN 'cancelled' END AS finish_reason, conv_id || '_main' AS branch_id FROM x""",
    "gemini": f"""WITH x AS (SELECT *, conv_id || '_t' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS place FROM conversations),
        b AS (SELECT conv_id, turn, place || '_user' AS message_id, 0 AS side, 'user' AS role, text, false AS pic FROM x WHERE NOT {_MUTE}
              UNION ALL SELECT conv_id, turn, place || '_asst', 1, 'assistant', {_SAID}, turn % 3 = 0 FROM x WHERE {_SAID} <> '' OR turn % 3 = 0)
        SELECT conv_id, message_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, side) AS sequence, role, text AS content, CASE WHEN pic THEN 'text+image' ELSE 'text' END AS content_types,
            CASE WHEN side = 1 THEN 'g' || (turn % 3) END AS model, CASE WHEN pic THEN '["p"]' END AS attachment_names, NULL AS finish_reason, conv_id || '_main' AS branch_id FROM b""",
    "perplexity": f"""WITH b AS (SELECT conv_id, turn, {_NODE} || '_user' AS message_id, 0 AS side, 'user' AS role, {_SAID} AS text FROM conversations
              UNION ALL SELECT conv_id, turn, {_NODE} || '_asst', 1, 'assistant', CASE WHEN turn = 4 THEN 'first' ELSE {_SAID} END FROM conversations)
        SELECT conv_id, message_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, side) AS sequence, role, text AS content, 'text' AS content_types, CASE WHEN side = 1 THEN 'p' END AS model, NULL AS attachment_names,
            NULL AS finish_reason, conv_id || '_main' AS branch_id FROM b""",
}
_NUMBER = {"chatgpt": 1, "claude_ai": 2, "gemini": 6, "qwen": 7, "deepseek": 8, "perplexity": 9, "grok": 12, "kimi": 13}
for _source, _rows in _SAYS.items():
    register(
        f"n{_NUMBER[_source]:02d}_{_source}_messages",
        lambda v, s=_source: normalize.messages(_RAW[s](v), normalize.SPECS[s]).select(
            "message_id", "conversation_id", "source", "sequence", "role", "content", "content_types", "model", "attachment_names", "finish_reason", "branch_id"
        ),
        f"""SELECT message_id, CAST(conv_id AS VARCHAR) AS conversation_id, '{_source}' AS source, sequence, role, content, content_types, CAST(model AS VARCHAR) AS model, CAST(attachment_names AS VARCHAR) AS attachment_names,
            CAST(finish_reason AS VARCHAR) AS finish_reason, branch_id FROM ({_rows})""",
    )


def _heads(v: Views, source: str) -> DataFrame:
    docs, spec = _RAW[source](v), normalize.SPECS[source]
    return normalize.conversations(docs, spec, normalize.messages(docs, spec)).select("conversation_id", "title", "model", "mode", "message_count", "settings_json", "project_id", "is_pinned", "is_archived")


#: For each platform: title, model, mode, message_count, settings_json, project_id, is_pinned, is_archived over a conversation's turns.
_ALL, _TALK = "count(*)", f"count(*) FILTER (WHERE {_PEOPLE})"
_HEADS = {
    "claude_ai": ("'N'", "'cm'", "'chat'", _TALK, "NULL", "NULL", "true", "NULL"),
    "qwen": ("'Q'", "'q'", "'search'", _TALK, """'{"meta":"{\\"tags\\":[\\"a\\"]}"}'""", "NULL", "NULL", "NULL"),
    "deepseek": (
        "'D'", "CASE WHEN bool_or(role = 'assistant') THEN 'd' END", "CASE WHEN count(*) % 2 = 0 THEN 'research' ELSE 'chat' END", f"count(*) FILTER (WHERE {_PEOPLE} AND turn <> 6)",
        """'{"agent":"chat","model_type":"' || CASE WHEN count(*) % 2 = 0 THEN 'expert' ELSE 'default' END || '","version":null,"title_type":null,"seq_id":null,"is_empty":null' ||
           CASE WHEN max(turn) > 0 THEN ',"total_token_usage":' || (max(turn) * 10) ELSE '' END || '}'""", "NULL", "NULL", "NULL",
    ),
    "gemini": (
        "NULL", "'g' || least(2, max(turn))", "'chat'", f"count(*) FILTER (WHERE NOT {_MUTE}) + count(*) FILTER (WHERE NOT {_MUTE} AND text <> '' OR turn % 3 = 0)",
        """'{"locale":"BR","models_used":["g0"' || CASE WHEN max(turn) > 0 THEN ',"g1"' ELSE '' END || CASE WHEN max(turn) > 1 THEN ',"g2"' ELSE '' END || ']}'""", "NULL", "NULL", "NULL",
    ),
    "grok": ("'K'", "'any'", "'chat'", _TALK, """'{"systemPromptName":"","mediaTypes":["t"],"taskResult":{}}'""", "'w1'", "false", "NULL"),
    "kimi": ("'I'", "'SCENARIO_K2_SEARCH'", "'search'", _ALL, """'{"scenario":"SCENARIO_K2_SEARCH","options":{},"tools":[]}'""", "NULL", "NULL", "NULL"),
}
register(
    "n01_chatgpt_conversations",
    lambda v: _heads(v, "chatgpt"),
    f"""{_TREE}, a AS (SELECT conv_id, branch_id FROM x WHERE turn = 1), s AS (SELECT said.*, a.branch_id AS active, said.turn = 1 AND role = 'assistant' AND conv_id % 2 = 0 AS hidden FROM said LEFT JOIN a USING (conv_id)),
        f AS (SELECT conv_id, count(*) FILTER (WHERE NOT hidden AND (active IS NULL OR branch_id = active)) AS message_count, max(CASE WHEN role = 'assistant' THEN 'm' END) AS model FROM s GROUP BY conv_id)
        SELECT CAST(c.conv_id AS VARCHAR) AS conversation_id, 'T' AS title, f.model, 'chat' AS mode, coalesce(message_count, 0) AS message_count, CAST(NULL AS VARCHAR) AS settings_json, 'g-p-1' AS project_id,
            CAST(NULL AS BOOLEAN) AS is_pinned, true AS is_archived FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN f USING (conv_id)""",
)
for _source, _columns in _HEADS.items():
    _title, _model, _mode, _count, _settings, _project, _pin, _archived = _columns
    register(
        f"n{_NUMBER[_source]:02d}_{_source}_conversations",
        lambda v, s=_source: _heads(v, s),
        f"""SELECT CAST(conv_id AS VARCHAR) AS conversation_id, {_title} AS title, CAST({_model} AS VARCHAR) AS model, CAST({_mode} AS VARCHAR) AS mode, {_count} AS message_count, CAST({_settings} AS VARCHAR) AS settings_json,
            CAST({_project} AS VARCHAR) AS project_id, CAST({_pin} AS BOOLEAN) AS is_pinned, CAST({_archived} AS BOOLEAN) AS is_archived FROM conversations GROUP BY conv_id""",
    )

#: For each platform: rows of (event's key, type, tool, success, turns) as DuckDB expressions.
_EVENTS = {
    "claude_ai": None,
    "qwen": [("search_call", "search_call", "search", "NULL", f"turn % 2 = 1 AND {_PEOPLE}"), ("search_result", "search_result", "search", "true", f"turn % 2 = 1 AND {_PEOPLE}")],
    "deepseek": [(f"search_{k}", f"search_{k}", "web_search", ok, f"(turn % 2 = 1 OR {_MUTE}) AND turn <> 6 AND {_PEOPLE}") for k, ok in (("call", "NULL"), ("result", "true"))],
    "grok": [("web_search", "search_result", "web_search", "true", f"turn % 2 = 0 AND {_PEOPLE}"), ("xposts", "xpost_result", "xposts", "true", f"turn % 3 = 0 AND {_PEOPLE}"), ("image_gen", "image_result", "image_gen", "true", f"{_MUTE} AND {_PEOPLE}")],
    "kimi": [("tool_t", "search_call", "search", "true", f"turn % 2 = 0 AND NOT {_MUTE}"), ("refs_search", "search_result", "web_search", "true", f"turn % 2 = 1 OR {_MUTE}")],
    "perplexity": [("src_0", "search_result", "web_search", "NULL", "true"), ("src_1", "search_result", "web_search", "NULL", "true"), ("media_0", "media_reference", "external_media", "NULL", "true")],
    "gemini": [("img_0", "image_generation", "gemini_image", "NULL", "turn % 3 = 0"), ("cite_0", "search_result", "gemini_search", "NULL", f"turn % 3 = 0 OR NOT {_MUTE} AND text <> ''")],
}
for _source, _rows in _EVENTS.items():
    if _rows is None:
        _sql = f"""SELECT CASE WHEN turn % 2 = 0 THEN 't_' || {_NODE} ELSE {_NODE} || '_call_' || CASE WHEN {_MUTE} THEN 0 ELSE 1 END END AS event_id, CAST(conv_id AS VARCHAR) AS conversation_id, {_NODE} AS message_id,
            'search_call' AS event_type, 'web_search' AS tool_name, CAST(NULL AS BOOLEAN) AS success FROM conversations WHERE (turn % 3 = 1 OR {_MUTE}) AND {_PEOPLE}"""
    else:
        _message = "CAST(turn AS VARCHAR)" if _source == "deepseek" else _NODE
        if _source == "gemini":
            _message = "conv_id || '_t' || place"
        _owner = f"{_message} || '_asst'" if _source in ("gemini", "perplexity") else _message
        _before = _message if _source == "perplexity" else _owner
        _sql = " UNION ALL ".join(
            f"SELECT {_before} || '_{key}' AS event_id, CAST(conv_id AS VARCHAR) AS conversation_id, {_owner} AS message_id, '{kind}' AS event_type, '{tool}' AS tool_name, CAST({ok} AS BOOLEAN) AS success FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) WHERE {where}"
            for key, kind, tool, ok, where in _rows
        )
    register(
        f"n{_NUMBER[_source]:02d}_{_source}_events",
        lambda v, s=_source: normalize.tool_events(_RAW[s](v), normalize.SPECS[s]).select("event_id", "conversation_id", "message_id", "event_type", "tool_name", "success"),
        _sql,
    )
register(
    "n01_chatgpt_events",
    lambda v: normalize.tool_events(_chatgpt(v), normalize.SPECS["chatgpt"]).select("event_id", "conversation_id", "message_id", "event_type", "tool_name", "result", "metadata_json"),
    f"""{_TREE}, y AS (SELECT *, CASE WHEN quote THEN 'quote' WHEN turn = 3 THEN 'code' WHEN turn = 1 AND role = 'assistant' AND conv_id % 2 = 0 THEN 'canvas' WHEN turn = 1 AND role = 'assistant' THEN 'deep_research' END AS kind FROM x)
        SELECT conv_id || '_evt_' || row_number() OVER (PARTITION BY conv_id ORDER BY branch_id, turn) AS event_id, CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || '_' || above AS message_id, kind AS event_type,
            CASE kind WHEN 'quote' THEN 'tether_quote' WHEN 'code' THEN 'python' WHEN 'canvas' THEN 'canmore.update' ELSE 'research_kickoff_tool' END AS tool_name, nullif(text, '') AS result,
            CASE WHEN quote THEN '{{"url":"u"}}' ELSE '{{"model_slug":' || CASE WHEN role = 'assistant' THEN '"m"' ELSE 'null' END || ',"research_done":' || CASE WHEN kind = 'deep_research' THEN 'true' ELSE 'null' END || '}}' END AS metadata_json
        FROM y WHERE kind IS NOT NULL""",
)
register(
    "n01_chatgpt_nodes",
    lambda v: normalize.tree_nodes(_chatgpt(v), normalize.SPECS["chatgpt"]).select("conversation_id", "node", "parent"),
    f"SELECT CAST(conv_id AS VARCHAR) AS conversation_id, {_NODE} AS node, CASE WHEN turn = 5 THEN 'lost' WHEN turn > 0 THEN conv_id || '_' || (turn - CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END) END AS parent FROM conversations",
)
register(
    "n12_workspace_links",
    lambda v: normalize.group_links(_grok(v), normalize.SPECS["grok"]).select("conversation_id", "project_tag", "source"),
    "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conversation_id, unnest(['w1', 'w2']) AS project_tag, 'grok' AS source FROM conversations",
)
register(
    "n09_space_links",
    lambda v: normalize.space_links(
        v.table("conversations").groupBy((F.col("conv_id") % 5).alias("n")).agg(_list(F.collect_set(_json(uuid=_quoted(F.col("conv_id").cast("string"))))).alias("j")).select(F.concat(F.lit("s"), F.col("n").cast("string")).alias("space"), F.parse_json("j").alias("doc"))
    ).select("conversation_id", "project_tag"),
    "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conversation_id, 's' || (conv_id % 5) AS project_tag FROM conversations",
)

# --- N11, N17: notebooks -----------------------------------------------------------------------------


def _notebooks(v: Views) -> DataFrame:
    """Each conversation as a notebook: its first turn is the guide's summary, its turns are questions, sources, notes and outputs."""
    one = F.concat_ws("\u0001", R.id, F.col("text"), R.role)
    part = lambda x, k: js(F.split(x, "\u0001")[k])
    each = lambda t, f: _list(F.transform(t, f))

    def document(t: Column) -> Column:
        listed = F.col("id").cast("long")
        return _json(
            title='"listed"', create_time=F.concat(F.lit("["), (listed + 1_700_000_000).cast("string"), F.lit(",5]")), update_time=F.when(listed % 2 == 0, (listed + 1_700_000_100).cast("string")).otherwise("null"),
            guide=F.concat(F.lit("[[["), part(t[0], 1), F.lit("],["), each(t, lambda x: _list(F.array(part(x, 1), part(x, 2)))), F.lit("]]]")),
            metadata=F.concat(F.lit("[["), F.when(listed % 3 == 0, "null").otherwise('"T"'), F.lit(","), each(t, lambda x: F.concat(F.lit("[["), part(x, 0), F.lit("],"), part(x, 2), F.lit("]"))), F.lit("]]")),
            notes=F.concat(F.lit("["), each(t, lambda x, i: F.concat(F.lit("["), part(x, 0), F.lit(",["), part(x, 0), F.lit(","), F.when(i % 2 == 0, part(x, 1)).otherwise(F.lit('"# brief"')), F.lit("]]"))), F.lit("]")),
            audios=F.concat(F.lit("["), each(t, lambda x, i: F.concat(F.lit("["), part(x, 0), F.lit(","), part(x, 2), F.lit(","), (i + 1).cast("string"), F.lit(',[[["s"]]],"done"]'))), F.lit("]")),
            chat=each(t, lambda x: _json(id=part(x, 0), role=part(x, 2), content=part(x, 1))),
        )

    return _docs(v, one, document)


_C = "CAST(conv_id AS VARCHAR) AS conversation_id"
register(
    "n11_notebook_messages",
    lambda v: normalize.notebook_messages(_notebooks(v)).select("message_id", "conversation_id", "sequence", "role", "content"),
    f"""SELECT {_NODE} AS message_id, {_C}, row_number() OVER w - CASE WHEN first_value(text) OVER w = '' THEN 1 ELSE 0 END AS sequence, role, text AS content FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
        UNION ALL SELECT conv_id || '_guide_summary', CAST(conv_id AS VARCHAR), 0, 'system', arg_min(text, turn) FROM conversations GROUP BY conv_id HAVING arg_min(text, turn) <> ''""",
)
register(
    "n11_notebook_heads",
    lambda v: normalize.notebook_heads(_notebooks(v)).select("conversation_id", "title", "model", "mode", "message_count", "summary", F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("updated_at").alias("updated")),
    f"""SELECT {_C}, CASE WHEN conv_id % 3 = 0 THEN 'listed' ELSE 'T' END AS title, 'gemini' AS model, 'chat' AS mode, count(*) + CASE WHEN arg_min(text, turn) <> '' THEN 1 ELSE 0 END AS message_count, nullif(arg_min(text, turn), '') AS summary,
        conv_id + 1700000000 AS created, conv_id + CASE WHEN conv_id % 2 = 0 THEN 1700000100 ELSE 1700000000 END AS updated FROM conversations GROUP BY conv_id""",
)
_PLACE = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"
register(
    "n11_guide_questions",
    lambda v: normalize.guide_questions(_notebooks(v)).select("question_id", "conversation_id", "question_text", "full_prompt", "order"),
    f"""SELECT conv_id || '_q' || ({_PLACE}) AS question_id, {_C}, text AS question_text, role AS full_prompt, {_PLACE} AS "order" FROM conversations""",
)
register(
    "n11_sources",
    lambda v: normalize.notebook_sources(
        _notebooks(v),
        v.table("conversations").filter("turn % 2 = 0").select(R.id.alias("source_id"), F.parse_json(F.concat(F.lit("[0,0,0,[[[0,1,[[[0,1,["), R.text, F.lit("]],[1,2,["), js(R.role), F.lit("]]]]]]]]"))).alias("doc")),
    ).select("doc_id", "project_id", "file_name", "content", "content_size", "estimated_token_count"),
    f"""SELECT {_NODE} AS doc_id, CAST(conv_id AS VARCHAR) AS project_id, role AS file_name, text || role AS content, length(text || role) AS content_size, length(text || role) // 4 AS estimated_token_count
        FROM conversations WHERE turn % 2 = 0""",
)
register(
    "n11_source_guides",
    lambda v: normalize.source_guides(_notebooks(v), v.table("conversations").select(R.id.alias("source_id"), F.parse_json(F.concat(F.lit("[[[null,["), F.when(R.turn % 3 == 0, js(R.role)).otherwise(""), F.lit("],[["), F.when(R.turn % 2 == 0, '"a","b"').otherwise(""), F.lit("]]]]]"))).alias("doc"))).select(
        "source_id", "conversation_id", "summary", "tags_json"
    ),
    f"""SELECT {_NODE} AS source_id, {_C}, CASE WHEN turn % 3 = 0 THEN role END AS summary, CASE WHEN turn % 2 = 0 THEN '["a","b"]' END AS tags_json FROM conversations WHERE turn % 3 = 0 OR turn % 2 = 0""",
)
register(
    "n11_notes",
    lambda v: normalize.notebook_notes(_notebooks(v)).select("note_id", "conversation_id", "content", "kind"),
    f"""WITH x AS (SELECT *, {_PLACE} AS p FROM conversations) SELECT {_NODE} AS note_id, {_C}, CASE WHEN p % 2 = 0 THEN text ELSE '# brief' END AS content,
        CASE WHEN p % 2 = 1 OR starts_with(text, '#') OR starts_with(text, '**') OR starts_with(text, 'Based') OR starts_with(text, 'Com base') THEN 'brief' ELSE 'note' END AS kind FROM x WHERE p % 2 = 1 OR text <> ''""",
)
register(
    "n11_outputs",
    lambda v: normalize.notebook_outputs(_notebooks(v)).select("output_id", "conversation_id", "output_type", "output_type_name", "title", "status", "source_refs_json"),
    f"""WITH x AS (SELECT *, {_PLACE} + 1 AS p FROM conversations), t AS (SELECT unnest([1, 2, 3, 4, 7, 8, 9, 10]) AS p,
            unnest(['audio_overview', 'blog_post', 'video_overview', 'flashcards_quiz', 'data_table', 'slide_deck', 'infographic', 'mind_map']) AS name)
        SELECT {_NODE} AS output_id, {_C}, CAST(x.p AS INTEGER) AS output_type, t.name AS output_type_name, role AS title, 'done' AS status, '["s"]' AS source_refs_json FROM x JOIN t ON t.p = x.p""",
)
register(
    "n17_legacy_outputs",
    lambda v: extras.legacy_notebooks(
        v.tool_events.select("conversation_id", F.concat(F.col("event_id"), pick(F.col("event_id").cast("long"), ".m4a", ".PDF", ".txt", ".md")).alias("name")), v.tool_events.select("conversation_id", F.col("event_id").alias("name"), F.col("source").alias("content"))
    )[0].select("output_id", "output_type", "output_type_name"),
    f"""WITH x AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM e) SELECT conversation_id || ':' || event_id || {sql_pick('n', '.m4a', '.PDF', '.txt', '.md')} AS output_id, CAST({sql_pick('n', 1, 8, None, 2)} AS INTEGER) AS output_type,
        {sql_pick('n', 'audio_overview', 'slide_deck', None, 'blog_post')} AS output_type_name FROM x WHERE n % 4 <> 2""",
    "e",
)
def _pages(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each page with one to three entries; titles in three places, entries with and without ids and answers."""
    n, url = F.col("page_id"), F.col("url")
    entry = lambda k: _json(
        uuid=F.when((n + k) % 4 == 0, "null").otherwise(_quoted(F.concat(F.lit(f"e{k}_"), n.cast("string")))), query_str=F.when(n % 5 == 0, '""').otherwise(js(url)), display_model=f'"m{k}"',
        blocks=_list(F.array(_json(markdown=js(F.concat(F.lit(f"a{k} "), url))))) if k != 2 else F.lit("[]"), first_answer=js(F.lit('{"answer":"first"}')), entry_created_datetime=f'"2024-01-0{k + 1}T00:00:00Z"',
        entry_updated_datetime=f'"2024-02-0{k + 1}T00:00:00Z"' if k < 2 else "null", author_username=F.when(n % 3 == 0, '"me"').when(n % 3 == 1, '"you"').otherwise("null"), thread_title=F.when(n % 7 == 0, "null").otherwise('"thread"'),
        article_info=F.when(n % 6 == 0, js(F.lit('{"title":"as text"}'))).when(n % 6 == 1, '{"title":"as object"}').otherwise('"no json"'),
    )
    entries = F.slice(F.array(entry(0), entry(1), entry(2)), F.lit(1), (1 + n % 3).cast("int"))
    return extras.pages(v.table("pages").select(n.cast("string").alias("slug"), F.concat(F.lit("s"), (n % 4).cast("string")).alias("space"), F.parse_json(_json(entries=_list(entries))).alias("doc")), "me")


register(
    "n10_pages",
    lambda v: _pages(v)[0].select("conversation_id", "title", "interaction_type", "model", "message_count", "project_id", F.date_format("created_at", "yyyy-MM-dd").alias("began"), F.date_format("updated_at", "yyyy-MM-dd").alias("ended")),
    """SELECT 'page:' || page_id AS conversation_id, CASE WHEN page_id % 6 = 0 THEN 'as text' WHEN page_id % 6 = 1 THEN 'as object' WHEN page_id % 7 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'thread' END AS title,
       CASE WHEN page_id % 3 = 1 THEN 'ai_ai' ELSE 'human_ai' END AS interaction_type, 'm0' AS model, 2 * (1 + page_id % 3) AS message_count, 's' || (page_id % 4) AS project_id, '2024-01-01' AS began,
       CASE WHEN page_id % 3 = 1 THEN '2024-02-02' ELSE '2024-02-01' END AS ended FROM pages""",
)
_ENTRIES = """e AS (SELECT page_id, url, unnest(range(0, 1 + page_id % 3)) AS k FROM pages),
    m AS (SELECT *, CASE WHEN (page_id + k) % 4 = 0 THEN page_id || '_' || 2 * k ELSE 'e' || k || '_' || page_id END AS entry FROM e)"""
register(
    "n10_page_messages",
    lambda v: _pages(v)[1].select("message_id", "conversation_id", "sequence", "role", "content", "model"),
    f"""WITH {_ENTRIES} SELECT entry || '_query' AS message_id, 'page:' || page_id AS conversation_id, 2 * k + 1 AS sequence, 'user' AS role, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS content, NULL AS model FROM m
        UNION ALL SELECT entry || '_answer', 'page:' || page_id, 2 * k + 2, 'assistant', CASE WHEN k = 2 THEN 'first' ELSE 'a' || k || ' ' || url END, 'm' || k FROM m""",
)
register(
    "n10_page_branches",
    lambda v: _pages(v)[2].select("branch_id", "conversation_id", "root_message_id", "leaf_message_id", "is_active"),
    f"""WITH {_ENTRIES} SELECT 'page:' || page_id || '_main' AS branch_id, 'page:' || page_id AS conversation_id, arg_min(entry, k) || '_query' AS root_message_id, arg_max(entry, k) || '_answer' AS leaf_message_id, true AS is_active FROM m GROUP BY page_id""",
)
register(
    "n10_asset_events",
    lambda v: extras.asset_events(
        v.table("pages").select(F.parse_json(_json(asset_slug=F.when(F.col("page_id") % 9 == 0, '""').otherwise(js(F.col("url"))), entry_uuid=F.when(F.col("page_id") % 2 == 0, _quoted(F.col("page_id").cast("string"))).otherwise("null"), asset_type='"CHART"', is_pinned=F.when(F.col("page_id") % 3 == 0, "true").otherwise("null"))).alias("doc"))
    ).select("event_id", "conversation_id", "message_id", "event_type", "tool_name", "file_path", "metadata_json"),
    """SELECT 'asset:' || url AS event_id, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE url END AS conversation_id, CASE WHEN page_id % 2 = 0 THEN page_id || '_asst' ELSE 'asset:' || url END AS message_id, 'asset_generation' AS event_type,
       'CHART' AS tool_name, 'assets/files/' || url AS file_path, '{"caption":null,"preview_image_url":null,"is_pinned":' || (page_id % 3 = 0) || ',"media_type":null,"_preserved_missing":false}' AS metadata_json FROM pages WHERE page_id % 9 <> 0""",
)
register(
    "f21_content_ids",
    lambda v: v.table("pages").select("page_id", X.content_id(F.col("url")).alias("long_id"), X.content_id(F.col("url"), 12).alias("short_id")),
    "SELECT page_id, substr(sha1(url), 1, 16) AS long_id, substr(sha1(url), 1, 12) AS short_id FROM pages",
)
_P, _ID = lambda: F.col("page_id"), lambda: _quoted(F.col("page_id").cast("string"))
_EVEN = lambda yes, no="null": F.when(_P() % 2 == 0, yes).otherwise(no)


def _of_pages(v: Views, document: Column) -> DataFrame:
    return v.table("pages").select("page_id", F.parse_json(document).alias("doc"))


register(
    "n19_project_docs",
    lambda v: normalize.project_docs(
        _of_pages(v, _json(uuid=_ID(), docs=_list(F.array(_json(uuid='"d"', file_name='"f"', content=js(F.col("url")), estimated_token_count=_EVEN("7", '"no"'), created_at='"2024-01-01T00:00:00Z"'), F.lit('{"uuid":""}'), F.lit('{"uuid":"e"}'))))), "claude_ai"
    ).select("doc_id", "project_id", "file_name", "content", "content_size", "estimated_token_count", F.unix_timestamp("created_at").alias("created")),
    """SELECT 'd' AS doc_id, CAST(page_id AS VARCHAR) AS project_id, 'f' AS file_name, url AS content, length(url) AS content_size, CASE WHEN page_id % 2 = 0 THEN 7 END AS estimated_token_count, 1704067200 AS created FROM pages
       UNION ALL SELECT 'e', CAST(page_id AS VARCHAR), '', '', 0, NULL, NULL FROM pages""",
)
register(
    "n19_project_files",
    lambda v: normalize.project_docs(
        _of_pages(v, _json(id=_ID(), _files=_list(F.array(_json(file_id=_EVEN('"a"'), id='"b"', name=js(F.col("url")), size=_P().cast("string"), created_at=_EVEN("1704067200", "0")))))), "qwen"
    ).select("doc_id", "project_id", "file_name", "content", "content_size", F.unix_timestamp("created_at").alias("created")),
    "SELECT CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS doc_id, CAST(page_id AS VARCHAR) AS project_id, url AS file_name, '' AS content, page_id AS content_size, CASE WHEN page_id % 2 = 0 THEN 1704067200 END AS created FROM pages",
)
register(
    "n19_metadata_claude_ai",
    lambda v: normalize.project_metadata(_of_pages(v, _json(uuid=_ID(), name=js(F.col("url")), is_private=_EVEN("false"), is_starred=_EVEN("true"), docs_count=_P().cast("string"), created_at='"2024-01-01T00:00:00Z"')), "claude_ai").select(
        "project_id", "name", "description", "prompt_template", "is_private", "is_starred", "is_starter_project", "docs_count", "files_count", F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("archived_at").alias("archived")
    ),
    """SELECT CAST(page_id AS VARCHAR) AS project_id, url AS name, '' AS description, '' AS prompt_template, page_id % 2 <> 0 AS is_private, page_id % 2 = 0 AS is_starred, false AS is_starter_project, page_id AS docs_count, 0 AS files_count,
       1704067200 AS created, CAST(NULL AS BIGINT) AS archived FROM pages""",
)
register(
    "n19_metadata_qwen",
    lambda v: normalize.project_metadata(_of_pages(v, _json(id=_ID(), icon=js(F.col("url")), custom_instruction=_EVEN('"c"'), created_at="1704067200", updated_at='"1704067201"', _files=_EVEN("[1,2]"))), "qwen").select(
        "project_id", "name", "icon", "custom_instruction", "files_count", F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("updated_at").alias("updated")
    ),
    """SELECT CAST(page_id AS VARCHAR) AS project_id, '' AS name, url AS icon, CASE WHEN page_id % 2 = 0 THEN 'c' ELSE '' END AS custom_instruction, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS files_count, 1704067200 AS created, 1704067201 AS updated FROM pages""",
)
register(
    "n19_metadata_grok",
    lambda v: normalize.project_metadata(
        _of_pages(v, _json(workspaceId=_ID(), name=js(F.col("url")), customPersonality='"own"', viewCount="1", lastUseTime='"2024-01-01T00:00:00Z"', _detail=_EVEN(_json(customPersonality='"detail"', isPublic="true", viewCount=_P().cast("string")), F.when(_P() % 3 == 0, "{}").otherwise("null")))), "grok"
    ).select("project_id", "name", "custom_instruction", "preferred_model", "is_public", "view_count", "clone_count", "is_preserved_missing", F.unix_timestamp("updated_at").alias("updated")),
    """SELECT CAST(page_id AS VARCHAR) AS project_id, url AS name, CASE WHEN page_id % 2 = 0 THEN 'detail' ELSE 'own' END AS custom_instruction, '' AS preferred_model, page_id % 2 = 0 AS is_public, CASE WHEN page_id % 2 = 0 THEN page_id ELSE 1 END AS view_count,
       0 AS clone_count, false AS is_preserved_missing, 1704067200 AS updated FROM pages""",
)
register(
    "n19_metadata_kimi",
    lambda v: normalize.project_metadata(_of_pages(v, _json(id=_ID(), name='"n"', description=js(F.col("url")), pinned=_EVEN("true"), installed="true", categories=_EVEN('["a","b"]'), source='"s"')), "kimi").select(
        "project_id", "name", "icon", "custom_instruction", "is_pinned", "is_installed", "categories", "source_type"
    ),
    "SELECT CAST(page_id AS VARCHAR) AS project_id, 'n' AS name, '' AS icon, url AS custom_instruction, page_id % 2 = 0 AS is_pinned, true AS is_installed, CASE WHEN page_id % 2 = 0 THEN 'a,b' ELSE '' END AS categories, 's' AS source_type FROM pages",
)
register(
    "n19_assets",
    lambda v: normalize.assets(
        _of_pages(v, _json(assetId=_ID(), mimeType=_EVEN('"image/png"'), sizeBytes=_quoted(_P().cast("string")), isLatest=_EVEN("true"))), "grok", v.table("pages").filter("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("asset_id"), F.col("url").alias("path"))
    ).select("asset_id", "mime_type", "size_bytes", "is_latest", "is_deleted", "asset_path"),
    """SELECT CAST(page_id AS VARCHAR) AS asset_id, CASE WHEN page_id % 2 = 0 THEN 'image/png' ELSE '' END AS mime_type, page_id AS size_bytes, page_id % 2 = 0 AS is_latest, false AS is_deleted, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS asset_path FROM pages""",
)
register(
    "n19_scheduled_tasks",
    lambda v: normalize.scheduled_tasks(_of_pages(v, _json(active=_list(F.array(_json(id=_ID()))), inactive=_EVEN(_list(F.array(_json(id=js(F.col("url"))))))))).select("status", F.try_variant_get("task", "$.id", "string").alias("id")),
    "SELECT 'active' AS status, CAST(page_id AS VARCHAR) AS id FROM pages UNION ALL SELECT 'inactive', url FROM pages WHERE page_id % 2 = 0",
)
register(
    "n20_indexed",
    lambda v: extras.with_index(
        v.conversations.select("conversation_id", "source", F.col("model").alias("title"), F.lit(False).alias("is_pinned"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(False).alias("is_preserved_missing")),
        v.conversations.filter("account <> '3'").select("conversation_id", F.col("project_id").alias("title"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), "is_pinned", F.col("is_preserved_missing").alias("deleted")),
    ).select("conversation_id", "title", "is_pinned", "is_preserved_missing"),
    """SELECT conversation_id, CASE WHEN account <> '3' THEN coalesce(project_id, model) ELSE model END AS title, CASE WHEN account <> '3' THEN coalesce(is_pinned, false) ELSE false END AS is_pinned,
       account <> '3' AND is_preserved_missing AS is_preserved_missing FROM c""",
    "c",
)
register(
    "n22_rejected",
    lambda v: validate(v.messages.withColumn("role", pick(F.col("sequence"), "user", "robot", None)).withColumn("source", pick(F.col("sequence") % 5, "codex", "unknown")), "messages")[1].select("message_id", "violations"),
    """SELECT message_id, concat_ws(',', CASE WHEN sequence % 5 % 2 = 1 THEN 'source' END, CASE WHEN sequence % 3 > 0 THEN 'role' END) AS violations FROM m WHERE sequence % 5 % 2 = 1 OR sequence % 3 > 0""",
    "m",
)

# --- S: files ------------------------------------------------------------------------------------------


def _written(df: DataFrame, what: str, *by: str, kind: str = "text") -> str:
    """Where ``df`` was written, a folder for each value of ``by``."""
    path = scratch(df.sparkSession, what)
    writer = df.write.partitionBy(*by) if by else df.write
    getattr(writer, kind)(path)
    return path


def _conversation_texts(v: Views) -> DataFrame:
    return _turns(v, _json(role=_quoted(R.role), text=R.text)).select("id", _json(id=js(F.col("id")), turns=_list(F.col("turns"))).alias("value"))


def _maps(v: Views) -> DataFrame:
    """One map of at most some hundred documents a file, as snapshots of single accounts are."""
    n = F.greatest(F.lit(1), F.ceil(F.lit(v.table("conversations").count()) / 1000))
    entry = F.concat(js(F.col("id")), F.lit(":"), F.col("value"))
    maps = _conversation_texts(v).groupBy(F.pmod(F.xxhash64("id"), n).alias("part")).agg(F.concat(F.lit('{"conversations":{'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("value"))
    return sources.json_map(v.spark, _written(maps, "maps", "part") + "/*")


register(
    "s07_json_maps",
    lambda v: _maps(v).select("id", F.size(F.try_variant_get("doc", "$.turns", "array<variant>")).alias("n")),
    "SELECT CAST(conv_id AS VARCHAR) AS id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id",
)


def _folder_of(v: Views, key: Column) -> Column:
    """Some hundred files a folder, however many there are."""
    n = F.greatest(F.lit(1), F.ceil(F.lit(v.table("conversations").count()) / 1000))
    return F.pmod(F.xxhash64(key), n).cast("string")


def _accounts(v: Views) -> DataFrame:
    """One document a file, below a folder for each account; every fifth is cut off and no JSON."""
    number, path = F.col("id").cast("long"), scratch(v.spark, "accounts")
    name = F.concat(F.lit("account-"), (number % 3).cast("string"), F.lit("/"), _folder_of(v, F.col("id")), F.lit("/"), F.col("id"), F.lit(".txt"))
    cut = F.when(number % 5 == 0, F.substring("value", 1, 20)).otherwise(F.col("value"))
    sources.write_files(_conversation_texts(v).select(name.alias("path"), cut.alias("value")), path)
    return sources.json_documents(v.spark, path, "*.txt", by_tasks=True)


register(
    "s08_rejected_documents",
    lambda v: sources.rejected(_accounts(v)).groupBy(sources.account_of(F.col("path")).alias("account")).agg(F.count("*").alias("n")),
    "SELECT CAST(conv_id % 3 AS VARCHAR) AS account, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 5 = 0 GROUP BY 1",
)
register(
    "s09_accounts",
    lambda v: sources.with_account(_accounts(v).filter("doc is not null").select("path", F.try_variant_get("doc", "$.id", "string").alias("id")), "id").select("account", "id"),
    "SELECT DISTINCT CAST(conv_id % 3 AS VARCHAR) AS account, 'account-' || (conv_id % 3) || '_' || conv_id AS id FROM conversations WHERE conv_id % 5 <> 0",
)
register(
    "s10_log_lines",
    lambda v: sources.json_lines(
        v.spark,
        _written(v.table("events").select(_json(n=F.col("event_id").cast("string"), kind=_quoted(F.col("event_type"))).alias("value"), (F.col("user_id") % 8).alias("part")).repartition("part").sortWithinPartitions("part"), "lines", "part"),
        "*.txt",
    ).groupBy(F.regexp_extract("path", "part=([0-9]+)", 1).alias("part")).agg(F.count("*").alias("lines"), F.count_distinct("line_no").alias("numbers"), F.max("line_no").alias("last"), F.sum(F.try_variant_get("doc", "$.n", "long")).alias("total")),
    "SELECT CAST(user_id % 8 AS VARCHAR) AS part, count(*) AS lines, count(*) AS numbers, count(*) - 1 AS last, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1",
)
def _message_texts(v: Views) -> DataFrame:
    """A file for each message, named by its id and, as rows may repeat, a number."""
    message, path = F.coalesce("message_id", F.lit("")), scratch(v.spark, "texts")
    name = F.concat(_folder_of(v, message), F.lit("/"), message, F.lit("-"), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    sources.write_files(v.messages.select(name.alias("path"), F.concat("content", F.lit("\n")).alias("value")), path)
    return sources.text_files(v.spark, path, "*.txt", by_tasks=True)


register(
    "s11_text_files",
    lambda v: _message_texts(v).select(F.nullif(F.regexp_extract("file_name", r"^(.*)-[0-9]+\.txt$", 1), F.lit("")).alias("message_id"), F.rtrim("content", F.lit("\n")).alias("content")),
    r"SELECT message_id, rtrim(content, E'\n') AS content FROM m",
    "m",
)
register(
    "s12_index",
    lambda v: sources.read_index(
        v.spark, _written(v.conversations.groupBy("source").agg(_list(F.collect_list(_json(id=F.when(F.col("is_pinned"), "null").otherwise(js(F.col("conversation_id"))), t=js(F.coalesce("model", F.lit("")))))).alias("value")), "index", "source"), "id", "id string, t string"
    ).select("id", "t"),
    "SELECT conversation_id AS id, coalesce(model, '') AS t FROM c WHERE NOT coalesce(is_pinned, false)",
    "c",
)


def _table(v: Views) -> str:
    folder = scratch(v.spark, "unified")
    sources.write_table(v.conversations.drop("capture_method"), folder, "conversations")
    return folder


register(
    "s04_unified_table",
    lambda v: sources.read_table(v.spark, _table(v), "conversations", "cli").select("conversation_id", "model", "interaction_type", "capture_method"),
    "SELECT conversation_id, model, 'human_ai' AS interaction_type, 'extractor' AS capture_method FROM c WHERE source = 'codex'",
    "c",
)


def _views(v: Views) -> DataFrame:
    folder = scratch(v.spark, "parts")
    v.conversations.filter("capture_method is null or capture_method <> 'manual_copypaste'").drop("is_pinned").write.parquet(f"{folder}/chatgpt_conversations.parquet")
    v.conversations.filter("capture_method = 'manual_copypaste'").write.parquet(f"{folder}/chatgpt_manual_conversations.parquet")
    counts = sources.register_views(v.spark, folder, "chatgpt", ["conversations", "messages"], account="2")
    assert set(counts) == {"conversations"}
    return v.spark.table("conversations")


register(
    "s03_views_of_parts",
    lambda v: _views(v).select("conversation_id", "account", "is_pinned"),
    "SELECT conversation_id, account, CASE WHEN capture_method = 'manual_copypaste' THEN is_pinned END AS is_pinned FROM c WHERE account = '2'",
    "c",
)


def _log(v: Views) -> DataFrame:
    path = scratch(v.spark, "log")
    for half in (0, 1):  # in two runs
        sources.append_log(v.table("events").filter(F.col("event_id") % 2 == half).select(F.col("event_id").alias("at"), "event_type"), path)
    return v.spark.read.schema("at long, event_type string").json(path)


def _run_logs(v: Views) -> DataFrame:
    """Logs in both layouts: views flat (and, which counts for nothing, by account), clicks and others by account; every 50th line is cut off."""
    n, kind = F.col("event_id"), F.col("event_type")
    line = _json(started_at=_quoted(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), totals=_json(threads_discovered=(n % 100).cast("string")), errors="[1]")
    rows = v.table("events").select(kind.alias("platform"), F.concat(F.lit("account-"), (F.col("user_id") % 3).cast("string")).alias("folder"), F.when(n % 50 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    root, staged = scratch(v.spark, "run-logs"), scratch(v.spark, "run-logs-parts")
    rows.repartition("platform", "folder").write.partitionBy("platform", "folder").text(staged)
    rows.filter("platform = 'view'").repartition(1).select("value").write.text(f"{staged}/platform=view/flat")  # one file is what a platform has
    _moved(v.spark, staged, root)
    return sources.run_logs(v.spark, root, "capture_log.jsonl")


def _moved(spark, staged: str, root: str) -> None:
    """Each folder's file as the log that a platform writes: ``platform=p/folder=f/part`` to ``p/f/capture_log.jsonl``, a flat one to ``p/capture_log.jsonl``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(hadoop.Path(f"{staged}/platform=*/*/part*")):
        *_, platform, folder, _ = found.getPath().toString().split("/")
        to = "/".join([root, platform.split("=")[1], *([folder.split("=")[1]] if "=" in folder else []), "capture_log.jsonl"])
        fs.mkdirs(hadoop.Path(to).getParent())
        fs.rename(found.getPath(), hadoop.Path(to))


register(
    "s13_run_logs",
    lambda v: monitor.capture_runs(_run_logs(v).withColumnRenamed("account", "of_folder")).groupBy("platform", "of_folder").agg(F.count("*").alias("runs"), F.sum("discovery_total").alias("total"), F.sum("errors").alias("errors"), F.date_format(F.max("started_at"), "yyyy-MM-dd HH:mm:ss").alias("newest")),
    """SELECT event_type AS platform, CASE WHEN event_type <> 'view' THEN CAST(user_id % 3 AS VARCHAR) END AS of_folder, count(*) AS runs, CAST(sum(nullif(event_id % 100, 0)) AS BIGINT) AS total, count(*) AS errors,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events WHERE event_id % 50 <> 0 GROUP BY 1, 2""",
)
register(
    "s13_rejected_lines",
    lambda v: sources.rejected_lines(_run_logs(v)).groupBy("platform", "folder").agg(F.count("*").alias("n")),
    "SELECT event_type AS platform, CASE WHEN event_type <> 'view' THEN 'account-' || (user_id % 3) END AS folder, count(*) AS n FROM events WHERE event_id % 50 = 0 GROUP BY 1, 2",
)


def _guarded(v: Views) -> DataFrame:
    """A first version, a snapshot that lost two thirds and is refused, and one that lost a third; what each left behind."""
    archive = reconcile.VersionedArchive(v.spark, scratch(v.spark, "guarded"))
    rows = v.conversations.select("conversation_id", F.col("message_count").alias("t"))
    part = F.col("conversation_id").cast("long") % 3
    out = []
    for number, (snapshot, largest) in enumerate([(rows, None), (rows.filter(part == 0), None), (rows.filter(part != 0), rows.count()), (rows.filter(part != 0), None)]):
        with contextlib.suppress(reconcile.DropTooLarge):
            archive.reconcile(snapshot, ["conversation_id"], reconcile.later("t"), f"d{number}", largest_capture=largest)
        counts = archive.read().groupBy(F.col(reconcile.SEEN).alias("seen"), F.col(reconcile.GONE).alias("gone")).agg(F.count("*").alias("n"))
        out.append(counts.withColumn("run", F.lit(number)).withColumn("version", F.lit(archive.current())))
    return functools.reduce(DataFrame.unionByName, out)


register(
    "p14_guarded_writes",
    _guarded,
    """WITH x AS (SELECT CAST(conversation_id AS BIGINT) % 3 <> 0 AS kept, count(*) AS n FROM c GROUP BY 1), r AS (SELECT unnest([0, 1, 2]) AS run)
       SELECT run, 1 AS version, 'd0' AS seen, false AS gone, CAST(sum(n) AS BIGINT) AS n FROM r, x GROUP BY run
       UNION ALL SELECT 3, 2, CASE WHEN kept THEN 'd3' ELSE 'd0' END, NOT kept, n FROM x""",
    "c",
)
def _parts(v: Views) -> str:
    """The processed parts of every source that there is: an automatic one, a manual one of pinned conversations; and a file of no table."""
    folder, staged = scratch(v.spark, "processed"), scratch(v.spark, "processed-parts")
    hadoop = v.spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(staged).getFileSystem(v.spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(folder))
    rows = v.conversations.withColumn("title", F.when(F.col("is_pinned"), "by hand"))
    parts = {"": rows, "_manual": rows.filter("is_pinned"), "_else": rows.limit(1)}
    for kind, df in parts.items():
        name = F.concat("source", F.lit(f"{kind}_conversations" if kind != "_else" else "_unknown"))
        df.withColumn("file", name).repartition("file").write.partitionBy("file").parquet(f"{staged}/{kind or 'own'}")
        for found in fs.globStatus(hadoop.Path(f"{staged}/{kind or 'own'}/file=*/part*")):
            file = found.getPath().getParent().getName().split("=")[1]
            fs.rename(found.getPath(), hadoop.Path(f"{folder}/{file}.parquet"))
    return folder


def _unified(v: Views) -> DataFrame:
    """The parts are found by their names; of equal keys the last file's row stays."""
    found = sources.discover_parts(v.spark, _parts(v)).filter("table_name = 'conversations'").select("path").collect()  # one row a file
    return sources.unify(v.spark, "conversations", [r["path"] for r in found])


register(
    "s01_unified_parts",
    lambda v: _unified(v).groupBy("source", "title").agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("ids"), F.sum("message_count").alias("messages")),
    "SELECT source, CASE WHEN is_pinned THEN 'by hand' END AS title, count(*) AS n, count(DISTINCT conversation_id) AS ids, CAST(sum(message_count) AS BIGINT) AS messages FROM c GROUP BY 1, 2",
    "c",
)
register(
    "s02_sources_of_parts",
    lambda v: sources.discover_parts(v.spark, _parts(v)).filter("table_name is not null").select("file_name", "table_name", "source"),
    """SELECT DISTINCT source || '_conversations.parquet' AS file_name, 'conversations' AS table_name, source FROM c
       UNION ALL SELECT DISTINCT source || '_manual_conversations.parquet', 'conversations', source FROM c WHERE is_pinned""",
    "c",
)
register(
    "m09_file_statistics",
    lambda v: sources.file_statistics(v.spark, _parts(v)).select("files", (F.col("bytes") > 0).alias("some"), F.col("newest").isNotNull().alias("dated")),
    "SELECT 1 + count(DISTINCT source) + count(DISTINCT source) FILTER (WHERE is_pinned) AS files, true AS some, true AS dated FROM c",
    "c",
)
register(
    "s17_rotated_log",
    lambda v: rotated(_log(v), 100, 50),
    """WITH x AS (SELECT event_id AS "at", event_type FROM events)
       SELECT * FROM x WHERE (SELECT count(*) FROM x) <= 100 OR x."at" IN (SELECT y."at" FROM x AS y ORDER BY y."at" DESC LIMIT 50)""",
)
register(
    "s18_new_files",
    lambda v: sources.new_files(
        v.conversations.select(F.col("conversation_id").alias("path"), F.col("updated_at").alias("modificationTime")),
        v.conversations.filter("account <> '1'").select(F.col("conversation_id").alias("path"), F.when(F.col("is_pinned"), F.col("created_at")).otherwise(F.col("updated_at")).alias("modificationTime")),
    ).select("path", "state"),
    "SELECT conversation_id AS path, CASE WHEN account = '1' THEN 'new' ELSE 'updated' END AS state FROM c WHERE account = '1' OR is_pinned AND updated_at > created_at",
    "c",
)
register(
    "n21_newest_of_prefix",
    lambda v: latest_per(v.conversations.select(F.col("conversation_id").alias("path"), "updated_at", "project_id").filter("project_id is not null"), F.col("project_id"), "updated_at").select("project_id", "path"),
    "SELECT project_id, conversation_id AS path FROM c WHERE project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, conversation_id DESC) = 1",
    "c",
)

# --- N3 to N5: logs of agents ---------------------------------------------------------------------------


def _log_lines(v: Views, *values: Column) -> DataFrame:
    """(path, file, parent_file, line_no, doc): a session for each conversation, some lines a turn."""
    line = F.posexplode(F.array(*values)).alias("at", "value")
    rows = v.table("conversations").select(F.col("conv_id").cast("string").alias("file"), "turn", line)
    return rows.select(F.concat(F.lit("/logs/"), "file").alias("path"), "file", F.lit(None).cast("string").alias("parent_file"), (F.col("turn") * 10 + F.col("at")).cast("long").alias("line_no"), F.parse_json("value").alias("doc"))


def _claude_code(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of both sides, each written twice; some of the assistant's hold a call alone, some of the user's a result alone."""
    stamp = R.stamp
    asked = _json(type='"user"', uuid=_quoted(R.id), timestamp=stamp, cwd='"/w"', slug='"s"', message=_json(content=F.when(R.turn % 2 == 0, R.text).otherwise(_list(F.array(_json(type='"text"', text=R.text), F.lit('{"type":"image"}'))))))
    call = _json(type='"tool_use"', id=F.when(R.turn == 3, "null").otherwise(_quoted(F.concat(F.lit("t"), R.id))), name='"Bash"', input=_json(command=js(R.role)))
    blocks = F.when(R.turn % 3 == 0, F.array(call)).otherwise(F.array(_json(type='"thinking"', thinking='"h"'), _json(type='"text"', text=R.text), call))
    said = _json(type='"assistant"', uuid=_quoted(R.id), timestamp=stamp, message=_json(model='"m"', content=_list(blocks), usage=_json(input_tokens=R.turn.cast("string"), output_tokens=F.lit("5"))))
    result = _json(type='"user"', uuid=_quoted(F.concat(R.id, F.lit("r"))), timestamp=stamp, message=_json(content=_list(F.array(_json(type='"tool_result"', tool_use_id=_quoted(F.concat(F.lit("t"), R.id)), is_error=F.when(R.turn % 2 == 0, "true").otherwise("false"), content='"out"')))))
    first = F.when(R.role == "assistant", said).otherwise(asked)
    return normalize.claude_code_sessions(_log_lines(v, first, F.when(R.role == "assistant", result).otherwise(F.lit('{"type":"other"}')), first))


register(
    "n03_agent_messages",
    lambda v: _claude_code(v)[1].select("message_id", "conversation_id", "sequence", "role", "content", "content_types", "thinking", "model", "token_count"),
    f"""SELECT {_NODE} AS message_id, {_C}, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role,
        CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN '' ELSE text END AS content,
        CASE WHEN role = 'assistant' THEN CASE WHEN turn % 3 = 0 THEN 'tool_use' ELSE 'text,thinking,tool_use' END WHEN turn % 2 = 0 THEN 'text' ELSE 'image,text' END AS content_types,
        CASE WHEN role = 'assistant' AND turn % 3 > 0 THEN 'h' END AS thinking, CASE WHEN role = 'assistant' THEN 'm' END AS model, CASE WHEN role = 'assistant' THEN turn + 5 END AS token_count FROM conversations""",
)
register(
    "n03_agent_events",
    lambda v: _claude_code(v)[2].select("event_id", "conversation_id", "message_id", "event_type", "tool_name", "command", "success"),
    f"""SELECT CASE WHEN turn = 3 THEN conv_id || '_tool_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) ELSE 't' || {_NODE} END AS event_id, {_C}, {_NODE} AS message_id, 'tool_call' AS event_type, 'Bash' AS tool_name,
        'assistant' AS command, CASE WHEN turn <> 3 THEN turn % 2 <> 0 END AS success FROM conversations WHERE role = 'assistant'""",
)
register(
    "n03_agent_sessions",
    lambda v: _claude_code(v)[0].select("conversation_id", "message_count", "project", "title", "model", "mode", "interaction_type", F.unix_timestamp("updated_at").alias("ended")),
    f"""SELECT {_C}, count(*) AS message_count, CASE WHEN bool_or(role <> 'assistant') THEN '/w' END AS project, CASE WHEN bool_or(role <> 'assistant') THEN 's' END AS title, CAST(NULL AS VARCHAR) AS model, 'cli' AS mode,
        'human_ai' AS interaction_type, max(turn) + 1700000000 AS ended FROM conversations GROUP BY conv_id""",
)


def _codex(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions named by their meta line; a thought before anything is said, two before each answer, one after some."""
    stamp = R.stamp
    line = lambda kind, **payload: _json(type=f'"{kind}"', timestamp=stamp, payload=_json(**payload))
    agent = R.role == "assistant"
    thought = lambda what, where: F.when(where, line("event_msg", type='"agent_reasoning"', text=js(F.concat(R.id, F.lit(what))))).otherwise("{}")
    said = F.when(agent, line("event_msg", type='"agent_message"', message=R.text)).otherwise(line("event_msg", type='"user_message"', message=R.text))
    return normalize.codex_sessions(
        _log_lines(
            v, F.when(R.turn == 0, line("session_meta", id=_quoted(F.concat(F.lit("s"), R.conv)), cwd='"/w"')).otherwise("{}"), F.when(R.turn > 0, line("turn_context", model=_quoted(F.concat(F.lit("m"), R.turn.cast("string"))))).otherwise("{}"),
            thought("a", agent | (R.turn == 0)), thought("b", agent), said, thought("c", agent & (R.turn % 4 == 3)),
            line("response_item", type='"function_call"', call_id=_quoted(R.id), name='"shell"', arguments=js(F.when(R.turn % 2 == 0, '{"cmd":"ls","file_path":"f"}').otherwise("{}"))),
            F.when(R.turn == 5, "{}").otherwise(line("event_msg", type='"exec_command_end"', call_id=_quoted(R.id), exit_code=(R.turn % 2).cast("string"), command='"end"', duration=_json(secs=R.turn.cast("string"), nanos=F.lit("5000000")))),
        )
    )


register(
    "n04_agent_messages",
    lambda v: _codex(v)[1].select("message_id", "conversation_id", "sequence", "role", "content", "thinking", "model", "content_types"),
    # A late thought (c), before a user line or the end, takes the place of the answer's own ones; the first thought of all waits for the first answer.
    f"""WITH x AS (SELECT *, role = 'assistant' AS agent, row_number() OVER w AS seq, sum(CAST(role = 'assistant' AS INTEGER)) OVER w AS agents, max(turn) OVER (PARTITION BY conv_id) > 0 AS has_model
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        y AS (SELECT *, CASE WHEN agent AND turn % 4 = 3 THEN {_NODE} || 'c' WHEN agent THEN CASE WHEN agents = 1 THEN conv_id || '_0a' || chr(10) || chr(10) ELSE '' END || {_NODE} || 'a' || chr(10) || chr(10) || {_NODE} || 'b' END AS thinking FROM x)
        SELECT 's' || conv_id || '_' || seq AS message_id, 's' || conv_id AS conversation_id, seq AS sequence, CASE WHEN agent THEN role ELSE 'user' END AS role, text AS content, thinking, CASE WHEN agent AND has_model THEN 'm1' END AS model,
            CASE WHEN agent THEN 'thinking,text' ELSE 'text' END AS content_types FROM y""",
)
register(
    "n04_agent_events",
    lambda v: _codex(v)[2].select("conversation_id", "event_id", "message_id", "event_type", "tool_name", "command", "file_path", "duration_ms", "success"),
    f"""SELECT 's' || conv_id AS conversation_id, {_NODE} AS event_id, 's' || conv_id || '_tool_' || {_NODE} AS message_id, 'tool_call' AS event_type, 'shell' AS tool_name, CASE WHEN turn % 2 = 0 THEN 'ls' WHEN turn <> 5 THEN 'end' END AS command,
        CASE WHEN turn % 2 = 0 THEN 'f' END AS file_path, CASE WHEN turn <> 5 THEN turn * 1000 + 5 END AS duration_ms, CASE WHEN turn <> 5 THEN turn % 2 = 0 END AS success FROM conversations""",
)
register(
    "n04_agent_sessions",
    lambda v: _codex(v)[0].select("conversation_id", "message_count", "project", "model", "mode", F.unix_timestamp("created_at").alias("began"), F.unix_timestamp("updated_at").alias("ended")),
    """SELECT 's' || conv_id AS conversation_id, count(*) AS message_count, '/w' AS project, CASE WHEN max(turn) > 0 THEN 'm1' END AS model, 'cli' AS mode, min(turn) + 1700000000 AS began, max(turn) + 1700000000 AS ended
       FROM conversations GROUP BY conv_id""",
)


def _gemini_cli(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two snapshots of each session; the first lacks the last turns. Answers have thoughts and calls."""
    agent = R.role == "assistant"
    calls = F.when(agent, _list(F.array(_json(id=F.when(R.turn % 4 == 1, _quoted(F.concat(F.lit("t"), R.id))).otherwise("null"), name='"read"', args=F.when(R.turn % 4 == 1, '{"file_path":"f"}').otherwise('{"dir_path":"d","command":"c"}'), status=F.when(R.turn == 3, '"error"').otherwise('"success"'), extra="1")))).otherwise("[]")
    content = F.when(R.turn % 2 == 0, R.text).otherwise(_list(F.array(_json(text=R.text), F.lit('{"text":"more"}'))))
    one = _json(
        id=_quoted(R.id), type=F.when(agent, '"gemini"').when(R.role == "user", '"user"').otherwise('"info"'), content=content, timestamp=R.stamp, model=F.when(agent, '"g"').otherwise("null"), toolCalls=calls,
        thoughts=F.when(R.turn % 4 == 3, '[{"subject":"s","description":"d"},{"subject":"none"}]').otherwise("null"), tokens=F.when(agent, _json(total=R.turn.cast("string"))).otherwise("null"),
    )
    whole = _turns(v, one)
    doc = lambda t, end: F.parse_json(_json(sessionId=js(F.col("id")), startTime='"2024-01-02T00:00:00Z"', lastUpdated=f'"2024-01-0{end}T00:00:00Z"', messages=_list(t)))
    early = whole.select(F.concat("id", F.lit("-1.json")).alias("file_name"), doc(F.expr("slice(turns, 1, 2)"), 3).alias("doc"))
    return normalize.gemini_cli_sessions(early.unionByName(whole.select(F.concat("id", F.lit("-2.json")).alias("file_name"), doc(F.col("turns"), 4).alias("doc"))))


register(
    "n05_agent_messages",
    lambda v: _gemini_cli(v)[1].select("message_id", "conversation_id", "sequence", "role", "content", "content_types", "thinking", "token_count"),
    f"""SELECT {_NODE} AS message_id, {_C}, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence, role, text || CASE WHEN turn % 2 = 1 THEN chr(10) || chr(10) || 'more' ELSE '' END AS content,
        concat_ws(',', CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'thinking' END, 'text', CASE WHEN role = 'assistant' THEN 'tool_use' END) AS content_types,
        CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN '**s**: d' END AS thinking, CASE WHEN role = 'assistant' THEN turn END AS token_count FROM conversations WHERE {_PEOPLE}""",
)
register(
    "n05_agent_events",
    lambda v: _gemini_cli(v)[2].select("event_id", "conversation_id", "message_id", "event_type", "tool_name", "file_path", "command", "success", "metadata_json"),
    f"""SELECT CASE WHEN turn % 4 = 1 THEN 't' || {_NODE} ELSE {_NODE} || '_tool_0' END AS event_id, {_C}, {_NODE} AS message_id, 'tool_call' AS event_type, 'read' AS tool_name, CASE WHEN turn % 4 = 1 THEN 'f' ELSE 'd' END AS file_path,
        CASE WHEN turn % 4 <> 1 THEN 'c' END AS command, turn <> 3 AS success, '{{"extra":1}}' AS metadata_json FROM conversations WHERE role = 'assistant'""",
)
register(
    "n05_agent_sessions",
    lambda v: _gemini_cli(v)[0].select("conversation_id", "message_count", "model", F.date_format("created_at", "yyyy-MM-dd").alias("began"), F.date_format("updated_at", "yyyy-MM-dd").alias("ended")),
    f"""SELECT {_C}, count(*) AS message_count, CASE WHEN bool_or(role = 'assistant') THEN 'g' END AS model, '2024-01-02' AS began, '2024-01-04' AS ended FROM conversations WHERE {_PEOPLE} GROUP BY conv_id""",
)

# --- N14 to N18: saves and memories --------------------------------------------------------------------


def _files(v: Views, text: Column, key: Column, name: Column) -> DataFrame:
    """(path, file_name, modified, content): one text for each group of turns."""
    rows = v.table("conversations").select(key.alias("key"), name.alias("file_name"), "turn", text.alias("x"))
    return rows.groupBy("key", "file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda t: t["x"]), "\n").alias("content")).select(
        F.concat(F.lit("/saves/"), "key", F.lit("/"), "file_name").alias("path"), "file_name", F.lit(None).cast("timestamp").alias("modified"), "content"
    )


_SQL_LINE = r"regexp_replace(trim(text), '\s+', ' ', 'g')"
def _clips(v: Views) -> tuple[DataFrame, DataFrame]:
    head = F.when(R.turn == 0, F.concat(F.lit('---\nsource: "https://x.org/c/id'), R.conv, F.lit('"\nauthor: Claude\ntitle: "T"\n---\n'))).otherwise("")
    return normalize.clipped_notes(_files(v, F.concat(head, F.when(R.role == "user", "> ").otherwise(""), R.line), R.conv, F.lit("2024-01-01 note.md")))


register(
    "n14_clipped_notes",
    lambda v: _clips(v)[0].select("conversation_id", "source", "title", "capture_method"),
    """SELECT 'id' || conv_id AS conversation_id, 'claude_ai' AS source, 'T' AS title, 'manual_clipping_obsidian' AS capture_method FROM conversations GROUP BY conv_id""",
)
register(
    "n14_clipped_turns",
    lambda v: _clips(v)[1].select("conversation_id", "sequence", "role", "content"),
    f"""WITH x AS (SELECT conv_id, turn, role = 'user' AS u, {_SQL_LINE} AS line FROM conversations), g AS (SELECT *, CASE WHEN u IS DISTINCT FROM lag(u) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM x),
        k AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM g)
        SELECT 'id' || conv_id AS conversation_id, CAST(k AS BIGINT) AS sequence, CASE WHEN u THEN 'user' ELSE 'assistant' END AS role, string_agg(line, chr(10) ORDER BY turn) AS content FROM k GROUP BY conv_id, k, u""",
)
register(
    "n15_pasted_chats",
    lambda v: normalize.pasted_chats(
        _files(v, F.concat(F.when(R.role == "user", "--- USER ---\n").otherwise("--- ASSISTANT ---\n"), R.line), R.conv, pick(F.col("conv_id"), "Grok chat.txt", "claude.txt", "notes.txt"))
    )[1].select("source", "sequence", "role", "content"),
    f"""SELECT {sql_pick('conv_id', 'grok', 'claude_ai', 'chatgpt')} AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence, CASE WHEN role = 'user' THEN role ELSE 'assistant' END AS role, {_SQL_LINE} AS content FROM conversations""",
)
def _terminals(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    return normalize.terminal_transcripts(_files(v, F.when(R.role == "user", F.concat(F.lit("> "), R.line)).otherwise(F.concat(F.lit("⏺ Read(f"), R.turn.cast("string"), F.lit(")"))), R.conv, F.lit("t.txt")))


register(
    "n16_terminal_events",
    lambda v: _terminals(v)[2].select("tool_name", "file_path", "event_type", "source"),
    "SELECT 'Read' AS tool_name, 'f' || turn AS file_path, 'read' AS event_type, 'claude_code' AS source FROM conversations WHERE role <> 'user'",
)
register(
    "n16_terminal_turns",
    lambda v: _terminals(v)[1].select("sequence", "role", "content"),
    f"""SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence, CASE WHEN role = 'user' THEN role ELSE 'assistant' END AS role, CASE WHEN role = 'user' THEN {_SQL_LINE} ELSE 'Read(f' || turn || ')' END AS content FROM conversations""",
)
register(
    "n18_memories",
    lambda v: normalize.agent_memories(
        v.table("conversations").select(
            F.concat(F.lit("/p"), R.conv, F.lit("/memory/"), R.turn.cast("string"), F.lit(".md")).alias("path"), F.when(R.turn == 0, "MEMORY.md").otherwise(F.concat(R.turn.cast("string"), F.lit(".md"))).alias("file_name"), F.lit(None).cast("timestamp").alias("modified"),
            F.concat(F.lit("---\nname: n\ntype: "), pick(R.turn, "user", "odd", "project"), F.lit("\n---\n"), F.col("text")).alias("content"),
        ),
        "claude_code", v.table("conversations").filter("turn % 2 = 0").select(F.concat(F.lit("/p"), R.conv, F.lit("/memory/"), R.turn.cast("string"), F.lit(".md")).alias("path")),
    ).select("memory_id", "kind", "content", "content_size", "is_preserved_missing"),
    f"""SELECT 'claude_code:p' || conv_id || ':' || CASE WHEN turn = 0 THEN 'MEMORY.md' ELSE turn || '.md' END AS memory_id, CASE WHEN turn = 0 THEN 'index' ELSE {sql_pick('turn', 'user', 'other', 'project')} END AS kind, text AS content,
        CAST(octet_length(encode(text)) + 23 + length({sql_pick('turn', 'user', 'odd', 'project')}) AS BIGINT) AS content_size, turn % 2 <> 0 AS is_preserved_missing FROM conversations""",
)

# --- ST: streams ------------------------------------------------------------------------------------------


def _streamed(v: Views, df: DataFrame, plan, what: str) -> DataFrame:
    """What ``plan`` makes of ``df`` read as a stream that ends with what is there."""
    spark, out = v.spark, scratch(v.spark, f"{what}-out")
    source = spark.readStream.schema(df.schema).parquet(_written(df, what, kind="parquet"))
    writer = plan(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{what}-state")).outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _appended(rows: DataFrame, folder: str) -> None:
    """Add ``value`` to the file that ``part`` names, in the order of ``at``, as a process that writes a log does."""

    def write(batches):
        for batch in batches:
            for part, own in batch.groupby("part", sort=False):
                fs, path = pa.fs.FileSystem.from_uri(folder)
                fs.create_dir(path)
                with fs.open_append_stream(f"{path}/{part}.jsonl") as out:
                    out.write("".join(own["value"]).encode())
                yield own[["part"]].head(1)

    dealt = rows.select("part", "at", "value").repartition("part").sortWithinPartitions("part", "at")
    dealt.mapInPandas(write, "part long").write.format("noop").mode("overwrite").save()


def _log_stream(v: Views) -> DataFrame:
    """Logs that grow between two runs of one stream; the first run ends within a line of each file."""
    spark, out, path = v.spark, scratch(v.spark, "logs-out"), scratch(v.spark, "logs")
    checkpoint = scratch(spark, "logs-state")
    n, part = F.col("event_id"), F.col("user_id") % 8
    whole = F.concat(_json(kind=_quoted(F.col("event_type")), n=n.cast("string")), F.lit("\n"))
    rows = v.table("events").select(part.alias("part"), (2 * n).alias("at"), whole.alias("value"), (n % 2 == 0).alias("early"))
    parts = rows.select("part").distinct()
    for early, order, half in ((True, 2**62, '{"kind":"cut",'), (False, -1, '"n":0}\n')):
        rest = parts.select("part", F.lit(order).alias("at"), F.lit(half).alias("value"))
        _appended(rows.filter(F.col("early") == early).select("part", "at", "value").unionByName(rest), path)
        lines = streaming.growing_logs(spark, path, f"{checkpoint}/tail", split_bytes=20_000).select("path", "start", "doc")
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema("path string, start long, doc variant").parquet(out)
    kind, number = F.try_variant_get("doc", "$.kind", "string"), F.try_variant_get("doc", "$.n", "long")
    return read.groupBy(F.regexp_extract("path", "([0-9]+)[.]jsonl$", 1).alias("part"), kind.alias("kind")).agg(
        F.count("*").alias("n"), F.count_distinct("start").alias("places"), F.sum(number).alias("total")
    )


register(
    "st1_growing_logs",
    _log_stream,
    """WITH x AS (SELECT user_id % 8 AS part, event_type AS kind, event_id AS n FROM events), y AS (SELECT * FROM x UNION ALL SELECT DISTINCT part, 'cut', 0 FROM x)
       SELECT CAST(part AS VARCHAR) AS part, kind, count(*) AS n, count(*) AS places, CAST(sum(n) AS BIGINT) AS total FROM y GROUP BY 1, 2""",
)
register(
    "st2_replayed_once",
    lambda v: _streamed(
        v, v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), lambda s: streaming.once(s, ["event_id"], "ts", "100 days"), "replay"
    ).select("event_id"),
    "SELECT event_id FROM events",
)
def _fed(v: Views, parts: list[DataFrame], plan, what: str) -> DataFrame:
    """What ``plan`` makes of a stream that gets ``parts`` one after the other, each in a run of its own that goes on from the last one's checkpoint."""
    spark, out, path, checkpoint = v.spark, scratch(v.spark, f"{what}-out"), scratch(v.spark, what), scratch(v.spark, f"{what}-state")
    for part in parts:
        part.write.mode("append").parquet(path)
        writer = plan(spark.readStream.schema(part.schema).parquet(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


register(
    "st3_calls_with_results",
    lambda v: _calls(v),
    """WITH x AS (SELECT event_id AS n, ts FROM events), last AS (SELECT max(ts) AS m FROM x),
            y AS (SELECT n, CASE WHEN n % 3 = 2 OR n % 5 = 1 THEN 'open' WHEN n % 3 = 0 THEN 'matched' ELSE 'failed' END AS outcome FROM x
                  UNION ALL SELECT n, 'late' FROM x WHERE n % 3 <> 2 AND n % 5 = 1)
       SELECT outcome, count(*) AS n, CAST(sum(n) AS BIGINT) AS ids FROM y GROUP BY 1""",
)


def _calls(v: Views) -> DataFrame:
    """Calls with a result in time or three hours later; a call and a result of days later end the stream, so that none waits."""
    spark, n = v.spark, F.col("event_id")
    at = F.col("ts").cast("timestamp")
    calls = v.table("events").select(F.lit("s").alias("session"), n.cast("string").alias("call_id"), at.alias("called_at"))
    late = at + F.when(n % 5 == 1, F.expr("interval 3 hours")).otherwise(F.expr("interval 10 minutes"))
    results = v.table("events").filter(n % 3 != 2).select(F.lit("s").alias("session"), n.cast("string").alias("call_id"), late.alias("result_at"), (n % 3 != 0).alias("is_error"))
    end = v.table("events").agg((F.max(at) + F.expr("interval 30 days")).alias("t"))
    ends = {"calls": end.select(F.lit("end").alias("session"), F.lit("-1").alias("call_id"), F.col("t").alias("called_at")), "results": end.select(F.lit("end").alias("session"), F.lit("-2").alias("call_id"), F.col("t").alias("result_at"), F.lit(False).alias("is_error"))}
    paths = {k: scratch(spark, k) for k in ends}
    plans = {"calls-join": streaming.calls_with_results, "calls-late": streaming.late_results}
    places = {k: (scratch(spark, f"{k}-out"), scratch(spark, f"{k}-state")) for k in plans}
    for own in ({"calls": calls, "results": results}, ends):
        for k, df in own.items():
            df.write.mode("append").parquet(paths[k])
        for k, plan in plans.items():
            c, r = (spark.readStream.schema(df.schema).parquet(paths[name]) for name, df in ends.items())
            plan(c, r).writeStream.format("parquet").option("path", places[k][0]).option("checkpointLocation", places[k][1]).trigger(availableNow=True).start().awaitTermination()
    joined = spark.read.parquet(places["calls-join"][0]).filter("call_id <> '-1'").select("call_id", F.when(F.col("success").isNull(), "open").when(F.col("success"), "matched").otherwise("failed").alias("outcome"))
    both = joined.unionByName(spark.read.parquet(places["calls-late"][0]).select("call_id", F.lit("late").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.col("call_id").cast("long")).alias("ids"))


def _folded(v: Views) -> DataFrame:
    """Orders in two runs of one stream: all of them, then a partial snapshot of some that changed, each twice."""
    spark, path = v.spark, scratch(v.spark, "archive")
    rows = v.conversations.select("conversation_id", F.col("message_count").alias("t"), F.col("model").alias("title"))
    some = rows.filter("cast(conversation_id as long) % 3 = 0")
    some = some.withColumn("t", F.col("t") + F.col("t") % 2).unionByName(some.withColumn("t", F.lit(-1).cast(rows.schema["t"].dataType)))
    archive = streaming.BucketedArchive(spark, path, ["conversation_id"], buckets=8)
    merge = streaming.merge_into_archive(archive, reconcile.later("t"), lambda k: f"d{k}", ["t"])
    feed, checkpoint = scratch(spark, "archive-feed"), scratch(spark, "archive-state")
    for part in (rows, some):
        part.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(part.schema).parquet(feed)
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return archive.read().select("conversation_id", "t", F.col(reconcile.SEEN).alias("seen"), F.col(reconcile.GONE).alias("gone"))


register(
    "st4_folded_archive",
    _folded,
    """SELECT conversation_id, CASE WHEN CAST(conversation_id AS BIGINT) % 3 = 0 THEN message_count + message_count % 2 ELSE message_count END AS t,
       CASE WHEN CAST(conversation_id AS BIGINT) % 3 = 0 THEN 'd1' ELSE 'd0' END AS seen, false AS gone FROM c""",
    "c",
)


def _alerts(v: Views) -> DataFrame:
    """A run a day and platform, every fourth a refetch; they come in three batches out of order, then one that ends the stream."""
    day = F.date_trunc("day", "ts").cast("timestamp")
    n = F.datediff(day, F.lit("2020-01-01"))
    runs = v.table("events").groupBy(F.col("event_type").alias("platform"), F.lit("a").alias("account"), day.alias("started_at")).agg(F.sum(F.col("event_id") % 50).alias("discovery_total"))
    runs = runs.withColumn("n", F.datediff("started_at", F.lit("2020-01-01"))).withColumn("mode", F.when(F.col("n") % 8 == 3, "refetch_known").when(F.col("n") % 8 == 7, "refetch_known_fallback").when(F.col("n") % 8 == 5, "refetch").otherwise("full"))
    parts = [runs.filter(F.pmod(F.xxhash64("started_at", "platform"), F.lit(3)) == k).drop("n") for k in range(3)]
    end = runs.groupBy("platform", "account").agg((F.max("started_at") + F.expr("interval 10000 days")).alias("started_at"), F.lit(1).cast("long").alias("discovery_total"), F.lit("full").alias("mode"))
    return _fed(v, [*parts, end], lambda s: streaming.discovery_alerts(s, delay="4000 days"), "runs")


register(
    "st5_discovery_alerts",
    lambda v: _alerts(v).select("platform", F.date_format("started_at", "yyyy-MM-dd").alias("day"), "discovery_total", "largest", "dropped"),
    """WITH d AS (SELECT event_type AS platform, date_trunc('day', ts) AS t, CAST(sum(event_id % 50) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING sum(event_id % 50) > 0 AND date_diff('day', DATE '2020-01-01', CAST(date_trunc('day', ts) AS DATE)) % 4 <> 3),
            x AS (SELECT *, max(n) OVER (PARTITION BY platform ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
       SELECT platform, strftime(t, '%Y-%m-%d') AS day, n AS discovery_total, greatest(n, coalesce(before, 0)) AS largest, coalesce(n < greatest(n, before) * 0.8, false) AS dropped FROM x""",
)


def _in_batches(v: Views, plan, what: str) -> DataFrame:
    """Events in three batches by time, with every 40th of the first and second third a batch late; one of years later ends the stream."""
    events = v.table("events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.col("event_type"), (F.col("user_id") % 20).cast("string")).alias("who"), F.col("event_id").alias("n"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    third = F.floor((F.unix_micros("ts") - F.lit(_micros(first))) * 3 / (F.lit(_micros(last)) - F.lit(_micros(first)) + 1)) + F.when(F.col("n") % 40 == 0, 1).otherwise(0)
    batches = [events.filter(F.least(third, F.lit(2)) == k) for k in range(3)]
    end = events.agg((F.max("ts") + F.expr("interval 3000 days")).alias("ts"), F.lit("end").alias("who"), F.lit(-1).cast("long").alias("n"))
    return _fed(v, [*batches, end, end], plan, what).filter("who <> 'end'")


def _micros(t) -> int:
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000 + 0.5)


#: Rows that the watermark, a day behind the newest row of the batches before, lets through: those of a span that ends after it.
_ON_TIME = """b AS (SELECT ts, event_type || (user_id % 20) AS who, event_id AS n,
        least(CAST(floor(CAST(epoch_us(ts) - min(epoch_us(ts)) OVER () AS DOUBLE) * 3 / (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1)) AS BIGINT) + CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END, 2) AS batch FROM events),
    mark AS (SELECT batch, max(ts) AS newest FROM b GROUP BY 1), on_time AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM mark WHERE mark.batch < b.batch AND {end} <= mark.newest - INTERVAL 1 DAY))"""
_SIX_HOURS = "time_bucket(INTERVAL 6 HOUR, b.ts, TIMESTAMP '1970-01-01')"
register(
    "st6_streamed_counts",
    lambda v: _in_batches(v, lambda s: streaming.windowed_counts(s, "ts", F.col("who"), "6 hours").withColumnRenamed("key", "who"), "windows").select("start", "who", "n"),
    f"WITH {_ON_TIME.format(end=_SIX_HOURS + ' + INTERVAL 6 HOUR')} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, who, count(*) AS n FROM on_time GROUP BY 1, 2",
)
register(
    "st6_streamed_sessions",
    lambda v: _in_batches(v, lambda s: streaming.activity_sessions(s, "ts", "who", "12 hours"), "sessions").select("start", "end", "who", "n"),
    f"""WITH {_ON_TIME.format(end='b.ts + INTERVAL 12 HOUR')}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY who ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM on_time),
        s AS (SELECT *, sum(new) OVER (PARTITION BY who ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", who, count(*) AS n FROM s GROUP BY who, k""",
)
