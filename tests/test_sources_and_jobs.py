import json

import pytest
from pyspark.sql import functions as F

from tessera import functions as X
from tessera import sources, streaming
from tessera.operators import graph, reconcile
from tessera.plans import monitor, normalize


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(frame, column, **row):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}
    df = frame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))
    return df.select(column).first()[0]


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


# --- functions ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("value", "want"),
    [("1700000000", "2023-11-14 22:13:20"), ("1.7e9", "2023-11-14 22:13:20"), ("2025-01-02T03:04:05Z", "2025-01-02 03:04:05"),
     ("2025-01-02T03:04:05", "2025-01-02 03:04:05"), ("NaN", None), ("junk", None), (None, None)],
)
def test_to_ts(frame, value, want):
    got = one(frame, F.date_format(X.to_ts(F.col("x")), "yyyy-MM-dd HH:mm:ss"), x=value)
    assert got == want


def test_small_functions(frame):
    assert one(frame, X.word_count(F.col("x")), x=" a  b\nc ") == 3
    assert one(frame, X.word_count(F.col("x")), x="") == 0
    assert one(frame, X.tool_category(F.col("x")), x="canmore.create") == "canvas"
    assert one(frame, X.tool_category(F.col("x")), x="web.run") == "search"
    assert one(frame, X.tool_event_type(F.col("x"), F.lit(True)), x="update_list") == "mcp_search"
    assert one(frame, X.tool_event_type(F.col("x"), F.lit(False)), x="bash") == "code"
    assert one(frame, X.hidden_reason(F.lit(None).cast("boolean"), F.lit(0.0), F.col("x")), x="all") == "weight_zero"
    assert one(frame, X.hidden_reason(F.lit(False), F.lit(1.0), F.col("x")), x="python") == "internal_recipient"
    assert one(frame, X.asset_id(F.col("x")), x="sediment://file_1") == "file_1"
    assert one(frame, X.is_external(F.col("x"), ("x.org",)), x="https://a.x.org/b") is False
    assert one(frame, X.is_external(F.col("x"), ("x.org",)), x="https://ax.org/b") is True
    assert one(frame, X.fmt_bytes(F.col("x")), x=1536) == "1.5 KB"
    assert one(frame, X.fmt_pct(F.col("x"), F.lit(4)), x=1) == "1 (25.0%)"
    assert one(frame, X.slug(F.col("x")), x=" A b/C! ") == "a-b-c"
    assert one(frame, X.scenario_mode(F.col("x")), x="deep_research_search") == "research"
    assert one(frame, monitor.truthy(F.col("x"), F.lit(7)), x=0) == 7


@pytest.mark.parametrize("x", [0.25, 0.35, 0.75, 12.45, 99.95, 1e-9, 0.05, 2145.75, -0.25, 7.0])
def test_one_decimal_is_that_of_printf(frame, x):
    assert one(frame, X.one_decimal(F.col("x")), x=x) == f"{x:.1f}"


def test_formats_of_large_numbers(frame):
    sizes = {0: "0 B", 1023: "1023 B", 1 << 20: "1.0 MB", 2_250_000_000: "2145.8 MB", 1 << 50: "1073741824.0 MB"}
    assert {n: one(frame, X.fmt_bytes(F.col("x"), largest="MB"), x=n) for n in sizes} == sizes
    assert one(frame, X.fmt_bytes(F.col("x")), x=2_250_000_000) == "2.1 GB"
    assert one(frame, X.fmt_pct(F.col("x"), F.lit(400)), x=1) == "1 (0.2%)"  # 0.25 exactly


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ({"content_type": "text", "parts": ["a", "", "b"]}, "a\n\nb"),
        ({"content_type": "code", "text": "x=1"}, "x=1"),
        ({"content_type": "thoughts", "thoughts": [{"summary": "s", "content": "c"}, {"content": "d"}]}, "**s**\n\nc\n\nd"),
        ({"content_type": "multimodal_text", "parts": [{"content_type": "image_asset_pointer", "metadata": {"dalle": {"prompt": " p "}}}, "t"]}, "[imagem gerada: p]\n\nt"),
        ({"content_type": "multimodal_text", "parts": [{"content_type": "audio_transcription", "text": "said"}]}, "said"),
        ({}, ""),
    ],
)
def test_content_text(frame, content, want):
    assert one(frame, X.content_text(F.parse_json("x")), x=json.dumps(content)) == want


# --- sources -----------------------------------------------------------------------------------


def test_parts_are_found_and_unified(spark, tmp_path):
    spark.createDataFrame([("c1", "chatgpt", "old")], "conversation_id string, source string, title string").coalesce(1).write.parquet(str(tmp_path / "w1"))
    spark.createDataFrame([("c1", "new", 1)], "conversation_id string, title string, extra int").coalesce(1).write.parquet(str(tmp_path / "w2"))
    folder = tmp_path / "processed"
    folder.mkdir()
    for k, name in ((1, "chatgpt_conversations"), (2, "chatgpt_manual_conversations")):
        next((tmp_path / f"w{k}").glob("part-*.parquet")).rename(folder / f"{name}.parquet")
    (folder / "x_source_guides.parquet").write_bytes((folder / "chatgpt_conversations.parquet").read_bytes())
    (folder / "junk.parquet").write_bytes((folder / "chatgpt_conversations.parquet").read_bytes())
    found = values(sources.discover_parts(spark, str(folder)), "file_name", "table_name", "source")
    assert found == [
        ("chatgpt_conversations.parquet", "conversations", "chatgpt"), ("chatgpt_manual_conversations.parquet", "conversations", "chatgpt"),
        ("junk.parquet", None, None), ("x_source_guides.parquet", "source_guides", "x"),
    ]
    paths = [f"{folder}/chatgpt_conversations.parquet", f"{folder}/chatgpt_manual_conversations.parquet"]
    assert values(sources.unify(spark, "conversations", paths), "source", "conversation_id", "title", "extra") == [("chatgpt", "c1", "new", 1)]
    counts = sources.register_views(spark, str(folder), "chatgpt", ["conversations", "messages"])
    assert counts == {"conversations": {"extractor": 1, "manual": 1}} and spark.table("conversations").count() == 2


def test_unified_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "codex"), ("b", "qwen"), ("c", "notebooklm")], "conversation_id string, source string")
    assert sources.write_table(rows, str(tmp_path), "conversations")
    assert values(sources.read_table(spark, str(tmp_path), "conversations", "cli"), "conversation_id") == [("a",)]
    assert sources.read_table(spark, str(tmp_path), "conversations").count() == 3
    assert not sources.write_table(rows.limit(0), str(tmp_path), "messages", keep_empty=False)


def test_documents_and_rejects(spark, tmp_path):
    write(tmp_path / "d" / "account-2" / "a.json", {"id": "a"})
    write(tmp_path / "d" / "b.json", "{broken")
    docs = sources.json_documents(spark, str(tmp_path / "d"))
    assert sources.rejected(docs).count() == 1
    named = sources.with_account(docs.filter("doc is not null").withColumn("id", F.try_variant_get("doc", "$.id", "string")), "id")
    assert values(named, "id", "account") == [("account-2_a", "2")]
    write(tmp_path / "m" / "raw.json", {"conversations": {"x": {"title": "t"}, "y": {"title": "u"}}})
    assert values(sources.json_map(spark, str(tmp_path / "m")), "id") == [("x",), ("y",)]


@pytest.mark.parametrize("text", ["{broken", '{"conversations": {"x": {"a": 1}', '{"conversations": {"x": {}}} {"conversations": {"y": {}}}', '{"conversations": [1]}'])
def test_json_map_raises_where_a_text_does_not_parse(spark, tmp_path, text):
    write(tmp_path / "m" / "raw.json", text)
    with pytest.raises(Exception, match="MALFORMED|VARIANT|JSON"):
        sources.json_map(spark, str(tmp_path / "m")).collect()


def test_json_map_keeps_documents_of_every_kind(spark, tmp_path):
    docs = {"x": {"t": ["ü\n", 1.50, None]}, "y": "text", "z": None, "": 7, "w": {}}
    write(tmp_path / "m" / "raw.json", {"other": {"q": {}}, "conversations": docs})
    write(tmp_path / "m" / "blank.json", " \n")
    got = sources.json_map(spark, str(tmp_path / "m")).select("id", F.to_json("doc").alias("doc")).collect()
    assert {r["id"]: json.loads(r["doc"]) for r in got} == docs


def test_json_map_larger_than_a_variant(spark, tmp_path):
    one = '{"title": "' + "x" * 100_000 + '"}'
    write(tmp_path / "m" / "raw.json", '{"conversations": {' + ", ".join(f'"c{k}": {one}' for k in range(1500)) + "}}")
    got = sources.json_map(spark, str(tmp_path / "m"))
    assert got.select("id", F.length(F.try_variant_get("doc", "$.title", "string")).alias("n")).distinct().filter("n = 100000").count() == 1500


def test_new_files(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, modificationTime long")
    taken = spark.createDataFrame([("a", 1), ("b", 1)], "path string, modificationTime long")
    assert values(sources.new_files(listing, taken), "path", "state") == [("b", "updated"), ("c", "new")]


# --- normalisation -----------------------------------------------------------------------------


def docs(spark, **documents):
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "id string, j string")
    return rows.select("id", F.parse_json("j").alias("doc"))


def test_tree_documents(spark):
    def node(k, parent, role, text, **more):
        return {"id": k, "parent": parent, "message": {"author": {"role": role}, "create_time": 1700000000 + int(k[1:]), "content": {"content_type": "text", "parts": [text]}} | more}

    mapping = {
        "n1": node("n1", None, "user", "hi"), "n2": node("n2", "n1", "assistant", "yo", metadata={"model_slug": "m1"}), "n3": node("n3", "n1", "assistant", "alt", weight=0),
        "n4": node("n4", "n2", "tool", "out") | {}, "n5": node("n5", "n2", "user", ""), "n6": node("n6", "lost", "user", "unreachable"), "n7": node("n7", "n6", "user", "too"),
        "n8": node("n8", "n3", "assistant", "later"), "n0": {"id": "n0", "parent": "n8", "message": None},
    }
    for k, x in mapping.items():
        if x["message"]:
            x["message"]["id"] = k
    mapping["n4"]["message"]["author"]["name"] = "python"
    raw = docs(spark, c={"title": "T", "create_time": 1700000000, "gizmo_id": "g-p-1", "mapping": mapping})
    spec = normalize.SPECS["chatgpt"]
    members = graph.branch_members(normalize.tree_nodes(raw, spec))
    named = members.withColumn("branch_id", graph.branch_id(F.col("conversation_id"), F.col("head"), F.col("root")))
    got = normalize.messages(raw, spec, named.select("conversation_id", "node", "branch_id"))
    assert values(got, "sequence", "message_id", "role", "content", "branch_id", "is_hidden") == [
        (1, "n1", "user", "hi", "c_main", False), (2, "n2", "assistant", "yo", "c_n2", False), (3, "n3", "assistant", "alt", "c_n3", True), (4, "n8", "assistant", "later", "c_n3", False),
    ]
    assert values(normalize.messages(raw, spec), "sequence", "message_id", "branch_id") == values(got, "sequence", "message_id", "branch_id")
    assert values(normalize.tool_events(raw, spec), "event_id", "message_id", "event_type", "tool_name", "result") == [("c_evt_1", "n2", "code", "python", "out")]
    convs = normalize.conversations(raw, spec, got)
    assert values(convs, "title", "project_id", "gizmo_id", "model", "message_count") == [("T", "g-p-1", None, "m1", 3)]
    raw = docs(spark, c={"title": "T", "current_node": "n8", "mapping": mapping}, e={"mapping": {}})
    assert values(normalize.conversations(raw, spec, normalize.messages(raw, spec)), "conversation_id", "message_count") == [("c", 1), ("e", 0)]


def test_block_documents(spark):
    raw = docs(spark, c={"name": "N", "created_at": "2025-01-01T00:00:00Z", "is_starred": True, "chat_messages": [
        {"uuid": "a", "sender": "human", "content": [{"type": "text", "text": "q"}]},
        {"uuid": "b", "sender": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "bash", "id": "t", "input": {"x": 1}},
            {"type": "tool_result", "name": "bash", "tool_use_id": "t", "is_error": True, "content": [{"text": "no"}]}, {"type": "text", "text": "A"}]},
        {"uuid": "z", "sender": "robot", "content": []},
    ]})
    spec = normalize.SPECS["claude_ai"]
    got = normalize.messages(raw, spec)
    assert values(got, "sequence", "role", "content", "thinking", "content_types") == [(1, "user", "q", None, "text"), (2, "assistant", "A", "hm", "text,thinking,tool_result,tool_use")]
    assert values(normalize.tool_events(raw, spec), "event_id", "event_type", "success", "result") == [("t", "code_call", None, None), ("t_result", "code_result", False, '[{"text":"no"}]')]
    assert values(normalize.conversations(raw, spec, got), "title", "is_pinned", "message_count") == [("N", True, 2)]


@pytest.mark.parametrize(
    ("source", "doc", "roles"),
    [
        ("qwen", {"data": {"title": "t", "chat_type": "t2i", "archived": "True", "chat": {"history": {"messages": {"a": {"id": "a", "role": "user", "content": "x", "timestamp": 1}, "b": {"id": "b", "role": "assistant", "content_list": [{"content": "y"}], "timestamp": 2}}}}}}, ["user", "assistant"]),
        ("deepseek", {"chat_session": {"title": "t"}, "chat_messages": [{"message_id": 1, "role": "USER", "content": "x"}, {"message_id": 2, "role": "ASSISTANT", "content": "y", "status": "FINISHED"}]}, ["user", "assistant"]),
        ("perplexity", {"entries": [{"uuid": "e", "query_str": "x", "mode": "COPILOT", "blocks": [{"answer": "y"}]}]}, ["user", "assistant"]),
        ("grok", {"conversation_v2": {"conversation": {"title": "t"}}, "responses": {"responses": [{"responseId": "r", "sender": "human", "message": "x"}, {"responseId": "s", "sender": "ASSISTANT", "message": "y"}]}}, ["user", "assistant"]),
        ("kimi", {"chat": {"name": "t"}, "messages": [{"id": "a", "role": "user", "blocks": [{"text": {"content": "x"}}]}]}, ["user"]),
        ("notebooklm", {"title": "t", "chat": [{"id": "a", "role": "user", "content": "x"}]}, ["user"]),
        ("gemini", {"uuid": "c_1", "raw": [[[["c", "r1"], None, [["x"]], [[["k", ["y"]]]], [1700000000]]]]}, ["user", "assistant"]),
    ],
)
def test_other_platforms(spark, source, doc, roles):
    raw, spec = docs(spark, c=doc), normalize.SPECS[source]
    got = normalize.messages(raw, spec)
    assert [r["role"] for r in got.orderBy("sequence").collect()] == roles
    assert [r["content"] for r in got.orderBy("sequence").collect()] == ["x", "y"][: len(roles)]
    conv = normalize.conversations(raw, spec, got).first()
    assert conv["message_count"] == len(roles) and conv["source"] == source
    normalize.tool_events(raw, spec).collect()


def test_events_of_chat_sources(spark):
    """What searches, pictures, tools and media of each platform become."""

    def events(source, doc):
        rows = normalize.tool_events(docs(spark, c=doc), normalize.SPECS[source]).orderBy("event_id").collect()
        return [(r["event_id"], r["message_id"], r["event_type"], r["tool_name"], r["success"], json.loads(r["metadata_json"] or "{}")) for r in rows]

    def qwen(chat_type, **message):
        return {"data": {"chat_type": chat_type, "chat": {"history": {"messages": {"b": {"id": "b", "role": "assistant", "content": "y"} | message}}}}}

    assert events("qwen", qwen("search", extra={"web_search": {"results": [{"u": 1}, {"u": 2}]}})) == [
        ("b_search_call", "b", "search_call", "search", None, {"chat_type": "search", "result_count": 2}),
        ("b_search_result", "b", "search_result", "search", True, {"chat_type": "search"}),
    ]
    assert [e[:4] for e in events("qwen", qwen("t2v"))] == [("b_video_generation", "b", "video_generation_call", "t2v")]
    assert events("qwen", qwen("t2t")) == []
    found = events("deepseek", {"chat_messages": [{"message_id": 7, "role": "ASSISTANT", "search_enabled": True, "search_results": [{"u": 1}]}]})
    assert [e[:5] for e in found] == [("7_search_call", "7", "search_call", "web_search", None), ("7_search_result", "7", "search_result", "web_search", True)]
    assert found[0][5] == {"search_enabled": True, "result_count": 1}
    found = events("grok", {"responses": {"responses": [{"responseId": "r", "sender": "human", "webSearchResults": [1, 2], "citedXposts": [1], "toolResponses": [], "generatedImageUrls": ["u"]}]}})
    assert [(e[0], e[2], e[5]) for e in found] == [("r_cited_xposts", "xpost_result", {"count": 1}), ("r_image_gen", "image_result", {"count": 1}), ("r_web_search", "search_result", {"count": 2})]
    tool = {"id": "1", "tool": {"name": "search", "toolCallId": "t", "args": "{}", "contents": [1]}}
    refs = {"usedSearchChunks": [{"u": 1}]}
    assert events("kimi", {"messages": [{"id": "m", "role": "user", "blocks": [tool], "refs": refs}]}) == [("m_tool_t", "m", "search_call", "search", True, {"toolCallId": "t", "result_count": 1})]
    assert events("kimi", {"messages": [{"id": "m", "role": "assistant", "refs": refs}]}) == [("m_refs_search", "m", "search_result", "web_search", True, {"count": 1, "kind": "usedSearchChunks"})]
    entry = {"uuid": "e", "blocks": [{"web_result_block": {"web_results": [{"url": "u", "name": "n"}]}}, {}, {"web_result_block": {"web_results": [{"link": "v"}]}}], "media_items": [{"url": "p"}]}
    assert [(e[0], e[1], e[2], e[3], e[5]["url"]) for e in events("perplexity", {"entries": [entry]})] == [
        ("e_media_0", "e_asst", "media_reference", "external_media", "p"), ("e_src_0", "e_asst", "search_result", "web_search", "u"), ("e_src_1", "e_asst", "search_result", "web_search", "v"),
    ]
    source = ["https://t0.gstatic.com/faviconV2?x", "https://site.org/a", "Title", "Snippet"]
    turn = [["c", "r1"], None, [["x"]], [[["k", ["y", "z"], None, [source, source], "https://lh3.googleusercontent.com/pic"]]], [1700000000]]
    assert [(e[0], e[2], e[5].get("url")) for e in events("gemini", {"raw": [[turn]]})] == [
        ("c_t0_asst_cite_0", "search_result", "https://site.org/a"), ("c_t0_asst_img_0", "image_generation", "https://lh3.googleusercontent.com/pic"),
    ]


def test_models_modes_and_settings(spark):
    def one(source, doc):
        raw, spec = docs(spark, c=doc), normalize.SPECS[source]
        return normalize.conversations(raw, spec, normalize.messages(raw, spec)).first()

    turns = [[["c", f"r{k}"], None, [["q"]], [[["k", ["a"]]], *[None] * 7, "BR", *[None] * 12, model], [1700000000 + k]] for k, model in enumerate(["2.5 Pro", "2.5 Flash"])]
    got = one("gemini", {"raw": [turns]})
    assert got["model"] == "2.5 Pro" and json.loads(got["settings_json"]) == {"locale": "BR", "models_used": ["2.5 Flash", "2.5 Pro"]}
    assert one("grok", {"responses": {"responses": [{"responseId": "r", "sender": "human", "message": "x", "model": "any"}]}})["model"] == "any"
    for session, mode in (({}, "chat"), ({"model_type": "expert"}, "research"), ({"agent": "agent"}, "research"), ({"model_type": "x-Reasoner"}, "research")):
        assert one("deepseek", {"chat_session": session, "chat_messages": []})["mode"] == mode
    message = {"message_id": 1, "role": "ASSISTANT", "content": "y", "accumulated_token_usage": 0, "ban_edit": True, "thinking_elapsed_secs": 2.5, "files": [{"name": "f"}], "search_results": [{"u": 1}]}
    row = normalize.messages(docs(spark, c={"chat_messages": [message]}), normalize.SPECS["deepseek"]).first()
    assert row["token_count"] is None and json.loads(row["attachment_names"]) == ["f"] and json.loads(row["citations_json"]) == [{"u": 1}]
    assert json.loads(row["attachments_json"]) == {"ban_edit": True, "thinking_elapsed_secs": 2.5}
    doc = {"data": {"meta": {"tags": ["a"]}, "chat": {"history": {"messages": {"m": {"id": "m", "role": "user", "model": "q", "content_list": [{"content": "x", "timestamp": 5}, {"content": "y", "timestamp": 9}]}}}}}}
    got = one("qwen", doc)
    assert got["model"] == "q" and json.loads(json.loads(got["settings_json"])["meta"]) == {"tags": ["a"]}
    links = normalize.group_links(docs(spark, c={"conversation_v2": {"conversation": {"workspaces": [{"workspaceId": "w"}, {"workspaceId": "v"}]}}}), normalize.SPECS["grok"])
    assert values(links, "conversation_id", "project_tag", "tagged_by") == [("c", "v", "grok_workspace"), ("c", "w", "grok_workspace")]


def test_messages_without_text_stay_and_count(spark):
    """Tool calls, files and pictures alone are messages; unknown roles are none but have a number."""
    raw = docs(spark, c={"model": "m", "chat_messages": [
        {"uuid": "z", "sender": "robot", "content": []}, {"uuid": "a", "sender": "human", "files": [{"file_uuid": "f"}], "attachments": [{"file_name": "n", "extracted_content": "x"}]},
        {"uuid": "b", "sender": "assistant", "content": [{"type": "tool_use", "name": "bash", "integration_name": "s"}]}, {"uuid": "d", "sender": "assistant", "stop_reason": "end", "content": [{"type": "text", "text": "A", "citations": [{"u": 1}]}]},
    ]})
    got = normalize.messages(raw, normalize.SPECS["claude_ai"])
    assert values(got, "sequence", "message_id", "content", "content_types", "model", "finish_reason", "citations_json") == [
        (2, "a", "", "attachment,file", None, None, None), (3, "b", "", "tool_use", "m", None, None), (4, "d", "A", "text", "m", "end", '[{"u":1}]'),
    ]
    assert json.loads(got.filter("message_id = 'a'").first()["attachments_json"]) == [{"id": None, "file_name": "n", "file_type": None, "file_size": None, "extracted_content": "x", "created_at": None}]
    assert values(normalize.tool_events(raw, normalize.SPECS["claude_ai"]), "event_id", "message_id", "event_type") == [("b_call_0", "b", "mcp_other_call")]
    assert normalize.conversations(raw, normalize.SPECS["claude_ai"], got).first()["message_count"] == 3
    kimi = docs(spark, c={"chat": {}, "messages": [
        {"id": "late", "role": "assistant", "createTime": "2025-01-02", "blocks": [{"id": "x", "tool": {"name": "search"}}]}, {"id": "early", "role": "user", "createTime": "2025-01-01", "blocks": [{"file": {"id": "f"}}]},
        {"id": "none", "role": "robot", "createTime": "2025-01-01T12", "blocks": []}, {"id": "first", "role": "SYSTEM", "blocks": []},
    ]})
    assert values(normalize.messages(kimi, normalize.SPECS["kimi"]), "sequence", "message_id", "content_types", "attachment_names") == [(1, "first", "text", None), (2, "early", "file", '["f"]'), (4, "late", "tool", None)]
    thought = "t" * 200
    turn = [["c", "r"], None, [["q"]], [[["k", ["a"], *[None] * 35, [[[thought, "short", [thought]], "a" * 3]]]]], [1700000000]]
    gemini = docs(spark, c={"raw": [[turn, "no turn", [["c", "s"], None, None, None, None], [["c", "u"], None, [[""]], [[["k", None]]], None]]]})
    assert values(normalize.messages(gemini, normalize.SPECS["gemini"]), "sequence", "message_id", "content", "thinking") == [
        (1, "c_t0_user", "q", None), (2, "c_t0_asst", "a", thought), (3, "c_t2_user", "", None),
    ]


def test_notebook_tables(spark):
    uuid = "12345678-1234-1234-1234-123456789012"
    doc = {
        "guide": [[["All about it"], [[["Why?", "Explain why"], ["How?", None], "bad"]]]],
        "metadata": [["T", [[["s1"], "a.pdf", [None, 9]], [["s2"], "b.md"], "bad"]]],
        "notes": [[["n1", ["n1", "Com base no texto"]], ["n2", ["n2", "plain"]], ["n3", ["n3", uuid]], ["n4", ["n4", ""]]]],
        "audios": [[["o1", "Post", 2, [[["s1"]]], "done"], ["o2", None, 99], ["o3", "Talk", 1]]],
        "_mind_map_tree": {"tree": {"root": 1}},
        "chat": [{"id": "a", "role": "user", "content": "x"}],
    }
    raw = docs(spark, c=doc)
    assert values(normalize.notebook_messages(raw), "message_id", "sequence", "role", "content") == [("a", 1, "user", "x"), ("c_guide_summary", 0, "system", "All about it")]
    assert values(normalize.guide_questions(raw), "question_id", "question_text", "full_prompt", "order") == [("c_q0", "Why?", "Explain why", 0), ("c_q1", "How?", "", 1)]
    content = docs(spark, s1=[None, None, None, [[[0, 5, [[[0, 5, ["Hello "]], [5, 9, ["you"]]]]], [9, 10, [[[9, 10, ["!"]]]]]]]]).withColumnRenamed("id", "source_id")
    assert values(normalize.notebook_sources(raw, content), "doc_id", "file_name", "content", "estimated_token_count") == [("s1", "a.pdf", "Hello you!", 2)]
    guides = docs(spark, s1=[[[None, ["sum"], [["t1", "t2"]], [["q"]]]]], s2=[[[None, []]]]).withColumnRenamed("id", "source_id")
    assert values(normalize.source_guides(raw, guides), "source_id", "summary", "tags_json", "questions_json") == [("s1", "sum", '["t1","t2"]', '["q"]')]
    assert values(normalize.notebook_notes(raw), "note_id", "kind") == [("n1", "brief"), ("n2", "note")]
    single = docs(spark, o1=[["o1", "Post", 2, None, "done", None, None, ["# text"]]]).withColumnRenamed("id", "output_id")
    got = values(normalize.notebook_outputs(raw, single), "output_id", "output_type_name", "content", "source_refs_json", "status")
    assert got == [("c_mm", "mind_map", '{"root":1}', None, None), ("o1", "blog_post", "# text", '["s1"]', "done"), ("o3", "audio_overview", None, None, None)]


def test_line_numbers_count_within_files(spark, tmp_path):
    for name, n in (("a", 2), ("b", 3), ("c", 400)):
        write(tmp_path / "logs" / f"{name}.jsonl", "\n".join(f'{{"k": {k}}}' for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = sources.json_lines(spark, str(tmp_path / "logs")).selectExpr("file", "line_no", "try_variant_get(doc, '$.k', 'long') AS k").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 405 and all(r["line_no"] == r["k"] for r in rows)


def test_agent_logs(spark, tmp_path):
    at = lambda k: f"2025-01-01T00:00:0{k}Z"
    lines = [
        {"type": "user", "uuid": "1", "cwd": "/p", "timestamp": at(1), "message": {"content": "do"}},
        {"type": "assistant", "uuid": "2", "timestamp": at(2), "message": {"model": "m", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "uuid": "3", "timestamp": at(3), "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": False, "content": "out"}]}},
        {"type": "user", "uuid": "1", "timestamp": at(1), "message": {"content": "do"}},
        {"type": "user", "uuid": "9", "isSidechain": True, "timestamp": at(4), "message": {"content": "side"}},
    ]
    write(tmp_path / "cc" / "s1.jsonl", "\n".join([*map(json.dumps, lines), "{bad"]))
    convs, msgs, events = normalize.claude_code_sessions(sources.json_lines(spark, str(tmp_path / "cc")))
    assert values(msgs, "sequence", "role", "content") == [(1, "user", "do"), (2, "assistant", "ok")]
    assert values(events, "tool_name", "command", "success", "result") == [("Bash", "ls", True, "out")]
    assert values(convs, "conversation_id", "project", "model", "message_count") == [("s1", "/p", None, 2)]
    assert values(events, "event_id", "event_type") == [("t", "tool_call")]

    def line(kind, k, **payload):
        return {"type": kind, "timestamp": at(k), "payload": payload}

    lines = [
        line("session_meta", 0, cwd="/w"), line("event_msg", 1, type="user_message", message="q"), line("event_msg", 2, type="agent_reasoning", text="hm"),
        line("event_msg", 3, type="agent_message", message="a"), line("response_item", 4, type="function_call", call_id="f", name="shell", arguments='{"cmd":"ls"}'),
        line("event_msg", 5, type="exec_command_end", call_id="f", exit_code=0, duration={"secs": 1, "nanos": 5_000_000}),
    ]
    write(tmp_path / "cx" / "r.jsonl", "\n".join(map(json.dumps, lines)))
    convs, msgs, events = normalize.codex_sessions(sources.json_lines(spark, str(tmp_path / "cx")))
    assert values(msgs, "sequence", "role", "content", "thinking") == [(1, "user", "q", None), (2, "assistant", "a", "hm")]
    assert values(events, "tool_name", "command", "duration_ms", "success") == [("shell", "ls", 1005, True)]
    assert values(convs, "project", "message_count") == [("/w", 2)]


def test_snapshot_sessions(spark, tmp_path):
    first = {"sessionId": "s", "messages": [{"id": "1", "type": "user", "content": "a"}]}
    write(tmp_path / "g" / "x-1.json", first)
    write(tmp_path / "g" / "x-2.json", first | {"messages": [*first["messages"], {"id": "2", "type": "gemini", "content": "b", "thoughts": [{"description": "t"}], "toolCalls": [{"name": "ls", "status": "success"}]}]})
    convs, msgs, events = normalize.gemini_cli_sessions(sources.json_documents(spark, str(tmp_path / "g")))
    assert values(msgs, "sequence", "role", "content", "thinking") == [(1, "user", "a", None), (2, "assistant", "b", "****: t")]
    assert values(events, "event_id", "tool_name", "success") == [("2_tool_0", "ls", True)]
    assert values(convs, "message_count") == [(2,)]


def test_hand_made_saves(spark, tmp_path):
    write(tmp_path / "n" / "2025-01-01 Chat.md", '---\nauthor: "Claude"\nsource: https://claude.ai/chat/abc-1?x=1\n---\n> q\n\nanswer')
    convs, msgs = normalize.clipped_notes(sources.text_files(spark, str(tmp_path / "n")))
    assert values(convs, "conversation_id", "source", "title", "message_count", "capture_method") == [("abc-1", "claude_ai", "Chat", 2, "manual_clipping_obsidian")]
    assert values(msgs, "sequence", "role", "content") == [(1, "user", "q"), (2, "assistant", "answer")]
    write(tmp_path / "t" / "s.txt", "> go\n⏺ Bash(ls)\n⏺ Done")
    convs, msgs, events = normalize.terminal_transcripts(sources.text_files(spark, str(tmp_path / "t"), "*.txt"))
    assert msgs.count() == 3 and values(events, "tool_name", "command") == [("Bash", "ls")]
    write(tmp_path / "p" / "proj" / "memory" / "MEMORY.md", "# index")
    write(tmp_path / "p" / "proj" / "memory" / "a.md", "---\nname: A\ntype: feedback\n---\ntéxt")
    got = normalize.agent_memories(sources.text_files(spark, str(tmp_path / "p")), "claude_code")
    assert values(got, "memory_id", "kind", "name", "content") == [("claude_code:proj:MEMORY.md", "index", None, "# index"), ("claude_code:proj:a.md", "feedback", "A", "téxt")]


# --- monitoring --------------------------------------------------------------------------------


def test_run_logs(spark):
    logs = [
        ("p", {"run_started_at": "2025-01-01T00:00:00Z", "run_finished_at": "2025-01-01T00:01:00Z", "discovery": {"total": 100}, "fetch": {"attempted": 5, "succeeded": 0}, "totals": {"threads_fetched": 4}, "errors": ["x"]}),
        ("p", {"started_at": "2025-01-09T00:00:00Z", "totals": {"threads_discovered": 70}, "errors": {"a": ["x", "y"], "b": []}}),
        ("q", {"started_at": "2025-01-09T00:00:00Z", "mode": "refetch_known", "discovery": {"total": 1}}),
        ("q", {"started_at": "2025-01-08T00:00:00Z", "discovery": {"total": 10}, "account": 2}),
    ]
    log = spark.createDataFrame([(p, json.dumps(d)) for p, d in logs], "platform string, j string").select("platform", F.parse_json("j").alias("doc"))
    runs = monitor.capture_runs(log)
    assert values(runs, "platform", "duration_seconds", "discovery_total", "fetch_succeeded", "errors", "account") == [
        ("p", 60.0, 100, 4, 1, None), ("p", None, 70, None, 2, None), ("q", None, 1, None, 0, None), ("q", None, 10, None, 0, "2"),
    ]
    assert values(monitor.drop_flags(runs), "platform", "dropped") == [("p", True), ("q", False)]
    latest = monitor.latest_runs(runs, F.lit("2025-02-01").cast("timestamp"))
    assert values(latest, "platform", "freshness") == [("p", "yellow"), ("q", "yellow")]


# --- streaming ---------------------------------------------------------------------------------


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))
    return spark.readStream.schema(schema).json(str(path))


def test_replays_and_windows(spark, tmp_path):
    schema = "session string, uuid string, at timestamp"
    times = ["2025-01-01 00:00:00", "2025-01-01 00:00:00", "2025-01-01 00:50:00", "2025-01-01 01:10:00"]
    rows = spark.createDataFrame([("s", u, t) for u, t in zip("aabc", times)], "session string, uuid string, at string").selectExpr("session", "uuid", "timestamp(at) as at").collect()
    events = stream(spark, tmp_path / "e", rows, schema)
    assert drained(streaming.once(events, ["session", "uuid"], "at"), "st2").count() == 3
    counts = drained(streaming.windowed_counts(events, "at", F.col("session"), "1 hour"), "st6", "complete")
    assert sorted(r["n"] for r in counts.collect()) == [1, 3]
    sessions = drained(streaming.activity_sessions(events, "at", "session"), "st6s", "complete")
    assert sorted(r["n"] for r in sessions.collect()) == [2, 2]


def test_growing_logs(spark, tmp_path):
    write(tmp_path / "l" / "a.jsonl", '{"x":1}\nbad\n')
    lines = drained(streaming.growing_logs(spark, str(tmp_path / "l"), str(tmp_path / "state")).withColumn("doc", F.col("doc").isNotNull()), "st1")
    assert sorted(r["doc"] for r in lines.collect()) == [False, True]


def test_calls_meet_results(spark, tmp_path):
    calls = stream(spark, tmp_path / "c", spark.sql("select 's' session, 'x' call_id, timestamp'2025-01-01 00:00:00' called_at union all select 's', 'y', timestamp'2025-01-01 00:00:01'").collect(), "session string, call_id string, called_at timestamp")
    results = stream(spark, tmp_path / "q", spark.sql("select 's' session, 'x' call_id, timestamp'2025-01-01 00:00:05' result_at, false is_error").collect(), "session string, call_id string, result_at timestamp, is_error boolean")
    got = drained(streaming.calls_with_results(calls, results), "st3")
    assert ("x", True) in values(got, "call_id", "success")
