"""Web platforms (N1, N2, N6 to N9, N12, N13): a table says where each platform keeps things, one plan reads them.

Documents come as (id, doc) with ``doc`` a variant. Columns are paths tried in order, or functions of
the variant; what a platform lacks is null. Everything is variant navigation inside Spark.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.operators.deep import deep_finds
from tessera.operators.graph import branch_id, branch_members
from tessera.schema import conform

Source = str | tuple[str, ...] | Callable[[Column], Column]


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def _flag(v: Column, *paths: str) -> Column:
    """Booleans, some of which are texts."""
    return F.coalesce(*[F.coalesce(F.try_variant_get(v, p, "boolean"), F.lower(F.try_variant_get(v, p, "string")) == "true") for p in paths])


def _blocks(v: Column, path: str, kind: str, text: str) -> Column:
    """Texts of the blocks of one type, a blank line between; null without any."""
    own = F.filter(F.try_variant_get(v, path, "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == kind)
    texts = F.filter(F.transform(own, lambda b: F.try_variant_get(b, f"$.{text}", "string")), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.nullif(F.array_join(texts, "\n\n"), F.lit(""))


def _joined(v: Column, path: str, *keys: str) -> Column:
    each = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda b: _text(b, *[f"$.{k}" for k in keys]))
    return F.nullif(F.array_join(F.filter(each, lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n"), F.lit(""))


def _text_of(c: Column) -> Column:
    """Never null, as texts of messages are."""
    return F.coalesce(c, F.lit(""))


def _csv(*parts: Column) -> Column:
    """The parts that aren't null as CSV; ``text`` where there are none."""
    return F.coalesce(F.nullif(F.concat_ws(",", *parts), F.lit("")), F.lit("text"))


def _if(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def _has(v: Column, *paths: str) -> Column:
    """Whether one of the lists has elements."""
    return functools.reduce(lambda a, b: a | b, [F.size(_list(v, p)) > 0 for p in paths])


def _json_list(names: Column) -> Column:
    """Texts that aren't empty as a JSON list; null without any."""
    some = F.filter(names, lambda x: _text_of(x) != "")
    return F.when(F.size(some) > 0, F.to_json(some))


def _names_of(v: Column, path: str, *keys: str) -> Column:
    """Of each element the first of ``keys`` that isn't empty."""
    return F.transform(_list(v, path), lambda f: F.coalesce(*[F.nullif(_text(f, f"$.{k}"), F.lit("")) for k in keys]))


@dataclass
class Spec:
    """Where a platform keeps conversations and messages."""

    source: str
    conversation: dict[str, Source]
    messages: str | Callable[[Column], Column]  # path of the message list or map, or the list
    message: dict[str, Source]
    keyed: bool = False  # messages are a map by id
    roles: dict[str, str] = field(default_factory=lambda: {"user": "user", "assistant": "assistant", "system": "system"})
    #: Columns of the document that messages use, by name.
    inherit: dict[str, Source] = field(default_factory=dict)
    #: What messages are numbered by, then as listed; the numbers count all messages, also those that are left out.
    order: Callable[[Column], Column] | None = None
    #: Sources that keep an answer beside its question: columns of the answer's row; ``message`` has the question's.
    answer: dict[str, Source] | None = None
    #: What is no message and gives no event, beside unknown roles.
    keep: Callable[[Column], Column] = lambda m: F.lit(True)
    events: str | None = None  # path of tool blocks within a message
    event: dict[str, Source] = field(default_factory=dict)
    is_event: Callable[[Column], Column] = lambda b: F.lit(True)
    #: Instead of ``events``: the events of a message as an array of ``_event`` structs, from the message and ``context``.
    listed: Callable[[Column, Column], Column] | None = None
    context: Source | None = None  # of the document, for ``listed``
    finds: Callable[[Column], Column] | None = None  # of the message, in place of ``context``
    model_rule: str = "last"  # or: greatest, first, last_or_first


def _column(v: Column, source: Source) -> Column:
    if callable(source):
        return source(v)
    return _text(v, *([source] if isinstance(source, str) else source))


def _time(*paths: str) -> Callable[[Column], Column]:
    return lambda v: X.to_ts(_text(v, *paths))


def _on(*paths: str) -> Callable[[Column], Column]:
    return lambda v: _flag(v, *paths)


def _int(*paths: str) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(*[F.try_variant_get(v, p, "double") for p in paths]).cast("long")


def _event(
    key: Column, kind: Column | str, tool: Column | str, /, success: bool | None = None, result: Column | None = None, command: Column | None = None, **meta: Column
) -> Column:
    """One tool event; its id is the message's with ``key``."""
    text = lambda c: F.lit(c) if isinstance(c, str) or c is None else c
    return F.struct(
        key.alias("key"), text(kind).alias("event_type"), text(tool).alias("tool_name"), F.lit(success).cast("boolean").alias("success"),
        text(command).cast("string").alias("command"), text(result).cast("string").alias("result"),
        (F.to_json(F.struct(*[c.alias(n) for n, c in meta.items()])) if meta else F.lit(None).cast("string")).alias("metadata_json"),
    )


def _some(*events: tuple[Column, Column]) -> Column:
    """The events whose condition holds."""
    return F.filter(F.array(*[F.when(c, e) for c, e in events]), lambda e: e.isNotNull())


def _list(v: Column, path: str) -> Column:
    """A list of variants; empty where there is none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _json(v: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


# Lists of a response, each with the category and the name of its event.
RESULT_FAMILIES = (
    ("search", "webSearchResults", "web_search"),
    ("search", "citedWebSearchResults", "cited_web_search"),
    ("xpost", "xposts", "xposts"),
    ("xpost", "citedXposts", "cited_xposts"),
    ("rag", "ragResults", "rag"),
    ("rag", "citedRagResults", "cited_rag"),
    ("connector", "connectorSearchResults", "connector_search"),
    ("connector", "citedConnectorSearchResults", "cited_connector_search"),
    ("collection", "collectionSearchResults", "collection_search"),
    ("collection", "citedCollectionSearchResults", "cited_collection_search"),
    ("product", "searchProductResults", "product_search"),
    ("image", "generatedImageUrls", "image_gen"),
    ("tool", "toolResponses", "tool_response"),
)


def _family_events(m: Column, _: Column) -> Column:
    """One event for each kind of result that a response lists."""
    size = lambda path: F.size(_list(m, path))
    return _some(
        *[
            (size(f"$.{at}") > 0, _event(F.lit(name), f"{category}_result", name, True, _json(m, f"$.{at}"), count=size(f"$.{at}")))
            for category, at, name in RESULT_FAMILIES
        ]
    )


#: Where the results of a search stand, the first place that has them.
_SEARCH_PLACES = ("$.info.search_results", "$.extra.web_search.results", "$.annotation.citations")


def _chat_type_events(m: Column, chat_type: Column) -> Column:
    """A search's call and result; pictures, videos and artifacts without one are calls."""
    results = F.coalesce(*[F.try_variant_get(m, p, "array<variant>") for p in _SEARCH_PLACES])
    raw = F.coalesce(*[F.when(F.try_variant_get(m, p, "array<variant>").isNotNull(), _json(m, p)) for p in _SEARCH_PLACES])
    there = F.coalesce(F.size(results) > 0, F.lit(False))
    kind = X.lookup(chat_type, X.CHAT_CATEGORIES)
    sub = _text(m, "$.sub_chat_type")
    search = F.coalesce(kind, F.lit("search"))
    made = F.coalesce(chat_type.isin("t2i", "t2v", "artifacts"), F.lit(False)) & ~there & (_text(m, "$.role") == "assistant")
    return _some(
        (there, _event(F.lit("search_call"), F.concat(search, F.lit("_call")), chat_type, chat_type=chat_type, sub_chat_type=sub, result_count=F.size(results))),
        (there, _event(F.lit("search_result"), F.concat(search, F.lit("_result")), chat_type, True, raw, chat_type=chat_type)),
        (made, _event(kind, F.concat(kind, F.lit("_call")), chat_type, chat_type=chat_type, sub_chat_type=sub)),
    )


def _search_events(m: Column, _: Column) -> Column:
    """A search's call and result."""
    n = F.size(_list(m, "$.search_results"))
    return _some(
        (n > 0, _event(F.lit("search_call"), "search_call", "web_search", search_enabled=_flag(m, "$.search_enabled"), search_status=_text(m, "$.search_status"), result_count=n)),
        (n > 0, _event(F.lit("search_result"), "search_result", "web_search", True, _json(m, "$.search_results"), search_status=_text(m, "$.search_status"))),
    )


#: At most so many web results of a block, and media of an entry, are taken.
BLOCK_RESULTS, ENTRY_MEDIA = 50, 20


def _entry_events(m: Column, _: Column) -> Column:
    """Web results of all blocks numbered through, then media."""
    found = F.flatten(F.transform(_list(m, "$.blocks"), lambda b: F.slice(_list(b, "$.web_result_block.web_results"), 1, BLOCK_RESULTS)))
    blank = lambda *c: F.coalesce(*c, F.lit(""))
    results = F.transform(
        found,
        lambda r, i: _event(
            F.concat(F.lit("src_"), i.cast("string")), "search_result", "web_search", url=blank(F.nullif(_text(r, "$.url"), F.lit("")), _text(r, "$.link")),
            title=F.substring(blank(F.nullif(_text(r, "$.name"), F.lit("")), _text(r, "$.title")), 1, 200), snippet=F.substring(blank(_text(r, "$.snippet")), 1, 300),
            timestamp=_text(r, "$.timestamp"),
        ),
    )
    media = F.transform(
        F.slice(_list(m, "$.media_items"), 1, ENTRY_MEDIA),
        lambda r, i: _event(
            F.concat(F.lit("media_"), i.cast("string")), "media_reference", F.coalesce(F.nullif(_text(r, "$.source"), F.lit("")), F.lit("external_media")),
            url=_text(r, "$.url"), image=_text(r, "$.image"), name=_text(r, "$.name"), medium=_text(r, "$.medium"),
        ),
    )
    return F.concat(results, media)


def _block_events(m: Column, _: Column) -> Column:
    """Tools of blocks; without one, the search results that the message used."""
    blocks = F.filter(_list(m, "$.blocks"), lambda b: F.try_variant_get(b, "$.tool", "variant").isNotNull())
    call = lambda b: F.coalesce(F.nullif(_text(b, "$.tool.toolCallId"), F.lit("")), F.concat_ws("_", _text(m, "$.id"), F.coalesce(_text(b, "$.id"), F.lit("?"))))
    name = lambda b: F.coalesce(F.nullif(_text(b, "$.tool.name"), F.lit("")), F.lit("unknown"))
    size = lambda b: F.size(_list(b, "$.tool.contents"))
    tools = F.transform(
        blocks,
        lambda b: _event(
            F.concat(F.lit("tool_"), call(b)), F.concat(name(b), F.lit("_call")), name(b), True, F.when(size(b) > 0, _json(b, "$.tool.contents")),
            F.nullif(_text(b, "$.tool.args"), F.lit("")), toolCallId=call(b), result_count=size(b),
        ),
    )
    used = F.size(_list(m, "$.refs.usedSearchChunks"))
    refs = _event(F.lit("refs_search"), "search_result", "web_search", True, _json(m, "$.refs.usedSearchChunks"), count=used, kind=F.lit("usedSearchChunks"))
    return F.when(F.size(tools) > 0, tools).otherwise(_some((used > 0, refs)))


# Where pictures of a turn lie, and what marks addresses of icons and logos.
PICTURE_ADDRESS = r"""(https://[^"\\,\s'<>)]+(?:googleusercontent|gstatic)[^"\\,\s'<>)]*)"""
NO_PICTURES = ("faviconV2", "/lamda/images/", "/branding/")


def turn_pictures(m: Column) -> Column:
    """Addresses of a turn's pictures, each once."""
    found = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.to_json(m), r"\\\\u003d", "="), r"\\\\u0026", "&"), F.lit(PICTURE_ADDRESS), 1)
    return F.filter(F.array_distinct(found), lambda u: ~u.rlike("|".join(NO_PICTURES)))


def turn_sources(finds: Column) -> Column:
    """The search results among what was found in a turn, each address once."""
    found = F.filter(finds, lambda x: x["kind"] == "source")
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["url"]), x["url"]) == i + 1)


def _turn_events(m: Column, finds: Column) -> Column:
    """Pictures, then search results."""
    response = F.coalesce(_text(m, "$[3][0][0][0]"), _text(m, "$[0][1]"))
    pictures = F.transform(
        turn_pictures(m), lambda u, i: _event(F.concat(F.lit("img_"), i.cast("string")), "image_generation", "gemini_image", url=u, response_id=response)
    )
    sources = F.transform(
        turn_sources(finds),
        lambda x, i: _event(
            F.concat(F.lit("cite_"), i.cast("string")), "search_result", "gemini_search", result=x["snippet"], url=x["url"], title=x["text"], snippet=x["snippet"], favicon=x["icon"]
        ),
    )
    return F.concat(pictures, sources)


def _research_mode(v: Column) -> Column:
    """Reasoning models and the agent do research."""
    kind = F.lower(F.coalesce(_text(v, "$.chat_session.model_type"), F.lit("default")))
    reasons = kind.isin("thinking", "expert", "reasoner") | kind.contains("reason")
    return F.when(reasons | (_text(v, "$.chat_session.agent") == "agent"), "research").otherwise("chat")


def _names(v: Column, path: str) -> Column:
    """Names of files as a JSON list; null without any."""
    named = F.filter(F.transform(_list(v, path), lambda f: F.coalesce(F.nullif(_text(f, "$.name"), F.lit("")), _text(f, "$.file_name"))), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(named) > 0, F.to_json(named))


def _times(v: Column) -> Column:
    return F.filter(F.transform(_list(v, "$.content_list"), lambda b: F.try_variant_get(b, "$.timestamp", "double")), lambda t: t.isNotNull() & (t != 0))


_GONE = _on("$._preserved_missing")


def _parts(v: Column) -> Column:
    return _list(v, "$.message.content.parts")


def _pictures(v: Column) -> Column:
    return F.filter(_parts(v), lambda p: _text(p, "$.content_type") == "image_asset_pointer")


def _drawn(v: Column) -> Column:
    """Whether a picture of the parts was made by a tool."""
    return F.exists(_pictures(v), lambda p: F.try_variant_get(p, "$.metadata.dalle", "variant").isNotNull() & ~F.coalesce(F.is_variant_null(F.try_variant_get(p, "$.metadata.dalle", "variant")), F.lit(False)))


def _marked_types(v: Column) -> Column:
    """The content's type, then voice and pictures."""
    return F.concat_ws(
        ",", _text(v, "$.message.content.content_type"), _if(X.voice_direction(_parts(v))[0], "audio_transcription"),
        F.when(_drawn(v), "dalle").when(F.size(_pictures(v)) > 0, "image_upload"),
    )


def _block_types(v: Column) -> Column:
    """Sorted types of the blocks, then attachments and files."""
    types = F.array_sort(F.array_distinct(F.filter(F.transform(_list(v, "$.content"), lambda b: _text(b, "$.type")), lambda x: _text_of(x) != "")))
    also = [F.when(_has(v, f"$.{place}") & ~F.array_contains(types, name), name) for place, name in (("attachments", "attachment"), ("files", "file"))]
    return _csv(F.nullif(F.array_join(types, ","), F.lit("")), *also)


def _citations(v: Column) -> Column:
    texts = F.filter(_list(v, "$.content"), lambda b: _text(b, "$.type") == "text")
    found = F.filter(F.flatten(F.transform(texts, lambda b: _list(b, "$.citations"))), lambda c: ~F.is_variant_null(c))
    return F.when(F.size(found) > 0, F.to_json(found))


def _attachments(v: Column) -> Column:
    """The attachments under fixed keys, with the text that was taken from them."""
    each = F.transform(
        _list(v, "$.attachments"),
        lambda a: F.struct(
            _text(a, "$.id").alias("id"), _text_of(_text(a, "$.file_name")).alias("file_name"), _text(a, "$.file_type").alias("file_type"),
            F.try_variant_get(a, "$.file_size", "long").alias("file_size"), _text_of(_text(a, "$.extracted_content")).alias("extracted_content"), _text(a, "$.created_at").alias("created_at"),
        ),
    )
    return F.when(F.size(each) > 0, F.to_json(each, {"ignoreNullFields": "false"}))


def _is_server_tool(b: Column) -> Column:
    """what names a server is a server's tool; of a result, whose tool isn't known."""
    named = (_text_of(_text(b, "$.integration_name")) != "") | (_text_of(_text(b, "$.mcp_server_url")) != "") | F.coalesce(_flag(b, "$.is_mcp_app"), F.lit(False))
    return F.when(_text(b, "$.type") == "tool_use", named).otherwise(X.lookup(_text(b, "$.name"), X.TOOL_CATEGORIES).isNull())


def _thoughts(v: Column) -> Column:
    """Long texts of the thinking part that the answer doesn't hold, each once."""
    texts = F.regexp_extract_all(F.coalesce(_json(v, "$[3][0][0][37]"), F.lit("")), F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0))
    plain = F.transform(texts, lambda t: F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]"))
    answer = _text_of(_chunks(v))
    return F.nullif(F.array_join(F.array_distinct(F.filter(plain, lambda t: (F.length(t) >= LONG_THOUGHT) & ~answer.contains(t))), "\n\n---\n\n"), F.lit(""))


#: Fixed value: texts of the thinking part from so many characters on are thoughts.
LONG_THOUGHT = 200


def _chunks(v: Column) -> Column:
    """The answer's texts, a line each; null without any."""
    texts = F.filter(F.transform(_list(v, "$[3][0][0][1]"), lambda x: F.try_variant_get(x, "$", "string")), lambda x: x.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def _file_names(addresses: Column) -> Column:
    """The last part of each address without its question."""
    return F.transform(addresses, lambda u: F.split_part(F.element_at(F.split(u, "/"), -1), F.lit("?"), F.lit(1)))


def _place(what: str) -> Callable[[Column], Column]:
    return lambda _: F.concat(F.col("conversation_id"), F.lit("_t"), F.col("pos").cast("string"), F.lit(what))


def _entry(what: str) -> Callable[[Column], Column]:
    """An entry's id, or its conversation's with the place."""
    known = lambda v: F.coalesce(F.nullif(_text(v, "$.uuid"), F.lit("")), F.nullif(_text(v, "$.backend_uuid"), F.lit("")))
    return lambda v: F.concat(F.coalesce(known(v), F.concat_ws("_", "conversation_id", (2 * F.col("pos")).cast("string"))), F.lit(what))


def _of_assistant(role: str, path: str, said: str = "assistant") -> Callable[[Column], Column]:
    return lambda v: F.when(F.lower(_text(v, role)) == said, F.nullif(_text(v, path), F.lit("")))


def _kinds(v: Column) -> Column:
    """What each block is, as CSV in their order."""
    kind = lambda b: F.coalesce(*[F.when(F.try_variant_get(b, f"$.{k}", "variant").isNotNull(), k) for k in ("text", "tool", "file")])
    return _csv(F.nullif(F.array_join(F.filter(F.transform(_list(v, "$.blocks"), kind), lambda x: x.isNotNull()), ","), F.lit("")))

PEOPLE = {"user": "user", "assistant": "assistant"}


def _said(v: Column, path: str) -> Column:
    """Whether there is a value that isn't empty, zero or false."""
    value = F.try_variant_get(v, path, "variant")
    return F.coalesce(value.isNotNull() & ~F.to_json(value).isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _turns(v: Column) -> Column:
    """The turns of a conversation, lists all."""
    return F.filter(_list(v, "$.raw[0]"), lambda t: F.schema_of_variant(t).startswith("ARRAY"))


def _answer(v: Column) -> Column:
    """The blocks' texts, else the answer of the first answer's JSON."""
    return X.answer_text(F.try_variant_get(v, "$.blocks", "array<variant>"), _text(v, "$.first_answer"))


def _response_times(v: Column) -> Column:
    return F.filter(F.transform(_list(v, "$.responses.responses"), lambda r: _text(r, "$.createTime")), lambda t: _text_of(t) != "")


def _media_settings(v: Column) -> Column:
    """System prompt, media types and task result, unless all are empty."""
    at = lambda name: f"$.conversation_v2.conversation.{name}"
    some = _said(v, at("systemPromptName")) | _said(v, at("mediaTypes")) | _said(v, at("taskResult"))
    return F.when(some, F.to_json(F.struct(
        _text_of(_text(v, at("systemPromptName"))).alias("systemPromptName"), F.coalesce(F.try_variant_get(v, at("mediaTypes"), "variant"), F.parse_json(F.lit("[]"))).alias("mediaTypes"),
        F.coalesce(F.try_variant_get(v, at("taskResult"), "variant"), F.parse_json(F.lit("{}"))).alias("taskResult"),
    )))


def _session_settings(v: Column) -> Column:
    """The session's settings, and the seconds of thinking and the tokens of all messages where there are some."""
    at = lambda name, kind="string": F.try_variant_get(v, f"$.chat_session.{name}", kind)
    fixed = F.struct(
        F.coalesce(F.nullif(at("agent"), F.lit("")), F.lit("chat")).alias("agent"), F.coalesce(F.nullif(at("model_type"), F.lit("")), F.lit("default")).alias("model_type"),
        *[at(k, "variant").alias(k) for k in ("version", "title_type", "seq_id", "is_empty")],
    )
    number = lambda m, path: F.coalesce(F.try_variant_get(m, path, "double"), F.lit(0.0))
    thought = F.aggregate(_list(v, "$.chat_messages"), F.lit(0.0), lambda s, m: s + F.when(_flag(m, "$.thinking_enabled"), number(m, "$.thinking_elapsed_secs")).otherwise(F.lit(0.0)))
    tokens = number(F.try_element_at(_list(v, "$.chat_messages"), F.lit(-1)), "$.accumulated_token_usage").cast("long")
    also = F.struct(F.when(thought > 0, thought).alias("thinking_elapsed_total_secs"), F.nullif(tokens, F.lit(0)).alias("total_token_usage"))
    ends = lambda j: F.regexp_replace(j, r"^\{|\}$", "")
    return F.concat(F.lit("{"), F.concat_ws(",", ends(F.to_json(fixed, {"ignoreNullFields": "false"})), F.nullif(ends(F.to_json(also)), F.lit(""))), F.lit("}"))


def _request_settings(v: Column) -> Column:
    """Scenario, options and tools of the last request."""
    at = lambda name: F.try_variant_get(v, f"$.chat.lastRequest.{name}", "variant")
    tools = F.transform(_list(v, "$.chat.lastRequest.tools"), lambda t: _text(t, "$.type"))
    return F.when(_said(v, "$.chat.lastRequest"), F.to_json(
        F.struct(at("scenario").alias("scenario"), F.coalesce(at("options"), F.parse_json(F.lit("{}"))).alias("options"), tools.alias("tools")), {"ignoreNullFields": "false"}
    ))


def _response_types(v: Column) -> Column:
    """What a response holds, as CSV in a fixed order."""
    return _csv(
        _if(_text_of(_text(v, "$.message")) != "", "text"), _if(_has(v, "$.webSearchResults", "$.citedWebSearchResults"), "search"), _if(_has(v, "$.xposts", "$.citedXposts"), "xpost"),
        _if(_has(v, "$.ragResults", "$.citedRagResults"), "rag"), _if(_has(v, "$.generatedImageUrls", "$.imageEditUris"), "image_gen"),
        _if(_has(v, "$.imageAttachments", "$.fileAttachments", "$.fileUris"), "attachment"), _if(_has(v, "$.toolResponses"), "tool"),
    )


SPECS: dict[str, Spec] = {
    # A tree of nodes by id; tools and quotes become events, canvas and research both.
    "chatgpt": Spec(
        "chatgpt",
        {
            "title": "$.title", "created_at": _time("$.create_time"), "updated_at": _time("$.update_time"),
            "mode": lambda v: F.lit("chat"), "url": lambda v: F.concat(F.lit("https://chatgpt.com/c/"), F.col("id")), "is_temporary": _on("$.is_temporary_chat"),
            "project_id": lambda v: X.project_or_assistant(_text(v, "$.gizmo_id", "$._project_id"))[0],
            "gizmo_id": lambda v: X.project_or_assistant(_text(v, "$.gizmo_id"))[1], "project": "$._project_name",
            "is_archived": _on("$.is_archived"), "is_pinned": _on("$.is_starred"), "is_preserved_missing": _GONE,
            "last_seen_in_server": _time("$._last_seen_in_server"),
        },
        "$.mapping",
        {
            "message_id": "$.message.id", "role": "$.message.author.role", "parent": "$.parent", "created_at": _time("$.message.create_time"),
            "content": lambda v: X.content_text(F.try_variant_get(v, "$.message.content", "variant")),
            "content_types": _marked_types, "model": lambda v: F.when(_text(v, "$.message.author.role") == "assistant", _text(v, "$.message.metadata.model_slug")),
            "finish_reason": "$.message.metadata.finish_details.type",
            "hidden_reason": lambda v: X.hidden_reason(
                _flag(v, "$.message.metadata.is_visually_hidden_from_conversation"), F.try_variant_get(v, "$.message.weight", "double"), _text(v, "$.message.recipient")
            ),
            "is_voice": lambda v: X.voice_direction(F.try_variant_get(v, "$.message.content.parts", "array<variant>"))[0],
            "voice_direction": lambda v: X.voice_direction(F.try_variant_get(v, "$.message.content.parts", "array<variant>"))[1],
        },
        keyed=True, roles={"user": "user", "assistant": "assistant"},
        keep=lambda m: ~_text(m, "$.message.content.content_type").eqNullSafe("tether_quote"),
    ),
    # Typed blocks; people are called humans.
    "claude_ai": Spec(
        "claude_ai",
        {
            "title": "$.name", "created_at": _time("$.created_at"), "updated_at": _time("$.updated_at"), "model": "$.model", "summary": lambda v: F.nullif(_text(v, "$.summary"), F.lit("")),
            "mode": lambda v: F.lit("chat"), "url": lambda v: F.concat(F.lit("https://claude.ai/chat/"), F.col("id")),
            "project_id": ("$.project.uuid", "$.project_uuid"), "project": "$.project.name", "is_pinned": _on("$.is_starred"),
            "is_temporary": _on("$.is_temporary"), "is_preserved_missing": _GONE, "last_seen_in_server": _time("$._last_seen_in_server"),
            "settings_json": lambda v: F.to_json(F.try_variant_get(v, "$.settings", "variant")),
        },
        "$.chat_messages",
        {
            "message_id": "$.uuid", "role": "$.sender", "parent": "$.parent_message_uuid", "created_at": _time("$.created_at"),
            "content": lambda v: _blocks(v, "$.content", "text", "text"), "model": lambda v: F.when(_text(v, "$.sender") == "assistant", F.col("of_model")),
            "thinking": lambda v: _blocks(v, "$.content", "thinking", "thinking"), "content_types": _block_types, "finish_reason": "$.stop_reason",
            "citations_json": _citations, "attachments_json": _attachments,
            "attachment_names": lambda v: _json_list(_names_of(v, "$.attachments", "file_name")),
            "start_timestamp": lambda v: X.epoch_bounds(F.try_variant_get(v, "$.content", "array<struct<start_timestamp string, stop_timestamp string>>"))[0],
            "stop_timestamp": lambda v: X.epoch_bounds(F.try_variant_get(v, "$.content", "array<struct<start_timestamp string, stop_timestamp string>>"))[1],
        },
        roles={"human": "user", "assistant": "assistant"}, inherit={"of_model": "$.model"},
        events="$.content",
        event={
            "event_id": lambda b: F.when(
                _text(b, "$.type") == "tool_use", F.coalesce(F.nullif(_text(b, "$.id"), F.lit("")), F.concat_ws("_call_", "message_id", F.col("at").cast("string")))
            ).otherwise(F.concat(F.coalesce(F.nullif(_text(b, "$.tool_use_id"), F.lit("")), F.col("message_id")), F.lit("_result"), F.when(_text_of(_text(b, "$.tool_use_id")) == "", F.concat(F.lit("_"), F.col("at").cast("string"))).otherwise(""))),
            "event_type": lambda b: F.concat(X.tool_event_type(_text(b, "$.name"), _is_server_tool(b)), F.when(_text(b, "$.type") == "tool_use", "_call").otherwise("_result")),
            "tool_name": lambda b: F.nullif(_text(b, "$.name"), F.lit("")), "success": lambda b: F.when(_text(b, "$.type") == "tool_result", ~F.coalesce(_flag(b, "$.is_error"), F.lit(False))),
            "metadata_json": lambda b: F.when(_text(b, "$.type") == "tool_use", X.packed(
                tool_use_id=_text(b, "$.id"), input=_json(b, "$.input"), message=_text(b, "$.message"), icon_name=_text(b, "$.icon_name"), is_mcp=_is_server_tool(b), integration_name=_text(b, "$.integration_name"),
                mcp_server_url=_text(b, "$.mcp_server_url"), start_timestamp=_text(b, "$.start_timestamp"), stop_timestamp=_text(b, "$.stop_timestamp"),
            )).otherwise(X.packed(tool_use_id=_text(b, "$.tool_use_id"), icon_name=_text(b, "$.icon_name"), is_error=F.coalesce(_flag(b, "$.is_error"), F.lit(False)))),
            "result": lambda b: F.when(_text(b, "$.type") == "tool_result", F.when(F.schema_of_variant(F.try_variant_get(b, "$.content", "variant")) == "STRING", _text(b, "$.content")).otherwise(_json(b, "$.content"))),
        },
        is_event=lambda b: _text(b, "$.type").isin("tool_use", "tool_result"),
    ),
    # An envelope around a map of messages.
    "qwen": Spec(
        "qwen",
        {
            "url": lambda v: F.concat(F.lit("https://chat.qwen.ai/c/"), F.col("id")), "title": "$.data.title", "created_at": _time("$.data.created_at"), "updated_at": _time("$.data.updated_at"),
            "settings_json": lambda v: X.packed(
                meta=_json(v, "$.data.meta"), feature_config=F.to_json(F.try_variant_get(F.try_element_at(F.map_values(F.try_variant_get(v, "$.data.chat.history.messages", "map<string,variant>")), F.lit(1)), "$.feature_config", "variant"))
            ),
            "mode": lambda v: X.lookup(_text(v, "$.data.chat_type"), X.CHAT_MODES, "chat"), "project_id": lambda v: F.nullif(_text(v, "$.data.project_id"), F.lit("")),
            "is_pinned": _on("$.data.pinned"), "is_archived": _on("$.data.archived"), "is_preserved_missing": _GONE,
            "last_seen_in_server": _time("$._last_seen_in_server"),
        },
        "$.data.chat.history.messages",
        {
            "message_id": "$.id", "role": "$.role", "parent": "$.parentId", "created_at": lambda v: F.coalesce(X.to_ts(F.nullif(_text(v, "$.timestamp"), F.lit("0"))), F.col("of_time")),
            "model": _of_assistant("$.role", "$.model"), "finish_reason": lambda v: F.when(F.try_variant_get(v, "$.is_stop", "boolean"), "user_stop").when(_said(v, "$.error"), "error"),
            "content": lambda v: F.coalesce(_joined(v, "$.content_list", "content"), _text(v, "$.content")),
            "content_types": lambda v: _csv(
                _if(_text_of(F.coalesce(_joined(v, "$.content_list", "content"), _text(v, "$.content"))) != "", "text"), _if(_text_of(_text(v, "$.reasoning_content")) != "", "reasoning"),
                _if(_names(v, "$.files").isNotNull(), "file"), _if(_said(v, "$.info.search_results"), "search"),
            ),
            "thinking": lambda v: F.nullif(_text(v, "$.reasoning_content"), F.lit("")),
            "attachment_names": lambda v: _names(v, "$.files"), "start_timestamp": lambda v: X.to_ts(F.array_min(_times(v))),
            "stop_timestamp": lambda v: X.to_ts(F.array_max(_times(v))),
        },
        keyed=True, listed=_chat_type_events, context="$.data.chat_type", model_rule="any_first", roles=PEOPLE, inherit={"of_time": _time("$.data.created_at")},
        order=lambda v: F.coalesce(F.try_variant_get(v, "$.timestamp", "double"), F.lit(0.0)),
    ),
    # Ids are numbers of the conversation, roles in capitals, token counts add up along it.
    "deepseek": Spec(
        "deepseek",
        {
            "title": "$.chat_session.title", "created_at": _time("$.chat_session.inserted_at"), "updated_at": _time("$.chat_session.updated_at"),
            "mode": _research_mode, "url": lambda v: F.concat(F.lit("https://chat.deepseek.com/a/chat/s/"), F.col("id")), "settings_json": _session_settings, "is_pinned": _on("$.chat_session.pinned"), "is_preserved_missing": _GONE,
            "last_seen_in_server": _time("$._last_seen_in_server"),
        },
        "$.chat_messages",
        {
            "message_id": "$.message_id", "role": "$.role", "parent": "$.parent_id", "created_at": lambda v: F.coalesce(X.to_ts(F.nullif(_text(v, "$.inserted_at"), F.lit("0"))), F.col("of_time")),
            "model": _of_assistant("$.role", "$.model"),
            "content_types": lambda v: _csv(
                _if(_text_of(_text(v, "$.content")) != "", "text"), _if(_text_of(_text(v, "$.thinking_content")) != "", "thinking"),
                _if(F.coalesce(_flag(v, "$.search_enabled"), F.lit(False)) & _said(v, "$.search_results"), "search"), _if(_names(v, "$.files").isNotNull(), "file"),
            ),
            "content": "$.content", "thinking": lambda v: F.nullif(_text(v, "$.thinking_content"), F.lit("")),
            "token_count": lambda v: F.nullif(_int("$.accumulated_token_usage")(v), F.lit(0)), "attachment_names": lambda v: _names(v, "$.files"),
            "citations_json": lambda v: F.when(F.size(_list(v, "$.search_results")) > 0, _json(v, "$.search_results")),
            "attachments_json": lambda v: X.packed(
                feedback=_json(v, "$.feedback"), tips=_json(v, "$.tips"), ban_edit=F.nullif(_flag(v, "$.ban_edit"), F.lit(False)),
                ban_regenerate=F.nullif(_flag(v, "$.ban_regenerate"), F.lit(False)), thinking_elapsed_secs=F.nullif(F.try_variant_get(v, "$.thinking_elapsed_secs", "double"), F.lit(0.0)),
                incomplete_message=_json(v, "$.incomplete_message"),
            ),
            "finish_reason": lambda v: F.when(_said(v, "$.incomplete_message"), "incomplete").otherwise(X.finish_reason(F.nullif(_text(v, "$.status"), F.lit("")))), "start_timestamp": _time("$.inserted_at"),
            "stop_timestamp": lambda v: X.to_ts(
                (F.unix_micros(X.to_ts(_text(v, "$.inserted_at"))) / 1e6 + F.try_variant_get(v, "$.thinking_elapsed_secs", "double"))
            ),
        },
        listed=_search_events, roles={"USER": "user", "ASSISTANT": "assistant"}, inherit={"of_time": _time("$.chat_session.inserted_at")}, model_rule="any_first",
        keep=lambda m: _text(m, "$.message_id").isNotNull(),
    ),
    # Turns by position.
    "gemini": Spec(
        "gemini",
        {
            "mode": lambda v: F.lit("chat"), "updated_at": lambda v: X.to_ts(F.array_max(F.transform(_turns(v), lambda t: F.try_variant_get(t, "$[4][0]", "double")))), "is_preserved_missing": _GONE,
            "last_seen_in_server": _time("$._last_seen_in_server"), "url": lambda v: F.concat(F.lit("https://gemini.google.com/app/"), F.ltrim(_text(v, "$.uuid"), F.lit("c_"))),
        },
        _turns,
        {"message_id": _place("_user"), "role": lambda v: F.lit("user"), "content": "$[2][0][0]", "created_at": _time("$[4][0]"), "content_types": lambda v: F.lit("text")},
        answer={
            "message_id": _place("_asst"), "role": lambda v: F.lit("assistant"), "content": _chunks, "created_at": _time("$[4][0]"), "thinking": _thoughts, "model": "$[3][21]",
            "content_types": lambda v: F.when(F.size(turn_pictures(v)) > 0, "text+image").otherwise("text"), "attachment_names": lambda v: _json_list(_file_names(turn_pictures(v))),
        },
        listed=_turn_events, finds=lambda m: deep_finds(m), model_rule="greatest",
    ),
    # Each entry is a question and its answer.
    "perplexity": Spec(
        "perplexity",
        {
            "title": lambda v: F.substring(_text(v, "$.entries[0].thread_title", "$.entries[0].query_str"), 1, 500),
            "created_at": _time("$.entries[0].entry_created_datetime"), "model": "$.entries[0].display_model",
            "mode": lambda v: X.lookup(F.lower(_text(v, "$.entries[0].mode")), X.SEARCH_MODES, "search"), "is_preserved_missing": _GONE,
        },
        "$.entries",
        {
            "message_id": _entry("_user"), "role": lambda v: F.lit("user"), "content": "$.query_str", "created_at": _time("$.entry_created_datetime"), "content_types": lambda v: F.lit("text"),
        },
        answer={
            "message_id": _entry("_asst"), "role": lambda v: F.lit("assistant"), "created_at": _time("$.entry_created_datetime"), "content_types": lambda v: F.lit("text"),
            "model": lambda v: F.coalesce(F.nullif(_text(v, "$.display_model"), F.lit("")), F.col("of_model")), "content": _answer,
        },
        inherit={"of_model": "$.entries[0].display_model"},
        listed=_entry_events,
    ),
    # Responses in order of their time.
    "grok": Spec(
        "grok",
        {
            "title": "$.conversation_v2.conversation.title",
            "created_at": lambda v: X.to_ts(F.coalesce(_text(v, "$.conversation_v2.conversation.createTime"), F.array_min(_response_times(v)))),
            "updated_at": lambda v: X.to_ts(F.coalesce(_text(v, "$.conversation_v2.conversation.modifyTime"), F.array_max(_response_times(v)))),
            "is_pinned": lambda v: F.coalesce(_flag(v, "$.conversation_v2.conversation.starred"), F.lit(False)), "is_temporary": lambda v: F.coalesce(_flag(v, "$.conversation_v2.conversation.temporary"), F.lit(False)),
            "project_id": "$.conversation_v2.conversation.workspaces[0].workspaceId", "project": "$.conversation_v2.conversation.workspaces[0].name", "mode": lambda v: F.lit("chat"),
            "url": lambda v: F.concat(F.lit("https://grok.com/c/"), F.col("id")), "settings_json": _media_settings,
            "is_preserved_missing": _GONE, "last_seen_in_server": _time("$._last_seen_in_server"),
        },
        "$.responses.responses",
        {
            "message_id": "$.responseId", "role": lambda v: F.lower(F.trim(_text(v, "$.sender"))), "parent": "$.parentResponseId", "created_at": _time("$.createTime"),
            "content": "$.message", "model": _of_assistant("$.sender", "$.model"), "content_types": _response_types,
            "attachment_names": lambda v: _json_list(
                F.concat(_names_of(v, "$.imageAttachments", "name"), _names_of(v, "$.fileAttachments", "name"), F.transform(_list(v, "$.fileUris"), lambda u: F.element_at(F.split(F.try_variant_get(u, "$", "string"), "/"), -1)))
            ),
            "finish_reason": lambda v: F.when(_has(v, "$.streamErrors"), "stream_error").when(_flag(v, "$.partial"), "partial"), "is_hidden": lambda v: F.coalesce(_flag(v, "$.isControl"), F.lit(False)),
        },
        listed=_family_events, model_rule="last_or_first", roles={"human": "user", "assistant": "assistant"}, order=lambda v: _text_of(_text(v, "$.createTime")),
    ),
    # Blocks of text, tools and files.
    "kimi": Spec(
        "kimi",
        {
            "title": "$.chat.name", "created_at": _time("$.chat.createTime"), "updated_at": _time("$.chat.updateTime"), "model": "$.chat.lastRequest.scenario",
            "url": lambda v: F.concat(F.lit("https://www.kimi.com/chat/"), F.col("id")), "settings_json": _request_settings,
            "mode": lambda v: X.scenario_mode(_text(v, "$.chat.lastRequest.scenario")), "is_preserved_missing": _GONE,
            "last_seen_in_server": _time("$._last_seen_in_server"),
        },
        "$.messages",
        {
            "message_id": "$.id", "role": lambda v: F.lower(_text(v, "$.role")), "parent": "$.parentId", "created_at": _time("$.createTime"),
            "content": lambda v: _joined(v, "$.blocks", "text.content"), "model": _of_assistant("$.role", "$.scenario"), "content_types": _kinds,
            "attachment_names": lambda v: _json_list(F.transform(F.filter(_list(v, "$.blocks"), lambda b: F.try_variant_get(b, "$.text", "variant").isNull() & F.try_variant_get(b, "$.tool", "variant").isNull()), lambda b: F.coalesce(F.nullif(_text(b, "$.file.name"), F.lit("")), _text(b, "$.file.id")))),
            "finish_reason": lambda v: F.when(~_text_of(_text(v, "$.status")).isin("", "MESSAGE_STATUS_COMPLETED", "MESSAGE_STATUS_UNSPECIFIED"), F.replace(F.lower(_text(v, "$.status")), F.lit("message_status_"), F.lit(""))),
        },
        listed=_block_events, order=lambda v: _text_of(_text(v, "$.createTime")),
    ),
    # A notebook's chat.
    "notebooklm": Spec(
        "notebooklm",
        {
            "title": lambda v: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.metadata[0][0]", "variant")) == "STRING", _text(v, "$.metadata[0][0]")), _text(v, "$.title")),
            "created_at": lambda v: X.pair_ts(F.try_variant_get(v, "$.create_time", "variant")),
            "updated_at": lambda v: F.coalesce(*[X.pair_ts(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("update_time", "create_time")]), "model": lambda v: F.lit("gemini"),
            "mode": lambda v: F.lit("chat"), "url": lambda v: F.concat(F.lit("https://notebooklm.google.com/notebook/"), F.coalesce(_text(v, "$.uuid"), F.col("id"))),
            "summary": lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.guide[0][0][0]", "variant")) == "STRING", F.nullif(_text(v, "$.guide[0][0][0]"), F.lit(""))),
            "is_preserved_missing": _GONE, "last_seen_in_server": _time("$._last_seen_in_server"),
        },
        "$.chat",
        {
            "message_id": "$.id", "role": lambda v: F.coalesce(_text(v, "$.role"), F.lit("user")), "content": "$.content", "model": lambda v: F.lit("gemini"),
            "created_at": lambda v: F.coalesce(X.pair_ts(F.try_variant_get(v, "$.created_at", "variant")), F.col("of_time")),
        },
        inherit={"of_time": lambda v: X.pair_ts(F.try_variant_get(v, "$.create_time", "variant"))},
    ),
}


def _exploded(docs: DataFrame, spec: Spec) -> DataFrame:
    """(conversation_id, pos, node, m) of all messages, and what they inherit from their document."""
    doc = F.col("doc")
    head = [F.col("id").alias("conversation_id"), *[_column(doc, s).alias(k) for k, s in spec.inherit.items()]]
    if spec.keyed:
        entries = F.map_entries(F.try_variant_get(doc, spec.messages, "map<string,variant>"))
        return docs.select(*head, F.posexplode(entries).alias("pos", "e")).select("*", F.col("e.key").alias("node"), F.col("e.value").alias("m")).drop("e")
    listed = spec.messages(doc) if callable(spec.messages) else F.try_variant_get(doc, spec.messages, "array<variant>")
    rows = docs.select(*head, F.posexplode(listed).alias("pos", "m"))
    return rows.withColumn("node", _column(F.col("m"), spec.message["message_id"]))


def tree_nodes(docs: DataFrame, spec: Spec) -> DataFrame:
    """Input of the branch operators: every node with its parent, and in what order they are listed."""
    rows = _exploded(docs, spec)
    parent = _column(F.col("m"), spec.message["parent"]) if "parent" in spec.message else F.lit(None).cast("string")
    return rows.select("conversation_id", "node", parent.alias("parent"), F.col("pos").cast("long").alias("ord"))


def node_branches(docs: DataFrame, spec: Spec) -> DataFrame:
    """(conversation_id, node, branch_id) of the nodes that some branch reaches."""
    members = branch_members(tree_nodes(docs, spec))
    return members.select("conversation_id", "node", branch_id(F.col("conversation_id"), F.col("head"), F.col("root")).alias("branch_id"))


def _in_branches(docs: DataFrame, spec: Spec, branches: DataFrame | None) -> DataFrame:
    """The messages that some branch reaches, to be ordered by branch, time and node."""
    rows = _exploded(docs, spec).filter(_said(F.col("m"), "$.message"))
    named = branches if branches is not None else node_branches(docs, spec)
    time = F.coalesce(F.try_variant_get("m", "$.message.create_time", "double"), F.lit(0.0))
    return rows.join(named, ["conversation_id", "node"]).withColumn("ord", F.struct("branch_id", time.alias("time"), "node"))


def _role(spec: Spec) -> Column:
    return X.lookup(_column(F.col("m"), spec.message["role"]), spec.roles)


def messages(docs: DataFrame, spec: Spec, branches: DataFrame | None = None) -> DataFrame:
    """Canonical messages; ``branches`` (conversation_id, node, branch_id) names each node's branch.

    Messages with unknown roles are left out, but count in the numbers of the others; messages without text stay. Trees (N1) are
    another matter: nodes that no branch reaches, and messages without text and voice, are left out, and the rest is numbered by
    branch, time and node; their branches are found here unless given. Sources that keep an answer beside its
    question give two rows; turns (N6) without a question, or without text, thought and picture in the answer, one or none.
    """
    m, tree = F.col("m"), spec.source == "chatgpt"
    rows = _in_branches(docs, spec, branches) if tree else _exploded(docs, spec)
    columns = lambda fields: [_column(m, s).alias(k) for k, s in fields.items() if k not in ("parent", "role")]
    place = ["conversation_id", "pos", "node", *(["ord", "branch_id"] if tree else [])]
    if spec.answer is None:
        keys = [] if tree or spec.order is None else [spec.order(m).alias("ord")]
        out = rows.select(*place, *keys, *columns(spec.message), _role(spec).alias("role"), F.coalesce(spec.keep(m), F.lit(False)).alias("__keep"))
    else:
        asked = rows.select("conversation_id", (2 * F.col("pos")).alias("pos"), "node", *columns(spec.message), F.lit("user").alias("role"))
        said = rows.select("conversation_id", (2 * F.col("pos") + 1).alias("pos"), "node", *columns(spec.answer), F.lit("assistant").alias("role"))
        if spec.source == "gemini":
            asked = asked.filter("content is not null")
            said = said.filter("coalesce(content, '') <> '' or thinking is not null or attachment_names is not null")
        out = asked.unionByName(said, allowMissingColumns=True).withColumn("__keep", F.lit(True))
    kept = F.col("role").isNotNull() & F.col("__keep")
    if tree:
        out = out.filter(kept & ((_text_of(F.col("content")) != "") | F.col("is_voice")))
    numbered = lambda by: F.expr(f"row_number() over (partition by conversation_id order by {by})")
    sequence = numbered("ord, pos") if "ord" in out.columns else numbered("pos") if spec.source == "gemini" else F.col("pos") + 1
    out = out.withColumn("sequence", sequence.cast("long")).filter(kept)
    if tree:
        out = out.withColumn("message_id", F.coalesce(F.nullif("message_id", F.lit("")), F.concat_ws("_", "conversation_id", "sequence")))
    elif branches is not None:
        out = out.join(branches, ["conversation_id", "node"], "left")
    out = out.withColumn("content", _text_of(F.col("content"))).withColumn("source", F.lit(spec.source))
    if "hidden_reason" in out.columns:
        out = out.withColumn("is_hidden", F.col("hidden_reason").isNotNull())
    return conform(out.withColumn("word_count", X.word_count(F.col("content"))), "messages")


def _tree_events(docs: DataFrame, spec: Spec, branches: DataFrame | None) -> DataFrame:
    """Quotes and tools become events instead of messages, canvas and research beside them; they belong to the node above."""
    m = F.col("m")
    at = lambda path: _text(m, f"$.message.{path}")
    role, author, recipient, model = at("author.role"), at("author.name"), at("recipient"), at("metadata.model_slug")
    quote = at("content.content_type").eqNullSafe("tether_quote")
    canvas = (role == "assistant") & X.is_canvas(recipient, author, model)
    research = (role == "assistant") & X.is_deep_research(recipient, author, model, at("metadata.deep_research_version"), _said(m, "$.message.metadata.research_done"))
    tool = role == "tool"
    sent = lambda prefix: F.coalesce(F.when(recipient.startswith(prefix), recipient), F.nullif(author, F.lit("")), F.lit(prefix.rstrip(".")))
    kind = (
        F.when(quote, "quote").when(tool & _drawn(m), "image_generation").when(tool, X.tool_category(_text_of(author)))
        .when(canvas, "canvas").when(research, "deep_research")
    )
    name = F.when(quote, "tether_quote").when(tool, author).when(canvas, sent("canmore.")).when(research, sent("research_kickoff_tool"))
    cited = X.packed(**{k: F.nullif(at(f"content.{k}"), F.lit("")) for k in ("url", "domain", "title")})
    meta = F.coalesce(_json(m, "$.message.metadata"), F.when(~tool, F.lit("{}")))
    result = F.when(quote, at("content.text")).otherwise(X.content_text(F.try_variant_get(m, "$.message.content", "variant")))
    rows = _in_branches(docs, spec, branches).select(
        "conversation_id", "ord", _text_of(_text(m, "$.parent")).alias("message_id"), kind.alias("event_type"), name.alias("tool_name"), F.nullif(result, F.lit("")).alias("result"),
        F.when(quote, cited).otherwise(F.nullif(meta, F.when(tool, F.lit("{}")))).alias("metadata_json"),
    ).filter("event_type is not null")
    return rows.withColumn("event_id", F.concat_ws("_evt_", "conversation_id", F.expr("row_number() over (partition by conversation_id order by ord)").cast("string")))


def tool_events(docs: DataFrame, spec: Spec, branches: DataFrame | None = None) -> DataFrame:
    """Canonical tool events of the messages that are kept."""
    if spec.source == "chatgpt":
        return conform(_tree_events(docs, spec, branches).withColumn("source", F.lit(spec.source)), "tool_events")
    m = F.col("m")
    rows = _exploded(docs, spec)
    if spec.answer is None:
        rows = rows.filter(_role(spec).isNotNull() & F.coalesce(spec.keep(m), F.lit(False)))
    elif spec.source == "gemini":  # turns whose answer is a message
        rows = rows.filter((_text_of(_chunks(m)) != "") | _thoughts(m).isNotNull() | (F.size(turn_pictures(m)) > 0))
    owner = _column(m, (spec.answer or spec.message)["message_id"])
    if spec.listed is not None:
        if spec.context:
            context = docs.select(F.col("id").alias("conversation_id"), _column(F.col("doc"), spec.context).alias("context"))
            rows = rows.join(context, "conversation_id", "left")
        else:
            rows = rows.withColumn("context", spec.finds(m) if spec.finds else F.lit(None).cast("string"))
        each = rows.select("conversation_id", F.coalesce(owner, F.col("node")).alias("message_id"), F.explode(spec.listed(m, F.col("context"))).alias("e"))
        before = F.regexp_replace("message_id", "_asst$", "") if spec.source == "perplexity" else F.col("message_id")
        named = each.select(F.concat_ws("_", before, "e.key").alias("event_id"), "conversation_id", "message_id", F.lit(spec.source).alias("source"), "e.*")
        return conform(named, "tool_events")
    if spec.events is None:
        return conform(rows.limit(0).select("conversation_id", F.lit(spec.source).alias("source")), "tool_events")
    each = rows.select("conversation_id", F.col("node").alias("message_id"), F.posexplode(F.try_variant_get("m", spec.events, "array<variant>")).alias("at", "b"))
    b = F.col("b")
    blocks = each.filter(spec.is_event(b)).select("conversation_id", "message_id", *[_column(b, s).alias(k) for k, s in spec.event.items()])
    return conform(blocks.withColumn("source", F.lit(spec.source)), "tool_events")


def conversations(docs: DataFrame, spec: Spec, own_messages: DataFrame, active: DataFrame | None = None, branches: DataFrame | None = None) -> DataFrame:
    """Canonical conversations: the document's columns, a model by the source's rule, and the message count.

    Of trees, and with ``active`` (conversation_id, branch_id), visible messages of the active branch count, or all visible
    ones where none is active. A tree's active branch has its current node; ``branches`` as for ``messages``.
    """
    doc = F.col("doc")
    head = docs.select(F.col("id").alias("conversation_id"), *[_column(doc, s).alias(k) for k, s in spec.conversation.items()])
    rows = own_messages
    if active is None and spec.source == "chatgpt":
        current = docs.select(F.col("id").alias("conversation_id"), _text(doc, "$.current_node").alias("node"))
        active = (branches if branches is not None else node_branches(docs, spec)).join(current, ["conversation_id", "node"])
    if active is not None:
        rows = rows.join(active.select("conversation_id", F.col("branch_id").alias("__active")), "conversation_id", "left")
        count = F.count_if(~F.col("is_hidden") & (F.col("__active").isNull() | (F.col("branch_id") == F.col("__active"))))
    else:
        count = F.count("*")
    known, said = F.col("model").isNotNull(), F.col("role") == "assistant"
    last = F.max_by("model", F.when(said & known, F.col("sequence")))
    first = F.min_by("model", F.when(known, F.col("sequence")))
    model = {"last": last, "first": first, "greatest": F.max("model")}.get(spec.model_rule, last)
    facts = rows.groupBy("conversation_id").agg(count.alias("message_count"), model.alias("__model"), F.array_sort(F.collect_set("model")).alias("__models"))
    out = head.join(facts, "conversation_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    if spec.model_rule in ("any_first", "last_or_first"):  # of all messages, whoever wrote them
        any_model = _exploded(docs, spec).select("conversation_id", F.struct(spec.order(F.col("m")).alias("o") if spec.order else F.lit(0).alias("o"), "pos").alias("at"), F.nullif(_text(F.col("m"), "$.model"), F.lit("")).alias("m"))
        firsts = any_model.filter("m is not null").groupBy("conversation_id").agg(F.min_by("m", "at").alias("__first"))
        out = out.join(firsts, "conversation_id", "left").withColumn("__model", F.col("__first") if spec.model_rule == "any_first" else F.coalesce("__model", "__first"))
    out = out.withColumn("model", F.coalesce("__model", "model") if "model" in out.columns and spec.model_rule != "any_first" else F.col("__model"))
    if spec.source == "gemini":
        locale = docs.select(F.col("id").alias("conversation_id"), F.try_element_at(F.filter(F.transform(_turns(doc), lambda t: _text(t, "$[3][8]")), lambda x: x.isNotNull()), F.lit(1)).alias("__locale"))
        models = F.when(F.size("__models") > 0, F.col("__models"))
        packed = F.when(F.coalesce("__locale", models[0]).isNotNull(), F.to_json(F.struct(F.col("__locale").alias("locale"), models.alias("models_used"))))
        out = out.join(locale, "conversation_id", "left").withColumn("settings_json", packed)
    return conform(out.withColumn("source", F.lit(spec.source)), "conversations")


def group_links(docs: DataFrame, spec: Spec) -> DataFrame:
    """The workspaces of each conversation, as links to projects."""
    return _links(
        docs.select(F.col("id").alias("conversation_id"), F.explode(_list(F.col("doc"), "$.conversation_v2.conversation.workspaces")).alias("w")).select(
            "conversation_id", _text(F.col("w"), "$.workspaceId").alias("project_tag")
        ),
        spec.source,
        "grok_workspace",
    )


def space_links(indexes: DataFrame, source: str = "perplexity") -> DataFrame:
    """Links from the thread lists (space, doc variant) of spaces; of several spaces with one thread the last by name counts."""
    each = indexes.select("space", F.explode(_list(F.col("doc"), "$")).alias("t")).select(_text(F.col("t"), "$.uuid").alias("conversation_id"), "space")
    return _links(each.filter("conversation_id is not null").groupBy("conversation_id").agg(F.max("space").alias("project_tag")), source)


def _links(links: DataFrame, source: str, tagged_by: str = "platform") -> DataFrame:
    known = links.filter("project_tag is not null").distinct()
    return conform(known.withColumn("source", F.lit(source)).withColumn("tagged_by", F.lit(tagged_by)), "conversation_projects")
