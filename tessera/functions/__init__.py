"""Column functions (F1 to F27): everything stays inside Spark's expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- times -------------------------------------------------------------------------------------


def to_ts(c: Column) -> Column:
    """epoch seconds (as number or text) or ISO text as a time; a time without a zone is UTC; the rest is null."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.coalesce(F.timestamp_millis((number * 1000).cast("long")), F.when(number.isNull(), text.try_cast("timestamp")))


def pair_ts(v: Column) -> Column:
    """a variant that is an [epoch, nanoseconds] pair or an ISO text."""
    seconds = F.try_variant_get(v, "$[0]", "double")
    return F.coalesce(F.timestamp_millis((seconds * 1000).cast("long")), to_ts(F.try_variant_get(v, "$", "string")))


def report_time(c: Column, zone: str) -> Column:
    """1.5.1: the wall clock of the report's zone."""
    return F.from_utc_timestamp(c, zone)


def epoch_bounds(blocks: Column, start: str = "start_timestamp", stop: str = "stop_timestamp") -> tuple[Column, Column]:
    """earliest start and latest stop of an array of blocks."""
    return F.array_min(F.transform(blocks, lambda b: to_ts(b[start]))), F.array_max(F.transform(blocks, lambda b: to_ts(b[stop])))


# --- text --------------------------------------------------------------------------------------


def word_count(c: Column) -> Column:
    """words between white space; null for null."""
    return F.when(c.isNotNull(), F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))).cast("long")


def joined_texts(blocks: Column, kind: str, text: str = "text") -> Column:
    """the texts of blocks of one type, a blank line between; null if there are none."""
    own = F.filter(blocks, lambda b: (b["type"] == kind) & (F.coalesce(b[text], F.lit("")) != ""))
    return F.nullif(F.array_join(F.transform(own, lambda b: b[text]), "\n\n"), F.lit(""))


def distinct_types(types: Column) -> Column:
    """sorted distinct values as CSV."""
    return F.array_join(F.array_sort(F.array_distinct(types)), ",")


def markers(*named: tuple[str, Column]) -> Column:
    """names of the conditions that hold, in the order given, as CSV."""
    return F.nullif(F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in named]), F.lit(""))


def packed(**fields: Column) -> Column:
    """JSON of the fields that aren't null; null if all are."""
    some = F.coalesce(*[f.cast("string") for f in fields.values()]).isNotNull()
    return F.when(some, F.to_json(F.struct(*[f.alias(n) for n, f in fields.items()])))


def citations(blocks: Column) -> Column:
    """F8: the blocks' citation lists as one JSON list; null without any."""
    flat = F.flatten(F.transform(blocks, lambda b: F.coalesce(b["citations"], F.array())))
    return F.when(F.size(flat) > 0, F.to_json(flat))


def attachment_names(attachments: Column, name: str = "file_name") -> Column:
    """F8: names as CSV; null without any."""
    return F.nullif(F.array_join(F.transform(attachments, lambda a: a[name]), ","), F.lit(""))


# What stands for an image in a message's text.
PROMPTED_IMAGE, MADE_IMAGE, OTHER_IMAGE = "[imagem gerada: %s]", "[imagem gerada]", "[imagem]"


def content_text(content: Column) -> Column:
    """the text of a message's typed content (a variant).

    Some types hold one text, thoughts hold titled pieces, the rest holds parts: texts,
    transcriptions, and images, for which a placeholder stands.
    """
    get = lambda path, kind="string": F.try_variant_get(content, path, kind)
    kind = get("$.content_type")
    blank = lambda c: F.coalesce(c, F.lit(""))
    thoughts = F.filter(
        F.transform(get("$.thoughts", "array<variant>"), lambda t: _titled(F.try_variant_get(t, "$.summary", "string"), F.try_variant_get(t, "$.content", "string"))),
        lambda x: x != "",
    )
    parts = F.filter(F.transform(get("$.parts", "array<variant>"), _part), lambda x: x != "")
    context = F.concat(blank(get("$.model_set_context")), F.coalesce(F.concat(F.lit("\n"), F.nullif(get("$.repository"), F.lit(""))), F.lit("")))
    return (
        F.when(kind.isin("code", "tether_quote", "tether_browsing_display"), blank(get("$.text")))
        .when(kind == "reasoning_recap", blank(get("$.content")))
        .when(kind == "thoughts", blank(F.array_join(thoughts, "\n\n")))
        .when(kind.isin("execution_output", "computer_output", "system_error", "super_widget") & get("$.text").isNotNull(), get("$.text"))
        .when(kind == "model_editable_context", context)
        .otherwise(blank(F.array_join(parts, "\n\n")))
    )


def _titled(title: Column, body: Column) -> Column:
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when((title != "") & (body != ""), F.concat(F.lit("**"), title, F.lit("**\n\n"), body)).otherwise(F.concat(title, body))


def _part(p: Column) -> Column:
    get = lambda path: F.try_variant_get(p, path, "string")
    kind, plain = get("$.content_type"), F.schema_of_variant(p) == "STRING"
    prompt = F.trim(F.coalesce(get("$.metadata.dalle.prompt"), F.lit("")))
    made = F.try_variant_get(p, "$.metadata.dalle", "variant").isNotNull()
    image = F.when(made & (prompt != ""), F.format_string(PROMPTED_IMAGE, prompt)).when(made, MADE_IMAGE).otherwise(OTHER_IMAGE)
    return F.coalesce(
        F.when(plain, F.try_variant_get(p, "$", "string")).when(kind == "audio_transcription", get("$.text")).when(kind == "image_asset_pointer", image),
        F.lit(""),
    )


# --- classification ----------------------------------------------------------------------------

# Categories of built-in tools by name.
TOOL_CATEGORIES = {
    "web_search": "search", "google_search": "search", "web_fetch": "search", "launch_extended_search_task": "research",
    "project_knowledge_search": "search", "artifacts": "artifact", "repl": "code", "code_interpreter": "code",
    "str_replace": "code", "str_replace_editor": "code", "str_replace_based_edit_tool": "code", "create_file": "code", "view": "code",
    "file_read": "code", "present_files": "code", "bash": "code", "bash_tool": "code", "computer": "computer_use",
    "computer_20241022": "computer_use", "computer_20250124": "computer_use", "memory": "memory", "memory_user_edits": "memory",
    "recent_chats": "memory",
}

# Chat types, and search modes, with the canonical mode.
CHAT_MODES = {
    "t2t": "chat", "search": "search", "deep_research": "research", "t2i": "dalle", "t2v": "dalle", "artifacts": "chat", "learn": "chat",
}
CHAT_CATEGORIES = {
    "search": "search", "deep_research": "research", "t2i": "image_generation", "t2v": "video_generation", "artifacts": "artifact", "learn": "learn",
}
SEARCH_MODES = {"concise": "concise", "copilot": "copilot", "asi": "research", "article": "research"}


def lookup(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """a small fixed table as a map expression."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, c), F.lit(default))


def scenario_mode(c: Column) -> Column:
    """research before search; everything else is chat."""
    upper = F.upper(F.coalesce(c, F.lit("")))
    return F.when(upper.contains("RESEARCH"), "research").when(upper.contains("SEARCH"), "search").otherwise("chat")


# Categories of internal tools; the first rule counts whose test holds for the name.
TOOL_RULES = (
    ("search", "contains", ("browser",)),
    ("search", "is", ("web", "web.run")),
    ("code", "is", ("python", "execution")),
    ("canvas", "begins", ("canmore.",)),
    ("deep_research", "begins", ("research_kickoff_tool",)),
    ("image_generation", "begins", ("dalle",)),
    ("memory", "is", ("bio",)),
    ("file_search", "begins", ("file_search",)),
    ("file_search", "is", ("myfiles_browser",)),
    ("computer_use", "begins", ("computer.", "container.")),
    ("voice", "begins", ("voice_mode.",)),
)
# The same for tools of other servers, by what the name says in lower case.
SERVER_TOOL_RULES = (
    ("mcp_search", "contains", ("search", "list", "find")),
    ("mcp_fetch", "contains", ("fetch", "read", "get")),
    ("mcp_write", "contains", ("create", "write", "update", "edit")),
)


def by_rules(c: Column, rules: tuple[tuple[str, str, tuple[str, ...]], ...], default: str) -> Column:
    """The result of the first rule (result, test, words) whose test holds for a text and one of the words."""
    tests = {"contains": lambda w: c.contains(w), "begins": lambda w: c.startswith(w), "is": lambda w: c == w}
    out = F.lit(default)
    for result, test, words in reversed(rules):
        holds = functools.reduce(lambda a, b: a | b, [tests[test](w) for w in words])
        out = F.when(holds, result).otherwise(out)
    return out


def tool_category(name: Column) -> Column:
    """an internal tool's category, by name and prefix."""
    return by_rules(name, TOOL_RULES, "other")


def tool_event_type(name: Column, is_mcp: Column) -> Column:
    """built-in tools by the fixed table; others of a server by what their name says."""
    own = F.when(is_mcp, by_rules(F.lower(name), SERVER_TOOL_RULES, "mcp_other")).otherwise(lookup(name, TOOL_CATEGORIES, "other"))
    return F.when(F.coalesce(name, F.lit("")) == "", "other").otherwise(own)


def hidden_reason(flagged: Column, weight: Column, recipient: Column) -> Column:
    """why a message isn't shown; null if it is."""
    return (
        F.when(F.coalesce(flagged, F.lit(False)), "visually_hidden")
        .when(weight == 0, "weight_zero")
        .when(F.coalesce(recipient, F.lit("")).isin("", "all"), F.lit(None))
        .otherwise("internal_recipient")
    )


def voice_direction(parts: Column) -> tuple[Column, Column]:
    """whether parts (variants) hold a transcription, and the first one's direction."""
    spoken = F.filter(parts, lambda p: F.try_variant_get(p, "$.content_type", "string") == "audio_transcription")
    has = F.coalesce(F.size(spoken) > 0, F.lit(False))
    return has, F.when(has, F.try_variant_get(F.try_element_at(spoken, F.lit(1)), "$.direction", "string"))


def is_canvas(recipient: Column, author: Column, model: Column) -> Column:
    """F15"""
    begins = lambda c: F.coalesce(c.startswith("canmore."), F.lit(False))
    return begins(recipient) | begins(author) | F.coalesce(model == "gpt-4o-canmore", F.lit(False))


def is_deep_research(recipient: Column, author: Column, model: Column, version: Column, done: Column) -> Column:
    """F15"""
    begins = lambda c: F.coalesce(c.startswith("research_kickoff_tool"), F.lit(False))
    said = F.coalesce(F.lower(model).contains("research"), F.lit(False))
    return said | (F.coalesce(version, F.lit("")) != "") | F.coalesce(done, F.lit(False)) | begins(recipient) | begins(author)


def project_or_assistant(gizmo: Column) -> tuple[Column, Column, Column]:
    """F16: (project_id, gizmo_id, resolved): ``g-p-`` ids are projects, other ``g-`` ids assistants."""
    project = gizmo.startswith("g-p-")
    return F.when(project, gizmo), F.when(gizmo.startswith("g-") & ~project, gizmo), gizmo.isNull() | gizmo.startswith("g-")


def finish_reason(status: Column) -> Column:
    """FINISHED becomes stop; others in lower case."""
    lower = F.lower(status)
    return F.when(lower.isin("finished", "stop", "completed", "done"), "stop").otherwise(lower)


def asset_id(pointer: Column) -> Column:
    """what stands behind ``://``; null if that is missing."""
    return F.when(pointer.contains("://"), F.nullif(F.split_part(pointer, F.lit("://"), F.lit(2)), F.lit("")))


def first_list(doc: Column, *paths: str) -> Column:
    """the first of several places of a variant that holds a list."""
    return F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in paths])


def content_id(url: Column, width: int = 16) -> Column:
    """F21"""
    return F.substring(F.sha1(url), 1, width)


def slug(c: Column, width: int = 60) -> Column:
    """lower case, runs of other characters as one hyphen."""
    return F.substring(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-")), 1, width)


def safe_file_name(c: Column, width: int = 120) -> Column:
    """characters that file systems refuse become underscores."""
    return F.substring(F.regexp_replace(F.trim(c), r'[\\/:*?"<>|\x00-\x1f]', "_"), 1, width)


# File extensions by media type.
EXTENSIONS = {
    "text/markdown": "md", "text/html": "html", "text/plain": "txt", "application/json": "json", "application/pdf": "pdf",
    "image/png": "png", "image/jpeg": "jpg", "image/svg+xml": "svg", "image/webp": "webp", "application/vnd.ant.react": "jsx",
    "application/vnd.ant.mermaid": "mmd", "video/mp4": "mp4", "audio/mpeg": "mp3",
}


def extension(media_type: Column) -> Column:
    """F22"""
    return lookup(F.lower(F.split_part(media_type, F.lit(";"), F.lit(1))), EXTENSIONS, "bin")


def is_external(url: Column, own: tuple[str, ...]) -> Column:
    """a web address on another domain than the given ones."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    inside = F.lit(False)
    for domain in own:
        inside = inside | (host == domain) | host.endswith("." + domain)
    return F.coalesce(url.rlike("^https?://") & ~inside, F.lit(False))


# --- formats -----------------------------------------------------------------------------------


def fmt_int(c: Column) -> Column:
    """F24"""
    return F.coalesce(F.format_number(c.cast("long"), 0), F.lit("—"))


def one_decimal(c: Column) -> Column:
    """a double with one decimal as C's printf gives it: from its exact value, halves to the even digit.

    ``format_string`` rounds halves up, and rounds the shortest decimal that stands for the double (0.35, which is a little less, to 0.4).
    """
    c = c.cast("double")
    whole, size = F.floor(F.abs(c)), F.abs(c)
    # What is behind the point is exact in 58 bits, but for numbers below 1/64, which are 0.0 anyway.
    ten = ((size - whole) * float(1 << 58)).cast("long") * 10
    digit, rest, half = F.shiftright(ten, 58), ten.bitwiseAND((1 << 58) - 1), 1 << 57
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    tenths = whole * 10 + digit + F.when(up, 1).otherwise(0)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def fmt_pct(part: Column, whole: Column) -> Column:
    """count and share; a dash if there is nothing to take a share of."""
    share = F.concat(one_decimal(part * 100.0 / F.nullif(whole, F.lit(0))), F.lit("%"))
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "—").otherwise(F.concat(fmt_int(part), F.lit(" ("), share, F.lit(")")))


def fmt_bytes(c: Column, largest: str = "PB") -> Column:
    """with the unit in which the number is below 1024; beyond the ``largest`` unit, in that."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    units = units[: units.index(largest) + 1]
    out = None
    for k in range(len(units) - 1, -1, -1):
        one = F.concat(c.cast("long").cast("string") if k == 0 else one_decimal(c / 1024.0**k), F.lit(f" {units[k]}"))
        out = one if out is None else F.when(c < 1024.0 ** (k + 1), one).otherwise(out)
    return out


def relative_time(c: Column, now: Column) -> Column:
    """in whole days, hours or minutes."""
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(s / 60, "min")).when(s < 86400, ago(s / 3600, "h")).otherwise(ago(s / 86400, "d"))


def path_get(v: Column, *steps: int | str, kind: str = "string") -> Column:
    """a value at a path of positions and names of a variant; null where it ends early."""
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in steps)
    return F.try_variant_get(v, path, kind)


def succeeded(exit_code: Column | None = None, is_error: Column | None = None, status: Column | None = None) -> Column:
    """three-valued; unknown stays null."""
    signs = [exit_code == 0 if exit_code is not None else None, ~is_error if is_error is not None else None, status == "success" if status is not None else None]
    return F.coalesce(*[s for s in signs if s is not None])


def answer_text(blocks: Column, answer_json: Column | None = None) -> Column:
    """of each block the first of answer, markdown, text and content; else the answer of a JSON text."""
    each = F.transform(blocks, lambda b: F.coalesce(*[F.try_variant_get(b, f"$.{k}", "string") for k in ("answer", "markdown", "text", "content")]))
    joined = F.nullif(F.array_join(F.filter(each, lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n"), F.lit(""))
    return F.coalesce(joined, F.get_json_object(answer_json, "$.answer")) if answer_json is not None else joined
