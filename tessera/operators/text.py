"""Text operators (T1 to T12) over transcripts, addresses, artifacts and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How saved transcripts mark whose turn begins.
TURN_MARKERS: dict[str, list[tuple[str, str]]] = {
    "blockquote": [("user", r"^>\s?"), ("assistant", r"^(?!>)")],
    "delimited": [("user", r"^-{3}\s*USER\s*-{3}\s*$"), ("assistant", r"^-{3}\s*ASSISTANT\s*-{3}\s*$")],
    "said": [("user", r"^You said:\s*$"), ("assistant", r"^ChatGPT said:\s*$")],
    "terminal": [("user", r"^\s*[>❯]\s"), ("assistant", r"^\s*[⏺●]\s")],
}
_BOX = r"^\s*[╭│╰]"
_TOOL = r"^\s*[⏺●]\s*([A-Z][A-Za-z_]*)\((.*)\)\s*$"


def transcript_turns(texts: DataFrame, style: str, key: str = "path", text: str = "content") -> DataFrame:
    """(key, turn, role, content) of saved transcripts.

    Lines are numbered, a marked line opens a turn (for blockquotes: a change between quoted and
    plain), and lines of one turn are joined again. Lines before the first marker belong to no turn;
    the box that a terminal prints first is left out.
    """
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("pos", "line"))
    if style == "terminal":
        lines = lines.filter(~F.col("line").rlike(_BOX))
    role = F.lit(None).cast("string")
    for name, pattern in reversed(TURN_MARKERS[style]):
        role = F.when(F.col("line").rlike(pattern), name).otherwise(role)
    order = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("mark", role)
    if style == "blockquote":
        # Blank lines stay with the turn that they stand in.
        marked = marked.withColumn("mark", F.when(F.trim("line") != "", F.col("mark")))
        last = F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = marked.withColumn("opens", F.col("mark").isNotNull() & ~F.col("mark").eqNullSafe(last))
    else:
        marked = marked.withColumn("opens", F.col("mark").isNotNull())
    strip = "|".join(p for _, p in TURN_MARKERS[style] if not p.startswith("^(?!"))
    numbered = marked.withColumn("turn", F.sum(F.col("opens").cast("int")).over(order))
    body = F.regexp_replace("line", strip, "")
    turns = numbered.filter("turn > 0").groupBy(key, "turn").agg(
        F.max(F.when(F.col("opens"), F.col("mark"))).alias("role"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("line")))), lambda x: x["line"]), "\n"), F.lit(" \n\t")).alias("content"),
    )
    return turns.filter("content <> ''")


def blank_split_turns(texts: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Turns between runs of three line ends or more; user and assistant take turns."""
    parts = texts.select(key, F.posexplode(F.split(F.trim(text, F.lit(" \n\t")), r"\n\s*\n\s*\n+")).alias("pos", "content")).filter("trim(content) <> ''")
    order = Window.partitionBy(key).orderBy("pos")
    return parts.withColumn("turn", F.row_number().over(order)).select(
        key, "turn", F.when(F.col("turn") % 2 == 1, "user").otherwise("assistant").alias("role"), F.trim("content").alias("content")
    )


def tool_lines(turns: DataFrame, text: str = "content") -> DataFrame:
    """Tool calls printed in transcripts, with the argument as command or file path by tool."""
    lines = turns.select(*[c for c in turns.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    name, argument = F.regexp_extract("line", _TOOL, 1), F.regexp_extract("line", _TOOL, 2)
    name = F.when(F.col("line").startswith("Searched for"), "Search").otherwise(F.nullif(name, F.lit("")))
    argument = F.when(F.col("line").startswith("Searched for"), F.regexp_extract("line", r"^Searched for\s+(.*)$", 1)).otherwise(argument)
    found = lines.withColumn("tool_name", name).withColumn("argument", F.nullif(argument, F.lit(""))).filter("tool_name is not null")
    files = F.col("tool_name").isin("Read", "Write", "Edit", "Update", "NotebookEdit", "MultiEdit")
    return found.withColumn("file_path", F.when(files, F.col("argument"))).withColumn("command", F.when(~files, F.col("argument"))).drop("line", "argument")


URL = r"https?://[^\s\"'<>\\)\]]+"


def addresses(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """Web addresses of a text, unescaped, each once and in order, without those that match ``drop``."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\u003d", "="), r"\\u0026|&amp;", "&"), r"\\/", "/")
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit(f"({URL})"), 1))
    return F.filter(found, lambda u: ~u.rlike("|".join(drop))) if drop else found


def address_kind(url: Column) -> Column:
    """T4: upload, generated, image, video, pdf, markdown or other, by place and ending."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return (
        F.when(path.rlike("/upload"), "upload")
        .when(path.rlike("/generated|/output/"), "generated")
        .when(path.rlike(r"\.(png|jpe?g|gif|webp|svg)$"), "image")
        .when(path.rlike(r"\.(mp4|webm|mov)$"), "video")
        .when(path.rlike(r"\.pdf$"), "pdf")
        .when(path.rlike(r"\.(md|markdown)$"), "markdown")
        .otherwise("other")
    )


def artifact_versions(blocks: DataFrame, order: list[str]) -> DataFrame:
    """T5: version numbers of each (conversation, artifact) in order; updates of parts are marked, not numbered.

    ``blocks`` has (conversation_id, artifact_id, command, ...); command is create, rewrite or update.
    """
    w = Window.partitionBy("conversation_id", "artifact_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    patch = F.col("command") == "update"
    return blocks.withColumn("is_patch", patch).withColumn("version", F.sum((~patch).cast("int")).over(w))


def artifact_counts(versions: DataFrame, kind: str = "artifact_type") -> DataFrame:
    """T5"""
    return versions.groupBy(kind).agg(
        F.count_distinct("conversation_id", "artifact_id").alias("artifacts"), F.count_if(~F.col("is_patch")).alias("versions"), F.count_if("is_patch").alias("patches")
    )


def long_reports(messages: DataFrame, least: int = 2500, text: str = "content") -> DataFrame:
    """Long texts with a heading, by title, with their number of linked sources."""
    title = F.trim(F.regexp_extract(text, r"(?m)^#{1,3}\s+(.+)$", 1))
    found = messages.filter((F.length(text) >= least) & F.col(text).rlike(r"(?m)^#{1,3}\s+\S"))
    return found.withColumn("title", title).withColumn("citations", F.size(addresses(F.col(text))))


def inventory(files: DataFrame, key: str = "file_id", order: tuple[str, ...] = ("kind",)) -> tuple[DataFrame, DataFrame]:
    """Files of conversations, each once, and their number by kind."""
    w = Window.partitionBy("conversation_id", key).orderBy(*order)
    once = files.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
    return once, once.groupBy("conversation_id", "kind").agg(F.count("*").alias("n"))


#: What a notebook's output type is stored as.
ARTIFACT_FILES = {
    "audio_overview": ["m4a"], "video_overview": ["mp4"], "slide_deck": ["pdf", "pptx"], "blog_post": ["md"], "flashcards_quiz": ["json"],
    "data_table": ["csv"], "infographic": ["png"], "mind_map": ["json"],
}


def expected_artifacts(outputs: DataFrame) -> DataFrame:
    """One row for each file that an output should have."""
    lists = F.create_map(*[x for name, ends in ARTIFACT_FILES.items() for x in (F.lit(name), F.array(*[F.lit(e) for e in ends]))])
    return outputs.withColumn("ending", F.explode(F.try_element_at(lists, F.col("output_type_name"))))


SECRET_KEYS = r"(?i)(token|secret|password|passwd|api[_-]?key|authorization|credential|cookie)"
REDACTED = "[REDACTED]"


def redacted_map(m: Column) -> Column:
    """Values of secret-named keys are masked."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit(REDACTED)).otherwise(v))


def redacted_json(c: Column, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> Column:
    """In a JSON text of any depth, the values of text ``fields`` and of secret-named keys are masked; ``keep`` aside."""
    names = "|".join(f for f in fields if f not in keep)
    pattern = rf'"({names}|[^"]*(?i:token|secret|password|api_?key|authorization|cookie)[^"]*)"\s*:\s*"(?:[^"\\]|\\.)*"'
    return F.regexp_replace(c, pattern, f'"$1":"{REDACTED}"')


def voice_candidates(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """Conversations in which at least that share of message nodes has no text."""
    share = F.avg((F.coalesce(F.trim("content"), F.lit("")) == "").cast("double"))
    return nodes.groupBy("conversation_id").agg(F.count("*").alias("nodes"), share.alias("without_text")).filter(F.col("without_text") >= least)


def progress(line: Column) -> Column:
    """Done / total of the first such pair in a log line; null for a total of zero."""
    done, total = F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", 1).try_cast("double"), F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", 2).try_cast("double")
    return done / F.nullif(total, F.lit(0.0))


def note_kind(content: Column) -> Column:
    """A reference (a bare 36-character id) counts as none; briefs begin with fixed words; others are notes."""
    text = F.trim(content)
    reference = (F.length(text) == 36) & (F.length(F.regexp_replace(text, "[^-]", "")) == 4)
    return F.when(reference, F.lit(None)).when(text.rlike(r"(?i)^(#\s*)?(briefing|brief|study guide|timeline|faq)\b"), "brief").otherwise("note")
