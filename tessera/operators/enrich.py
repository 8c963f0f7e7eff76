"""Joins and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (session, call_id, ...) with the last result of each (is_error, content, ord); ``success`` is null without one."""
    last = results.groupBy("session", "call_id").agg(
        F.max_by("is_error", "ord").alias("__error"), F.max_by("content", "ord").alias("result"), F.lit(True).alias("__has")
    )
    done = calls.join(last, ["session", "call_id"], "left")
    return done.withColumn("success", F.when(F.col("__has"), ~F.coalesce("__error", F.lit(False)))).drop("__error", "__has")


def exec_ends(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """Function calls with duration, success and command of the execution's end.

    ``ends`` has (session, call_id, secs, nanos, exit_code, command, ord); a call's own command comes first.
    """
    last = ends.groupBy("session", "call_id").agg(F.max_by(F.struct("secs", "nanos", "exit_code", "command"), "ord").alias("end"))
    return calls.join(last, ["session", "call_id"], "left").select(
        *[c for c in calls.columns if c != "command"],
        F.coalesce("command", "end.command").alias("command"),
        duration_ms(F.col("end.secs"), F.col("end.nanos")).alias("duration_ms"),
        (F.col("end.exit_code") == 0).alias("success"),
    )


def duration_ms(seconds: Column, nanos: Column) -> Column:
    """whole milliseconds of (seconds, nanoseconds)."""
    return (seconds * 1000 + F.floor(F.coalesce(nanos, F.lit(0)) / 1_000_000)).cast("long")


def call_and_result_rows(blocks: DataFrame) -> DataFrame:
    """tool_use and tool_result blocks as rows of their own, typed ``<category>_call`` and ``<category>_result``.

    ``blocks`` has (conversation_id, message_id, ord, type, id, tool_use_id, name, category, content, is_error).
    """
    kind = F.when(F.col("type") == "tool_use", "call").when(F.col("type") == "tool_result", "result")
    return blocks.filter(kind.isNotNull()).select(
        "conversation_id",
        "message_id",
        "ord",
        F.concat_ws("_", F.coalesce("category", F.lit("tool")), kind).alias("event_type"),
        F.coalesce("id", "tool_use_id").alias("call_id"),
        F.col("name").alias("tool_name"),
        F.when(kind == "result", ~F.coalesce("is_error", F.lit(False))).alias("success"),
        F.when(kind == "result", F.col("content")).alias("result"),
    )


def numbered_events(events: DataFrame, order: list[str], key: str = "conversation_id") -> DataFrame:
    """``event_no`` from 0 in each conversation and ``event_id`` made of both."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = events.withColumn("event_no", (F.row_number().over(w) - 1).cast("long"))
    return numbered.withColumn("event_id", F.concat_ws("_evt_", F.col(key).cast("string"), F.col("event_no").cast("string")))


def local_paths(messages: DataFrame, manifest: DataFrame, key: str = "message_id", urls: str = "urls", width: int = 200) -> DataFrame:
    """E5: each message's URLs as local paths, in order; failed or unknown ones stay as (cut) URLs.

    ``manifest`` has (url, path, failed).
    """
    each = messages.select(key, F.posexplode(urls).alias("pos", "url"))
    known = manifest.filter(~F.coalesce("failed", F.lit(False))).groupBy("url").agg(F.min("path").alias("path"))
    found = each.join(known, "url", "left").withColumn("path", F.coalesce("path", F.substring("url", 1, width)))
    lists = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("asset_paths"))
    return messages.join(lists, key, "left")


def asset_files(pointers: DataFrame, listing: DataFrame, folders: list[str]) -> DataFrame:
    """The file of an asset pointer: ``<id>__...`` or exactly ``<id>``, the first of ``folders`` wins, previews before thumbnails.

    ``pointers`` has (conversation_id, file_id), ``listing`` (conversation_id, folder, name).
    """
    place = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder"))
    files = listing.filter(F.col("folder").isin(*folders)).select(
        "conversation_id",
        F.split_part("name", F.lit("__"), F.lit(1)).alias("file_id"),
        F.struct(place.alias("place"), F.when(F.col("name").contains("thumbnail"), 1).otherwise(0).alias("small"), "name").alias("rank"),
        F.concat_ws("/", "folder", "name").alias("path"),
    )
    best = files.groupBy("conversation_id", "file_id").agg(F.min_by("path", "rank").alias("path"))
    return pointers.join(best, ["conversation_id", "file_id"], "left")


def attach_reasoning(events: DataFrame, key: str = "session") -> DataFrame:
    """Reasoning joined to agent messages in order of ``ord``.

    ``events`` has (key, ord, kind in user, agent, reasoning, text). Pending reasoning goes to the next
    agent message. At a user message, or the end, it goes to the agent message before, whose own
    reasoning it overwrites; without one it stays pending. Returns the messages with ``thinking``.
    """
    by = Window.partitionBy(key).orderBy("ord")
    rows = events.withColumn("__speaks", (F.col("kind") != "reasoning").cast("int"))
    # Runs of reasoning end at the next message; nothing pending is carried over a run unless no agent has spoken.
    run = F.sum("__speaks").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__run", F.coalesce(run, F.lit(0)))
    agents = F.sum((F.col("kind") == "agent").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__agents", agents)
    thoughts = (
        rows.filter("kind = 'reasoning'")
        .groupBy(key, "__run")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("said"), F.max("ord").alias("at"), F.max("__agents").alias("__agents"))
    )
    following = rows.filter("kind <> 'reasoning'").select(key, "__run", F.col("kind").alias("next"))
    runs = thoughts.join(following, [key, "__run"], "left")
    # The message a run belongs to, by the number of agent messages before it.
    before_any = (F.col("__agents") == 0) & ~F.col("next").eqNullSafe("agent")
    target = F.when(F.col("next").eqNullSafe("agent") | before_any, F.col("__agents") + 1).otherwise(F.col("__agents"))
    late = ~F.col("next").eqNullSafe("agent") & ~before_any
    placed = runs.withColumn("__target", target).withColumn("__late", late)
    ahead = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("__late"), F.struct("at", "said")))), lambda x: x["said"]), "\n\n")
    final = placed.groupBy(key, "__target").agg(
        F.max_by(F.when(F.col("__late"), F.col("said")), F.when(F.col("__late"), F.col("at"))).alias("__over"), F.nullif(ahead, F.lit("")).alias("__ahead")
    )
    thought = final.select(key, F.col("__target").alias("__agents"), F.coalesce("__over", "__ahead").alias("thinking"))
    said = rows.filter("kind <> 'reasoning'").join(thought, [key, "__agents"], "left")
    return said.withColumn("thinking", F.when(F.col("kind") == "agent", F.col("thinking"))).select(key, "ord", "kind", "text", "thinking")


def conversation_models(messages: DataFrame, rule: str = "last") -> DataFrame:
    """One model for each conversation: the last assistant's, the first seen, or the greatest name."""
    asked = messages.filter("model is not null" + (" and role = 'assistant'" if rule == "last" else ""))
    pick = {"last": F.max_by("model", "sequence"), "first": F.min_by("model", "sequence"), "greatest": F.max("model")}[rule]
    return asked.groupBy("conversation_id").agg(pick.alias("model"))


def prompt_only_sessions(prompts: DataFrame, chats: DataFrame) -> DataFrame:
    """Sessions that only the prompt log knows, with their prompts folded."""
    lost = prompts.join(chats.select("session_id").distinct(), "session_id", "left_anti")
    return lost.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.min_by("text", F.struct("ts", "text")).alias("first_prompt")
    )


def with_group(rows: DataFrame, groups: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """A lookup by a group key; rows without one stay. Spark broadcasts the lookup if its size allows."""
    return rows.join(groups.select(on, *columns).dropDuplicates([on]), on, "left")


def normal_prompt(text: Column, width: int = 80) -> Column:
    """Lower case, single blanks, the first ``width`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 1, width)


def prefix_join(prompts: DataFrame, activity: DataFrame, widths: tuple[int, ...] = (60, 40, 25)) -> DataFrame:
    """Prompts (conversation_id, ord, text) with the time of the activity whose text begins alike.

    The longest of ``widths`` that matches counts; of activities with one prefix the first (by ts).
    Empty prefixes match nothing.
    """
    rows = prompts.withColumn("__norm", normal_prompt(F.col("text")))
    acts = activity.select(normal_prompt(F.col("text")).alias("__norm"), "ts")
    times = []
    for width in widths:
        prefix = F.substring("__norm", 1, width)
        first = acts.filter("__norm <> ''").groupBy(prefix.alias(f"__p{width}")).agg(F.min("ts").alias(f"__t{width}"))
        rows = rows.withColumn(f"__p{width}", F.nullif(prefix, F.lit(""))).join(first, f"__p{width}", "left")
        times.append(f"__t{width}")
    matched = F.coalesce(*[F.when(F.col(t).isNotNull(), w) for w, t in zip(widths, times)])
    return rows.withColumn("ts", F.coalesce(*times)).withColumn("matched_width", matched).select(*prompts.columns, "ts", "matched_width")


def match_status(matched: DataFrame) -> DataFrame:
    """FULL, PARTIAL or NONE for each conversation."""
    each = matched.groupBy("conversation_id").agg(F.count("*").alias("prompts"), F.count("ts").alias("matched"))
    status = F.when(F.col("matched") == F.col("prompts"), "FULL").when(F.col("matched") > 0, "PARTIAL").otherwise("NONE")
    return each.withColumn("status", status)


def fill_times(rows: DataFrame, key: str = "conversation_id", order: str = "ord", ts: str = "ts") -> DataFrame:
    """Times filled forward, then backward, within a conversation of two rows or more; ``interpolated`` says which."""
    by = Window.partitionBy(key).orderBy(order)
    back = F.last(ts, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(ts, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    size = F.count("*").over(Window.partitionBy(key))
    filled = F.when(size >= 2, F.coalesce(back, ahead)).otherwise(F.col(ts))
    return rows.withColumn("__filled", filled).withColumn("interpolated", F.col(ts).isNull() & F.col("__filled").isNotNull()).withColumn(ts, F.col("__filled")).drop("__filled")


# Month names in activity pages, English and Portuguese, by number.
MONTHS = {
    "jan": 1, "feb": 2, "fev": 2, "mar": 3, "apr": 4, "abr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7,
    "aug": 8, "ago": 8, "sep": 9, "set": 9, "oct": 10, "out": 10, "nov": 11, "dec": 12, "dez": 12,
}


def activity_entries(pages: DataFrame, html: str = "html", zone: str = "UTC") -> DataFrame:
    """(prompt, ts) pairs of activity pages, with English or Portuguese dates.

    Entries read "Prompted <text><br>Jan 5, 2025, 3:04:05 PM" or "<text><br>5 de jan. de 2025, 15:04:05".
    """
    entry = r"(?:Prompted|Comando|Asked)[\s ]+(.*?)<br>\s*([^<]*?\d{1,2}:\d{2}:\d{2}[^<]*)<"
    found = pages.select(F.explode(F.arrays_zip(F.regexp_extract_all(html, F.lit(entry), 1).alias("prompt"), F.regexp_extract_all(html, F.lit(entry), 2).alias("when"))).alias("x")).select("x.*")
    when = F.regexp_replace("when", "[  ]", " ")
    english = r"^\s*([A-Za-z]{3})[a-z]*\.? (\d{1,2}), (\d{4}), (\d{1,2}):(\d{2}):(\d{2})\s*([AP]M)?"
    other = r"^\s*(\d{1,2}) de ([a-z]{3})[a-zç]*\.? de (\d{4}),? (\d{1,2}):(\d{2}):(\d{2})"
    is_english = F.regexp_like(when, F.lit(english))
    part = lambda a, b: F.when(is_english, F.regexp_extract(when, english, a)).otherwise(F.regexp_extract(when, other, b))
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    half = F.regexp_extract(when, english, 7)
    hour = F.expr("0") + part(4, 4).try_cast("int")
    hour = F.when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour)
    stamp = F.format_string("%s-%02d-%02d %02d:%s:%s", part(3, 3), F.try_element_at(months, F.lower(part(1, 2))), part(2, 1).try_cast("int"), hour, part(5, 5), part(6, 6))
    ts = F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")), zone)
    return found.select(F.trim(F.regexp_replace("prompt", "<[^>]+>", "")).alias("prompt"), ts.alias("ts"))


def with_conversation(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages take their conversation's model and time where they have none."""
    own = conversations.select("conversation_id", F.col("model").alias("__model"), F.col("created_at").alias("__created"))
    return (
        messages.join(own, "conversation_id", "left")
        .withColumn("model", F.coalesce("model", "__model"))
        .withColumn("created_at", F.coalesce("created_at", "__created"))
        .drop("__model", "__created")
    )


def project_names(folders: DataFrame, markers: DataFrame) -> DataFrame:
    """A session folder's project: what its marker file says, else the folder's name."""
    named = markers.groupBy("folder").agg(F.max(F.nullif(F.trim("content"), F.lit(""))).alias("__name"))
    return folders.join(named, "folder", "left").withColumn("project", F.coalesce("__name", "folder")).drop("__name")
