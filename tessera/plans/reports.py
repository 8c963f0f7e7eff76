"""The report library (R1 to R49): each function takes canonical tables and gives one result table.

Ties in top-k reports are broken by the key columns, so results are the same on every run. Sums over
columns that are null throughout stay null; nothing is replaced by zero that the data doesn't say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut

# Bins of conversation sizes, and of lifetimes in days, with their upper ends.
SIZE_BINS = [("1-5", 5), ("6-10", 10), ("11-20", 20), ("21-50", 50), ("51-100", 100), ("101-200", 200), ("200+", None)]
LIFETIME_BINS = [("< 1h", 0.04167), ("1h-1d", 1), ("1-7 days", 7), ("7-30 days", 30), ("30-90 days", 90), ("> 90 days", None)]
DEFAULT_METHOD = "extractor"


# --- helpers -----------------------------------------------------------------------------------


def has_column(df: DataFrame, name: str) -> bool:
    """Reports that need a column ask for it first; only the schema is looked at."""
    return name in df.columns


def is_timestamp(df: DataFrame, name: str) -> bool:
    """Whether a column is there and is a time."""
    return has_column(df, name) and df.schema[name].dataType.typeName().startswith("timestamp")


def total(condition: Column) -> Column:
    """Number of rows with a true condition; null if it is null throughout."""
    return F.sum(condition.cast("long"))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), digits)


def whole(x: Column) -> Column:
    """To the nearest integer, halves to the even one."""
    return F.bround(x, 0).cast("int")


def month(c: str = "created_at") -> Column:
    return F.date_format(c, "yyyy-MM")


def seconds_between(start: str, stop: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {stop})") / 1e6


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *[F.asc_nulls_first(t) for t in ties]).limit(k)


def binned(value: Column, bins: list[tuple[str, float | None]], inclusive: bool) -> tuple[Column, Column]:
    """(label, position) of the first bin whose upper end the value doesn't pass; else of the last."""
    label, place = F.lit(bins[-1][0]), F.lit(len(bins) - 1)
    for k, (name, end) in reversed(list(enumerate(bins[:-1]))):
        inside = value <= end if inclusive else value < end
        label, place = F.when(inside, name).otherwise(label), F.when(inside, k).otherwise(place)
    return label, place


# --- sizes, periods, coverage ------------------------------------------------------------------


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """R1"""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.union, parts)


def period(conversations: DataFrame) -> DataFrame:
    """R2"""
    return conversations.agg(
        F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"), F.max("updated_at").alias("last_updated")
    )


def coverage(df: DataFrame, present: list[str] = (), flags: list[str] = ()) -> DataFrame:
    """Non-null counts of ``present`` and true counts of ``flags`` in one pass."""
    counted = [F.count(c).alias(c) for c in present if has_column(df, c)]
    return df.agg(F.count("*").alias("total"), *counted, *[total(F.col(c)).alias(c) for c in flags if has_column(df, c)])


def full_coverage(df: DataFrame) -> DataFrame:
    """Type, non-null count and share of every column, in one scan."""
    names = df.columns
    one = df.agg(F.count("*").alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"__{k}") for k, c in enumerate(names)])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.col(f"__{k}").alias("filled")) for k, (c, t) in enumerate(df.dtypes)]
    )
    return one.select("__n", F.explode(entries).alias("x")).select("x.*", pct(F.col("x.filled"), F.col("__n")).alias("pct"))


def interaction_split(conversations: DataFrame) -> DataFrame:
    """R5"""
    kind = F.col("interaction_type") if has_column(conversations, "interaction_type") else F.lit("human_ai")
    return conversations.agg(
        F.count_if(kind == "human_ai").alias("human_ai"),
        F.count_if(kind == "ai_ai").alias("ai_ai"),
        F.count_distinct("account").alias("accounts"),
    )


def capture_methods(conversations: DataFrame, by_source: bool = False) -> DataFrame:
    """R8"""
    keys = [F.coalesce("capture_method", F.lit(DEFAULT_METHOD)).alias("method")] + [F.col("source").alias("platform")] * by_source
    return conversations.groupBy(*keys).agg(F.count("*").alias("n"))


def model_by_role(messages: DataFrame) -> DataFrame:
    """R9"""
    every, known = F.count("*"), F.count("model")
    return messages.groupBy("role").agg(
        every.alias("total"), known.alias("with_model"), (every - known).alias("without_model"), pct(known, every).alias("pct")
    )


def thinking_coverage(messages: DataFrame) -> DataFrame:
    """R10"""
    return messages.filter("role = 'assistant'").agg(F.count("*").alias("total_asst"), F.count("thinking").alias("with_thinking"))


def token_coverage(messages: DataFrame, cumulative: bool = False) -> DataFrame:
    """With ``cumulative`` counts that grow within a conversation count by its largest."""
    if cumulative:
        each = messages.groupBy("conversation_id").agg(
            F.count("*").alias("n"), F.count("token_count").alias("known"), F.max("token_count").alias("tokens")
        )
        return each.agg(F.sum("n").alias("total"), F.sum("known").alias("with_tokens"), F.sum("tokens").alias("total_tokens"))
    return messages.agg(
        F.count("*").alias("total"), F.count("token_count").alias("with_tokens"), F.sum("token_count").alias("total_tokens")
    )


#: Parts into which a bucket that holds a middle rank is cut again.
FINER = 4096


def with_median(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """By ``keys`` (one row without any): n, total, avg, least, most and the exact median of ``value``, from one scan of ``rows``.

    Values are counted once and the counts are kept; everything else comes from them. The median's ranks are looked for in
    buckets of a sixteenth of an octave, then in ``FINER`` equal parts of the buckets that hold them, and only the values of
    those parts are sorted, so no task sees all values however close they lie.
    """
    counts = cut(rows.groupBy(*keys, value).agg(F.count("*").alias("__n")))  # nulls too, so that no group is missing
    v, n = F.col(value), F.col("__n")
    known = F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0))
    facts = (counts.groupBy(*keys) if keys else counts).agg(
        known.alias("n"), F.sum(v * n).alias("total"), (F.sum(v * n) / F.nullif(known, F.lit(0))).alias("avg"), F.min(value).alias("least"), F.max(value).alias("most")
    )
    counts = counts.filter(v.isNotNull())
    if not keys:
        facts, counts = facts.withColumn("__k", F.lit(0)), counts.withColumn("__k", F.lit(0))
    by = keys or ["__k"]
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    holds = ((F.col("__end") >= low) & (F.col("__end") - n < low)) | ((F.col("__end") >= high) & (F.col("__end") - n < high))
    up_to = lambda *order: F.col("__before") + F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]

    spread = F.floor(F.log2(F.abs(v) + 1) * 16)
    at = facts.select(*by, F.col("n").alias("__all"))
    # A bucket's name holds its parent's; ranks before it go along.
    left = counts.alias("c").join(at.alias("a"), same("c", "a")).select("c.*", "a.__all", F.lit(0).cast("long").alias("__before"), F.lit("").alias("__part"))
    finer = F.floor((v - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0)) * FINER)
    for bucket in (F.when(v < 0, -spread).otherwise(spread), F.coalesce(finer, F.lit(0))):
        cells = left.withColumn("__bucket", bucket)
        sums = cells.groupBy(*by, "__part", "__bucket", "__all", "__before").agg(F.sum("__n").alias("__n"), F.min(value).alias("__low"), F.max(value).alias("__high"))
        middle = sums.withColumn("__end", up_to("__bucket")).filter(holds)  # two a group at most
        middle = middle.select(*by, "__part", "__bucket", (F.col("__end") - n).alias("__to"), "__low", "__high")
        place = [F.col("c.__part") == F.col("m.__part"), F.col("c.__bucket") == F.col("m.__bucket")]
        left = cells.drop("__low", "__high").alias("c").join(middle.alias("m"), [*same("c", "m"), *place]).select(
            *[F.col(f"c.{k}") for k in by], *(f"c.{c}" for c in (value, "__n", "__all")), F.col("m.__to").alias("__before"), F.concat_ws("/", "c.__part", "c.__bucket").alias("__part"), "m.__low", "m.__high",
        )
    found = left.withColumn("__end", up_to(value)).filter(holds).groupBy(*by).agg(F.avg(value).alias("median"))
    return facts.alias("f").join(found.alias("m"), same("f", "m"), "left").select(*[F.col(f"f.{k}") for k in keys], *(f"f.{c}" for c in ("n", "total", "avg", "least", "most")), "m.median")


def latency(messages: DataFrame) -> DataFrame:
    """R12"""
    took = messages.filter("role = 'assistant'").select(seconds_between("start_timestamp", "stop_timestamp").alias("s"))
    return with_median(took, "s", []).select("n", F.round("median", 1).alias("median_s"), F.round("avg", 1).alias("avg_s"), F.round("most", 1).alias("max_s"))


# --- time --------------------------------------------------------------------------------------


def per_month(conversations: DataFrame, by_source: bool = False) -> DataFrame:
    """Conversations for each month (and source), with the running total."""
    keys = ["source"] * by_source
    counts = conversations.filter("created_at is not null").groupBy(*keys, month().alias("month")).agg(F.count("*").alias("n"))
    # One row a month (and source): the unpartitioned window is over a handful of rows.
    running = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cumulative", F.sum("n").over(running))


def month_by_source(conversations: DataFrame, sources: list[str]) -> DataFrame:
    """Months as rows, sources as columns, zero where there is nothing."""
    counts = conversations.filter("created_at is not null").groupBy(month().alias("month")).pivot("source", sources).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def activity(conversations: DataFrame) -> DataFrame:
    """Seven rows (ISO weekday), a column for each hour, zero where there is nothing."""
    hours = [str(h) for h in range(24)]
    seen = conversations.filter("created_at is not null").select(
        (F.weekday("created_at") + 1).alias("dow"), F.hour("created_at").cast("string").alias("hour")
    )
    counts = seen.groupBy("dow").pivot("hour", hours).agg(F.count(F.lit(1)))
    days = conversations.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("dow"))
    return days.join(counts, "dow", "left").na.fill(0).select("dow", *[F.col(f"`{h}`").alias(f"h{h}") for h in hours])


# --- messages and tools ------------------------------------------------------------------------


def messages_by_role(messages: DataFrame) -> DataFrame:
    """R16"""
    return messages.groupBy("role").agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_hidden")).alias("visible"),
        total(F.col("is_hidden")).alias("hidden"),
        F.round(F.avg("word_count"), 1).alias("avg_words"),
    )


def word_stats(messages: DataFrame, by_source: bool = False) -> DataFrame:
    """R17"""
    keys = ["platform"] * by_source + ["role"]
    rows = messages.filter("not is_hidden and word_count > 0").withColumn("platform", F.col("source")).select(*keys, "word_count")
    return with_median(rows, "word_count", keys).select(
        *keys, F.round("avg", 0).cast("int").alias("avg_words"), whole(F.col("median")).alias("median_words"), F.col("most").alias("max_words"), F.col("total").alias("total_words")
    )


def events_by_type(events: DataFrame) -> DataFrame:
    """R18"""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("n_convs"))


def outcomes(events: DataFrame, by_source: bool = False) -> DataFrame:
    """By source only where an outcome is known at all."""
    ok = F.col("success")
    counts = [
        F.count_if(ok).alias("success"), F.count_if(~ok).alias("error"), F.count_if(ok.isNull()).alias("unknown"), F.count("*").alias("total"),
    ]
    if not by_source:
        return events.agg(*counts)
    return events.groupBy(F.col("source").alias("platform")).agg(*counts).filter("success + error > 0")


def durations(events: DataFrame) -> DataFrame:
    """R20"""
    ms = F.col("duration_ms")
    rows = events.filter(ms.isNotNull()).select("duration_ms")
    return with_median(rows, "duration_ms", []).select("n", F.round("avg").cast("int").alias("avg_ms"), whole(F.col("median")).alias("median_ms"), F.col("most").alias("max_ms"))


def top_tools(events: DataFrame, k: int, by_source: bool = False) -> DataFrame:
    """R21"""
    keys = ["tool_name"] + ["source"] * by_source
    return top(events.filter("tool_name <> ''").groupBy(*keys).agg(F.count("*").alias("calls")), k, "calls", *keys)


def type_by_source(events: DataFrame, sources: list[str]) -> DataFrame:
    """R22"""
    return events.groupBy("event_type").pivot("source", sources).agg(F.count(F.lit(1))).na.fill(0)


def tools_by_source(events: DataFrame) -> DataFrame:
    """R37"""
    return events.groupBy(F.col("source").alias("platform")).agg(
        F.count("*").alias("tool_events"),
        F.count_distinct("tool_name").alias("unique_tools"),
        F.count_if("success").alias("success"),
        F.count_if(~F.col("success")).alias("error"),
    )


# --- models and conversations ------------------------------------------------------------------


def top_models(conversations: DataFrame, k: int, by_source: bool = False) -> DataFrame:
    """R23"""
    keys = ["model"] + ["source"] * by_source
    return top(conversations.filter("model is not null").groupBy(*keys).agg(F.count("*").alias("n")), k, "n", *keys)


def models_by_source(conversations: DataFrame, k: int, sources: list[str]) -> DataFrame:
    """Only the ``k`` most used models."""
    best = top_models(conversations, k).select("model")
    return conversations.join(F.broadcast(best), "model", "left_semi").groupBy("model").pivot("source", sources).agg(F.count(F.lit(1))).na.fill(0)


def longest(conversations: DataFrame, k: int = 10) -> DataFrame:
    """R25"""
    best = top(conversations, k, "message_count", "conversation_id")
    return best.select(
        F.substring("conversation_id", 1, 8).alias("conv_id"), F.col("message_count").alias("msgs"), "model", F.date_format("created_at", "yyyy-MM-dd").alias("created")
    )


def size_histogram(conversations: DataFrame) -> DataFrame:
    """``place`` is the bin's position."""
    label, place = binned(F.col("message_count"), SIZE_BINS, inclusive=True)
    return conversations.groupBy(label.alias("bin"), place.alias("place")).agg(F.count("*").alias("n"))


def size_stats(conversations: DataFrame) -> DataFrame:
    """R27"""
    sums = with_median(conversations.select("message_count"), "message_count", [])
    return sums.select(F.col("least").alias("min"), F.col("most").alias("max"), F.round("avg", 1).alias("avg"), whole(F.col("median")).alias("median"))


def lifetimes(conversations: DataFrame, by_source: bool = False) -> DataFrame:
    """R28"""
    label, place = binned(F.col("days"), LIFETIME_BINS, inclusive=False)
    known = conversations.filter("created_at is not null and updated_at is not null")
    lived = known.withColumn("days", seconds_between("created_at", "updated_at") / 86400)
    keys = [F.col("source").alias("platform")] * by_source
    return lived.groupBy(*keys, label.alias("bin"), place.alias("place")).agg(F.count("*").alias("n"))


def branch_histogram(branches: DataFrame) -> DataFrame:
    """R29"""
    each = branches.groupBy("conversation_id").agg(F.count("*").alias("branches_per_conv"))
    return each.groupBy("branches_per_conv").agg(F.count("*").alias("n_convs"))


def accounts(conversations: DataFrame) -> DataFrame:
    """R30"""
    return conversations.groupBy(F.coalesce("account", F.lit("(no account)")).alias("account")).agg(
        F.count("*").alias("convs"), F.sum("message_count").alias("total_msgs"), F.round(F.avg("message_count"), 1).alias("avg_msgs")
    )


# --- projects ----------------------------------------------------------------------------------


def project_coverage(conversations: DataFrame, columns: list[str]) -> DataFrame:
    """R31"""
    there = [c for c in columns if has_column(conversations, c)]
    linked = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in there], F.lit(False))
    return conversations.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in there], F.count_if(linked).alias("with_any"))


def top_projects(conversations: DataFrame, k: int = 20, column: str = "project_id", source: str | None = None) -> DataFrame:
    """Most used projects (of one source, if given) with their first and last conversation."""
    rows = conversations.filter(F.col(column).isNotNull())
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    each = rows.groupBy(column).agg(
        F.count("*").alias("n_convs"), F.min("created_at").alias("first_conv"), F.max("created_at").alias("last_conv")
    )
    return top(each, k, "n_convs", column)


def named_projects(conversations: DataFrame, source: str) -> DataFrame:
    """All projects of one source by id and name, most used first."""
    rows = conversations.filter((F.col("source") == source) & F.col("project_id").isNotNull())
    each = rows.groupBy("project_id", "project").agg(F.count("*").alias("n_convs"), F.min("created_at").alias("first_conv"), F.max("created_at").alias("last_conv"))
    return each.orderBy(F.desc("n_convs"), "project_id", "project")


def distinct_projects(conversations: DataFrame, column: str = "project_id") -> DataFrame:
    """R32"""
    return conversations.agg(F.count_distinct(column).alias("projects"))


def project_coverage_by_source(conversations: DataFrame, buckets: dict[str, str], column: str = "project_id") -> DataFrame:
    """``buckets`` says how a source links projects (native, cli); the others count as none."""
    lookup = F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair]) if buckets else F.create_map().cast("map<string,string>")
    every, linked = F.count("*"), F.count(column)
    each = conversations.groupBy("source").agg(every.alias("convs"), linked.alias("linked"), pct(linked, every).alias("pct"))
    return each.withColumn("bucket", F.coalesce(lookup[F.col("source")], F.lit("none")))


def path_fragmentation(conversations: DataFrame, column: str = "project") -> DataFrame:
    """For each source, how its conversations spread over paths."""
    each = conversations.filter(F.col(column).isNotNull()).groupBy("source", column).agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(
        F.count("*").alias("unique_paths"), F.sum("n").alias("total"), F.round(F.avg("n"), 1).alias("avg_per_path")
    )


def short_path(c: Column) -> Column:
    """A home folder as ``~``."""
    return F.regexp_replace(c, r"^(/home/|/Users/)[^/]+", "~")


def projects_with_metadata(metadata: DataFrame) -> DataFrame:
    """R42"""
    return metadata.groupBy("source").agg(F.count_distinct("project_id").alias("projects"))


def project_gaps(conversations: DataFrame, by_design: list[str], column: str = "project_id") -> DataFrame:
    """Conversations without a project, split by whether their source has projects at all."""
    orphan, design = F.col(column).isNull(), F.col("source").isin(*by_design)
    return conversations.agg(
        F.count("*").alias("total"),
        F.count_if(orphan).alias("orphans"),
        F.count_if(orphan & design).alias("by_design"),
        F.count_if(orphan & ~design).alias("real_gap"),
        pct(F.count_if(orphan & ~design), F.count("*")).alias("real_pct"),
    )


# --- preservation and states -------------------------------------------------------------------


def preservation(conversations: DataFrame, seen: str = "updated_at") -> DataFrame:
    """R33"""
    return conversations.groupBy("is_preserved_missing").agg(
        F.count("*").alias("n"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen")
    )


def oldest_preserved(conversations: DataFrame, k: int = 50, seen: str = "updated_at") -> DataFrame:
    """R33"""
    rows = conversations.filter("is_preserved_missing").orderBy(F.asc_nulls_last(seen), "conversation_id").limit(k)
    return rows.select("conversation_id", "source", seen)


def preserved_by_source(conversations: DataFrame) -> DataFrame:
    """R38"""
    gone, every = total(F.col("is_preserved_missing")), F.count("*")
    each = conversations.groupBy(F.col("source").alias("platform")).agg(gone.alias("preserved"), every.alias("total"), pct(gone, every).alias("pct"))
    return each.filter("preserved > 0")


def states(conversations: DataFrame, flags: list[str], by_source: bool = False) -> DataFrame:
    """By source only groups whose flags add up to more than zero; a null sum drops the group."""
    sums = [total(F.col(c)).alias(c) for c in flags if has_column(conversations, c)]
    if not by_source:
        return conversations.agg(F.count("*").alias("total"), *sums)
    each = conversations.groupBy(F.col("source").alias("platform")).agg(F.count("*").alias("total"), *sums)
    return each.filter(reduce(lambda a, b: a + b, [F.col(c) for c in flags if has_column(conversations, c)]) > 0)


def listing(conversations: DataFrame) -> DataFrame:
    """Every conversation, flat; order it where it is written or shown."""
    return conversations.select(
        "source", "conversation_id", F.col("message_count").alias("msgs"), "model", "project_id",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
        F.col("is_preserved_missing").alias("preserved"),
    )


def source_comparison(conversations: DataFrame) -> DataFrame:
    """The flagship table, one row a source."""
    return conversations.groupBy(F.col("source").alias("platform")).agg(
        F.count("*").alias("convs"),
        F.sum("message_count").alias("msgs_total"),
        F.round(F.avg("message_count"), 1).alias("avg_msgs"),
        total(F.col("is_preserved_missing")).alias("preserved"),
        total(F.col("is_pinned")).alias("pinned"),
        F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("oldest"),
        F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("newest"),
    )


# --- auxiliary tables and bundles --------------------------------------------------------------


def group_lengths(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Rows and mean, largest and total length by a key (outputs by type, notes by kind)."""
    n = F.length(content)
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 1).alias("avg_chars"), F.max(n).cast("long").alias("max_chars")
    )


def recent_rows(df: DataFrame, k: int = 3, width: int = 80, order: str = "created_at", ties: list[str] = ()) -> DataFrame:
    """The newest rows, every cell cut to ``width`` characters."""
    rows = df.orderBy(F.desc_nulls_last(order), *ties).limit(k) if has_column(df, order) else df.limit(k)
    return rows.select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c) for c in df.columns])


def platform_stats(conversations: DataFrame) -> DataFrame:
    """One pass of conditional sums for each platform."""
    gone, linked = F.col("is_preserved_missing"), F.col("project_id").isNotNull()
    return conversations.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(~gone).alias("active"),
        F.count_if(gone).alias("preserved"),
        F.count_if(linked).alias("in_project"),
        F.count_if(~linked).alias("standalone"),
        F.count_distinct("project_id").alias("projects"),
        F.sum("message_count").alias("messages"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def raw_document_stats(nodes: DataFrame) -> DataFrame:
    """The same from raw message nodes (conversation_id, role, model): nodes and models in use."""
    spoken = nodes.filter(F.col("role").isin("user", "assistant"))
    return spoken.groupBy("source").agg(
        F.count_distinct("conversation_id").alias("conversations"),
        F.count("*").alias("message_nodes"),
        F.count_distinct("model").alias("models"),
    )


def project_source_stats(files: DataFrame) -> DataFrame:
    """Files (project_id, file_name?, size, is_preserved_missing) folded by project, then over all."""
    there, gone = F.col("file_name").isNotNull(), F.col("is_preserved_missing")
    each = files.groupBy("project_id").agg(
        F.count_if(there).alias("files"), F.count_if(there & gone).alias("gone"), F.coalesce(F.sum(F.when(there, F.col("size"))), F.lit(0)).alias("bytes")
    )
    return each.agg(
        F.count("*").alias("projects"),
        F.count_if(F.expr("files > 0")).alias("with_files"),
        F.count_if(F.expr("files = 0")).alias("empty"),
        F.count_if(F.expr("files > 0 and gone = files")).alias("all_preserved"),
        F.sum(F.col("files") - F.col("gone")).alias("active_files"),
        F.sum("gone").alias("preserved_files"),
        F.sum("bytes").alias("bytes"),
    )
