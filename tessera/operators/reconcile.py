"""Snapshot reconcile and preservation (P1 to P26): keyed comparisons that never lose a row.

A *snapshot* is what the server shows now, an *archive* is everything kept so far. Both are keyed;
one full outer join decides each row, and every rule is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

USE, COPY, KEEP = "to_use", "to_copy", "preserved_missing"
SEEN, GONE = "_last_seen_in_server", "_preserved_missing"
RECONCILE_FLOOR = 0.5  # a snapshot below this share of the archive is not trusted
CAPTURE_DROP = 0.20  # a discovery that lost more than this share of the largest one is flagged

#: Says from (current, previous) column getters whether a row that both have has changed.
Rule = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def differs(name: str) -> Rule:
    """A value, null included, is another one."""
    return lambda now, old: ~now(name).eqNullSafe(old(name))


def later(name: str, margin: float = 0.0) -> Rule:
    """A number or time is greater (by more than ``margin``); nothing is later than nothing."""
    if margin:
        return lambda now, old: F.coalesce(now(name) - old(name) > margin, now(name).isNotNull() & old(name).isNull())
    return lambda now, old: F.coalesce(now(name) > old(name), now(name).isNotNull() & old(name).isNull())


def later_text(name: str) -> Rule:
    """A text sorts after the other; null sorts as empty."""
    return lambda now, old: F.coalesce(now(name), F.lit("")) > F.coalesce(old(name), F.lit(""))


def either(*rules: Rule) -> Rule:
    def both(now, old):
        out = F.lit(False)
        for r in rules:
            out = out | r(now, old)
        return out

    return both


def enrichment_differs(name: str, ignore: tuple[str, ...] = (SEEN,)) -> Rule:
    """Of a map of extra fields, any that starts with an underscore differs, those in ``ignore`` aside."""

    def part(c: Column) -> Column:
        kept = F.map_filter(c, lambda k, _: k.startswith("_") & ~k.isin(*ignore))
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))

    return lambda now, old: ~part(now(name)).eqNullSafe(part(old(name)))


# P2h: what changes on every read of a document without its content changing: in its compact JSON, times as
# [seconds, nanoseconds] pairs, addresses with a signature, and the stamp of the last run.
_TOKENS = r'("(?:[^"\\]|\\.)*"|\[1[0-9]{9},[0-9]+\]|[^"\[]+|\[)'
_EPOCH_PAIR = r"^\[1[0-9]{9},[0-9]+\]$"
_PRESIGNED = r'^"https?://[^"]*(googleusercontent|X-Amz-|Signature=|Expires=)[^"]*"$'
_SEEN_FIELD = r'(?<!\\)"_last_seen_in_server":"[^"]*",?'


def canonical_body(body: Column) -> Column:
    """P2h: a JSON text in one compact form without its volatile parts.

    The text is parsed and written again, so blanks and the order of names count within strings only,
    and pairs and addresses are masked as tokens of their own. What is no JSON stays as it is.
    """
    compact = F.regexp_replace(F.to_json(F.try_parse_json(body)), _SEEN_FIELD, "")
    masked = F.transform(
        F.regexp_extract_all(compact, F.lit(_TOKENS), 1),
        lambda t: F.when(t.rlike(_EPOCH_PAIR), "<time>").when(t.rlike(_PRESIGNED), "<signed>").otherwise(t),
    )
    return F.coalesce(F.array_join(masked, ""), body)


def content_differs(name: str) -> Rule:
    """P2h: the bodies differ in more than volatile parts; null against a value is a difference."""
    return lambda now, old: ~F.sha2(canonical_body(now(name)), 256).eqNullSafe(F.sha2(canonical_body(old(name)), 256))


#: P2a to P2h, by source.
RULES: dict[str, Rule] = {
    "chatgpt": either(later("update_time"), enrichment_differs("extra"), differs("title")),
    "claude_ai": either(later_text("updated_at"), differs("name")),
    "perplexity": either(later_text("last_query_datetime"), later("query_count"), differs("title")),
    "qwen": either(later("updated_at"), differs("title")),
    "deepseek": either(later("updated_at", 0.001), differs("title")),
    "gemini": either(later("created_at_secs"), differs("title"), differs("pinned")),
    "grok": either(later_text("modifyTime"), differs("title")),
    "kimi": either(later_text("updateTime"), differs("name")),
    "notebooklm": content_differs("body"),
}


def build_plan(current: DataFrame, previous: DataFrame, key: list[str], rule: Rule, force_all: bool = False) -> DataFrame:
    """Every key of either side with ``action``: to_use, to_copy or preserved_missing, and ``is_new``.

    ``force_all`` (P3) takes every row that is seen.
    """
    joined = _both(current, previous, key)
    now, old = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    return joined.select(
        *[F.coalesce(now(k), old(k)).alias(k) for k in key],
        _action(rule, force_all).alias("action"),
        F.col("o").isNull().alias("is_new"),
    )


def _both(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    n = current.select(F.struct(*current.columns).alias("n"))
    o = previous.select(F.struct(*previous.columns).alias("o"))
    on = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key]
    return n.join(o, on, "full_outer")


def _action(rule: Rule, force_all: bool) -> Column:
    now, old = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    changed = F.lit(True) if force_all else rule(now, old)
    return F.when(F.col("n").isNull(), KEEP).when(F.col("o").isNull() | changed, USE).otherwise(COPY)


def reconcile(
    current: DataFrame, previous: DataFrame, key: list[str], rule: Rule, run_date: str, force_all: bool = False, body: str | None = None, partial: bool = False
) -> DataFrame:
    """The next archive, with ``action``.

    Seen rows take the snapshot's columns where they changed and the archive's otherwise, and are
    stamped; rows that the server no longer shows stay as they are, with their old stamp, and are
    flagged; rows that are back lose the flag. With ``body`` that column falls back to the other
    side's when null (``body_missing`` says if both lack it). A ``partial`` snapshot says nothing about
    the rows that it doesn't show: they are copied with the flag that they had. One shuffle on the key.
    """
    action = _action(rule, force_all)
    joined = _both(current, previous, key).withColumn("action", F.when(F.col("n").isNull(), COPY).otherwise(action) if partial else action)
    have_now, have_old = set(current.columns), set(previous.columns)
    names = [c for c in dict.fromkeys([*current.columns, *previous.columns]) if c not in (SEEN, GONE)]
    use, seen = F.col("action") == USE, F.col("n").isNotNull()

    def value(c: str) -> Column:
        n = F.col(f"n.`{c}`") if c in have_now else F.lit(None)
        o = F.col(f"o.`{c}`") if c in have_old else F.lit(None)
        if c in key:
            return F.coalesce(n, o)
        if c == body:
            return F.when(use, F.coalesce(n, o)).otherwise(F.coalesce(o, n))
        if c not in have_now:
            return o
        if c not in have_old:
            return n
        return F.when(use, n).otherwise(o)

    old_seen = F.col(f"o.{SEEN}") if SEEN in have_old else F.lit(None).cast("string")
    gone = ~seen & F.coalesce(F.col(f"o.{GONE}") if GONE in have_old else F.lit(None).cast("boolean"), F.lit(False))
    out = joined.select(
        *[value(c).alias(c) for c in names],
        F.when(seen, F.lit(run_date)).otherwise(old_seen).alias(SEEN),
        (gone if partial else ~seen).alias(GONE),
        "action",
        F.col("o").isNull().alias("is_new"),
    )
    return out.withColumn("body_missing", F.col(body).isNull()) if body else out


def last_version(log: DataFrame) -> DataFrame:
    """The features version of the last reconcile; a lower one than the current forces a full run."""
    return log.agg(F.max_by("features_version", "reconciled_at").alias("features_version"))


def report(archive: DataFrame) -> DataFrame:
    """Added, updated, copied and preserved rows of a reconciled archive."""
    used, new = F.col("action") == USE, F.col("is_new")
    return archive.agg(
        F.count_if(used & new).alias("added"),
        F.count_if(used & ~new).alias("updated"),
        F.count_if(F.col("action") == COPY).alias("copied"),
        F.count_if(F.col("action") == KEEP).alias("preserved"),
        F.count("*").alias("total"),
    )


# --- preservation flags ------------------------------------------------------------------------


def preserved_if_not_latest(archive: DataFrame, seen: str = "last_seen", strict: bool = False, flag: str | None = None) -> DataFrame:
    """P6 (``strict``: last seen differs from the newest) and P7 (is before it, or ``flag`` says so), P8 with a flag alone."""
    newest = F.broadcast(archive.agg(F.max(seen).alias("__newest")))  # one row
    apart = F.col(seen) != F.col("__newest") if strict else F.col(seen) < F.col("__newest")
    marked = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    return archive.join(newest).withColumn("is_preserved_missing", marked | F.coalesce(apart, F.lit(False))).drop("__newest")


def preserved_files(threads: DataFrame, listing: DataFrame) -> DataFrame:
    """(conversation_id, is_preserved_missing) of file-backed sessions.

    ``threads`` has (conversation_id, parent_session_id?, file); a session is missing when none of its
    files, its sub-sessions' included, is listed. An empty listing says nothing: no session is missing.
    """
    own = threads.select("conversation_id", "file")
    below = threads.filter("parent_session_id is not null").select(F.col("parent_session_id").alias("conversation_id"), "file")
    files = own.union(below.join(own.select("conversation_id").distinct(), "conversation_id", "left_semi"))
    there = listing.select("file").distinct().withColumn("__there", F.lit(True))
    any_listed = F.broadcast(listing.agg((F.count("*") > 0).alias("__any")))  # one row
    found = files.join(there, "file", "left").groupBy("conversation_id").agg(F.bool_or(F.coalesce("__there", F.lit(False))).alias("__found"))
    return found.join(any_listed).select("conversation_id", (F.col("__any") & ~F.col("__found")).alias("is_preserved_missing"))


def active_today(archive: DataFrame, run_date: str, seen: str = SEEN) -> DataFrame:
    """P10: rows whose stamp begins with the run's date are active."""
    return archive.withColumn("is_active", F.coalesce(F.col(seen).startswith(run_date), F.lit(False)))


def cumulative_index(current: DataFrame, previous: DataFrame, key: list[str], flag: str = GONE) -> DataFrame:
    """The current index and, flagged, what only the previous one has."""
    lost = previous.drop(flag).join(current.select(*key).distinct(), key, "left_anti").withColumn(flag, F.lit(True))
    return current.drop(flag).withColumn(flag, F.lit(False)).unionByName(lost, allowMissingColumns=True)


def membership(current: DataFrame, previous: DataFrame, everywhere: DataFrame, group: str, member: str) -> DataFrame:
    """Members of groups with orphan, removed_from_group and preserved_from_previous.

    In the group but nowhere else: orphan. No longer in the group but still somewhere: removed. Gone
    from both: orphan and preserved.
    """
    keys = [group, member]
    both = current.select(*keys, F.lit(True).alias("__now")).distinct().join(previous.select(*keys, F.lit(True).alias("__old")).distinct(), keys, "full_outer")
    known = everywhere.select(member).distinct().withColumn("__known", F.lit(True))
    now, there = F.col("__now").isNotNull(), F.col("__known").isNotNull()
    return both.join(known, member, "left").select(
        *keys, (~there).alias("orphan"), (~now & there).alias("removed_from_group"), (~now & ~there).alias("preserved_from_previous")
    )


def merge_files(current: DataFrame, previous: DataFrame, run_date: str, key: tuple[str, ...] = ("project_id", "file_id")) -> DataFrame:
    """Files of projects; those that are gone stay, with the date on which that was first seen.

    ``newly_preserved`` marks those that this run found gone.
    """
    keys = list(key)
    had = "preserved_since" in previous.columns
    lost = previous.join(current.select(*keys).distinct(), keys, "left_anti")
    since = F.col("preserved_since") if had else F.lit(None).cast("string")
    lost = lost.withColumn("newly_preserved", since.isNull()).withColumn("preserved_since", F.coalesce(since, F.lit(run_date)))
    kept = current.withColumn("preserved_since", F.lit(None).cast("string")).withColumn("newly_preserved", F.lit(False))
    return kept.unionByName(lost, allowMissingColumns=True)


# --- guards and selection ----------------------------------------------------------------------


class DropTooLarge(RuntimeError):
    """A snapshot is so much smaller than the archive that it isn't trusted."""


def guard_reconcile(current_rows: int, previous_rows: int, floor: float = RECONCILE_FLOOR) -> None:
    """Stop before anything is written if the snapshot fell below ``floor`` of the archive."""
    if previous_rows and current_rows / previous_rows < floor:
        raise DropTooLarge(f"{current_rows} rows against {previous_rows} before")


@dataclass
class Written:
    """What a guarded write counted while it wrote, and the version that is current after it."""

    version: int
    rows: int
    seen: int
    before: int
    actions: dict[str, int]


class VersionedArchive:
    """An archive of whole versions below ``path``; the newest accepted one is current.

    A version is written first and accepted afterwards, by the counts that the write itself has observed, so the rows are
    made once. One that isn't accepted is deleted; one that a lost driver left without a mark counts for nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self, what: str) -> list[int]:
        there = [f.getPath().getName() for f in self._fs.listStatus(self._file())] if self._fs.exists(self._file()) else []
        return sorted(int(n[len(what) :]) for n in there if n.startswith(what))

    def current(self) -> int:
        """The newest accepted version; 0 is the empty archive before the first."""
        return max([0, *self._numbers("accepted=")])

    def read(self) -> DataFrame | None:
        version = self.current()
        return self.spark.read.parquet(f"{self.path}/v={version}") if version else None

    def reconcile(
        self, snapshot: DataFrame, key: list[str], rule: Rule, run_date: str, floor: float = RECONCILE_FLOOR, largest_capture: int | None = None, drop: float = CAPTURE_DROP, **settings
    ) -> Written:
        """The next version from ``snapshot``, or ``DropTooLarge`` with the archive as it was.

        Refused are snapshots below ``floor`` of the archive's rows (P14), and, where the largest capture so far is given, those that
        have lost more than ``drop`` of it (P15).
        """
        before = self.read()
        version = max([0, *self._numbers("v="), *self._numbers("accepted=")]) + 1
        old = snapshot.limit(0) if before is None else before.drop("action", "is_new")
        merged = reconcile(snapshot, old, key, rule, run_date, **settings)
        counts = Observation()
        kinds = {k: F.count_if(F.col("action") == k).alias(k) for k in (USE, COPY, KEEP)}
        observed = merged.observe(counts, F.count("*").alias("rows"), F.count_if(~F.col("is_new")).alias("before"), *kinds.values())
        observed.write.mode("error").parquet(f"{self.path}/v={version}")
        got = counts.get
        found = Written(version, got["rows"], got["rows"] - got[KEEP], got["before"], {k: got[k] for k in kinds})
        try:
            guard_reconcile(found.seen, found.before, floor)
            if largest_capture and (largest_capture - found.seen) / largest_capture > drop:
                raise DropTooLarge(f"{found.seen} rows against {largest_capture} in the largest capture")
        except DropTooLarge:
            self._fs.delete(self._file(f"v={version}"), True)
            raise
        self._fs.create(self._file(f"accepted={version}")).close()
        return found


def capture_drop(log: DataFrame, current_total: int, limit: float = CAPTURE_DROP) -> DataFrame:
    """Largest discovery so far, and whether the current one lost more than ``limit`` of it."""
    most = log.agg(F.max("discovery_total").alias("largest"))
    return most.select("largest", F.coalesce((F.col("largest") - current_total) / F.nullif(F.col("largest"), F.lit(0)) > limit, F.lit(False)).alias("dropped"))


def incremental_targets(listing: DataFrame, previous: DataFrame, cutoff: Column, key: str = "id") -> DataFrame:
    """Ids that are unseen, were updated after ``cutoff``, or have another title."""
    old = previous.select(key, F.col("title").alias("__title"), F.lit(True).alias("__seen"))
    wanted = F.col("__seen").isNull() | F.coalesce(F.col("update_time") > cutoff, F.lit(False)) | ~F.col("title").eqNullSafe(F.col("__title"))
    return listing.join(old, key, "left").filter(wanted).select(key)


def tagged_targets(listing: DataFrame, stored: DataFrame, tag: str, key: str = "id") -> DataFrame:
    """Ids whose tag differs from the stored one or whose body is missing."""
    old = stored.select(key, F.col(tag).alias("__tag"), "body")
    return listing.join(old, key, "left").filter(~F.col(tag).eqNullSafe(F.col("__tag")) | F.col("body").isNull()).select(key)


def overlay(archive: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Known rows with newly read bodies; the archive's ``extra`` entries that start with an underscore stay.

    ``updates`` has (key, body, extra, error?); unknown ids and failed reads change nothing.
    """
    new = updates.filter("error is null").select(key, F.col("body").alias("__body"), F.col("extra").alias("__extra"), F.lit(True).alias("refreshed"))
    own = F.map_filter("extra", lambda k, _: k.startswith("_"))
    fresh = F.map_filter("__extra", lambda k, _: ~F.array_contains(F.map_keys(own), k))
    return (
        archive.join(new, key, "left")
        .withColumn("extra", F.when(F.col("refreshed"), F.map_concat(fresh, own)).otherwise(F.col("extra")))
        .withColumn("body", F.coalesce("__body", "body"))
        .withColumn("refreshed", F.coalesce("refreshed", F.lit(False)))
        .drop("__body", "__extra")
    )


def discovered(parts: list[tuple[DataFrame, str]], key: str = "id") -> DataFrame:
    """P20: ids of several listings; a later listing's row wins. Shared items carry the conversation's id."""
    ranked = None
    for place, (rows, name) in enumerate(parts):
        own = rows.withColumn("listing", F.lit(name)).withColumn("__place", F.lit(place))
        if "conversation_id" in rows.columns:
            own = own.withColumn(key, F.coalesce("conversation_id", key)).drop("conversation_id")
        ranked = own if ranked is None else ranked.unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__place"), "title")
    return ranked.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__place")


def inferred_groups(members: DataFrame, groups: DataFrame, group: str = "group_id", prefix: str = "g-p-") -> DataFrame:
    """Project ids that members name and no listing has."""
    named = members.filter(F.col(group).startswith(prefix)).select(group).distinct()
    return named.join(groups.select(group), group, "left_anti")


def groups_of_members(groups: DataFrame, members: DataFrame, pinned: DataFrame, member: str = "id") -> DataFrame:
    """Members with the sorted list of their groups and whether they are pinned. ``groups`` has (group_id, member)."""
    lists = groups.groupBy(member).agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    pins = pinned.select(member).distinct().withColumn("is_pinned", F.lit(True))
    none = F.array().cast("array<string>")
    joined = members.join(lists, member, "left").join(pins, member, "left")
    return joined.withColumn("groups", F.coalesce("groups", none)).withColumn("is_pinned", F.coalesce("is_pinned", F.lit(False)))


def is_truncated(declared: Column, present: Column) -> Column:
    """A document that declares more than five nodes and holds one at most."""
    return (declared > 5) & (present <= 1)


def payload_changed(files: DataFrame, latest: DataFrame, group: str = "source") -> DataFrame:
    """One digest for each group over its (path, digest) pairs, and whether it is new.

    ``files`` has (group, path, digest of the content): bytes are hashed where they are read. Pairs fall
    into 4096 parts by a hash of the path; a part's digest is over its sorted pairs, a group's over its parts.
    """
    joined = lambda items: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda p: F.concat_ws("\u0000", p["a"], p["b"])), "\n"), 256)
    part = F.substring(F.sha2("path", 256), 1, 3)
    parts = files.groupBy(group, part.alias("__part")).agg(joined(F.struct(F.col("path").alias("a"), F.col("digest").alias("b"))).alias("__digest"))
    each = parts.groupBy(group).agg(joined(F.struct(F.col("__part").alias("a"), F.col("__digest").alias("b"))).alias("content_hash"))
    old = latest.select(group, F.col("content_hash").alias("__old"))
    return each.join(old, group, "left").withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("__old"))).drop("__old")


def accumulate_children(children: DataFrame, existing: DataFrame, chosen: DataFrame, parent: str, key: list[str]) -> DataFrame:
    """P25: what exists, and children of chosen parents that don't exist yet; nothing is overwritten."""
    new = children.join(chosen.select(parent).distinct(), parent, "left_semi").join(existing.select(*key), key, "left_anti")
    return existing.unionByName(new.dropDuplicates(key), allowMissingColumns=True)


@dataclass
class Index:
    """The slim columns of a listing by source, as (key, columns)."""

    columns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "claude_ai": ("uuid", "name", "updated_at"),
            "perplexity": ("uuid", "title", "last_query_datetime", "query_count"),
            "qwen": ("id", "title", "updated_at"),
            "deepseek": ("id", "title", "updated_at", "pinned"),
            "gemini": ("uuid", "title", "created_at_secs", "pinned"),
            "grok": ("conversationId", "title", "modifyTime"),
            "kimi": ("id", "name", "updateTime"),
            "notebooklm": ("uuid", "title"),
        }
    )

    def slim(self, source: str, listing: DataFrame) -> DataFrame:
        """The index columns of a listing, rows without a key left out."""
        names = self.columns[source]
        return listing.filter(F.col(names[0]).isNotNull()).select(*[c for c in names if c in listing.columns])
