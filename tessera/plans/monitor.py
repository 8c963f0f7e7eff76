"""Monitoring over run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GREEN_DAYS, YELLOW_DAYS = 7, 30
DROP_SHARE = 0.8
#: Modes of runs that read a chosen part only.
REFETCH_MODES = ("refetch_known", "refetch_known_fallback")


def truthy(*values: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values])


def _number(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "double").cast("long")


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "string")


def _listed(doc: Column, path: str) -> Column:
    """Length of a list, or of all lists of a map of lists; nothing counts as 0."""
    one = F.size(F.try_variant_get(doc, f"$.{path}", "array<variant>"))
    many = F.try_variant_get(doc, f"$.{path}", "map<string,variant>")
    lists = F.transform(F.map_values(many), lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(0)))
    total = F.aggregate(lists, F.lit(0), lambda a, b: a + F.when(b > 0, b).otherwise(0))
    return F.greatest(F.coalesce(one, F.lit(0)), F.coalesce(total, F.lit(0)), F.lit(0)).cast("long")


def capture_runs(log: DataFrame) -> DataFrame:
    """M1: capture log lines (a ``doc`` variant, other columns pass) in one shape; a duration is derived where none is given."""
    doc = F.col("doc")
    totals = lambda kind: [_number(doc, f"totals.{t}_{kind}") for t in ("threads", "conversations", "notebooks")]
    started = F.coalesce(_text(doc, "run_started_at"), _text(doc, "started_at")).try_cast("timestamp")
    finished = F.coalesce(_text(doc, "run_finished_at"), _text(doc, "finished_at")).try_cast("timestamp")
    took = (F.unix_micros(finished) - F.unix_micros(started)) / 1e6
    return log.filter(doc.isNotNull()).select(
        *[c for c in log.columns if c not in ("doc", "value")],
        started.alias("started_at"),
        finished.alias("finished_at"),
        F.coalesce(F.try_variant_get(doc, "$.duration_seconds", "double"), took).alias("duration_seconds"),
        _text(doc, "mode").alias("mode"),
        _text(doc, "account").alias("account"),
        truthy(_number(doc, "discovery.total"), *totals("discovered"), _number(doc, "discovery_total")).alias("discovery_total"),
        truthy(_number(doc, "fetch.attempted"), *totals("fetched")).alias("fetch_attempted"),
        truthy(_number(doc, "fetch.succeeded"), *totals("fetched")).alias("fetch_succeeded"),
        _listed(doc, "errors").alias("errors"),
    )


def reconcile_runs(log: DataFrame) -> DataFrame:
    """M2: reconcile log lines in one shape; counts stand at the top, with a prefix for some platforms, or below ``conversations``."""
    doc = F.col("doc")
    places = lambda n: (n, f"threads_{n}", f"convs_{n}", f"conversations.{n}", f"totals.{n}")
    count = lambda n: F.coalesce(truthy(*[_number(doc, p) for p in places(n)]), F.lit(0))
    at = F.coalesce(_text(doc, "reconciled_at"), _text(doc, "run_at"), _text(doc, "started_at")).try_cast("timestamp")
    kept = F.greatest(count("preserved_missing"), count("preserved"))
    return log.filter(doc.isNotNull()).select(
        *[c for c in log.columns if c not in ("doc", "value")], at.alias("reconciled_at"), count("added").alias("added"), count("updated").alias("updated"),
        count("copied").alias("copied"), kept.alias("preserved"), _listed(doc, "warnings").alias("warnings"),
    )


def freshness(days: Column) -> Column:
    """M3"""
    return F.when(days.isNull(), "gray").when(days < GREEN_DAYS, "green").when(days < YELLOW_DAYS, "yellow").otherwise("red")


def latest_runs(runs: DataFrame, as_of: Column, key: str = "platform", at: str = "started_at") -> DataFrame:
    """M3: each platform's latest run and how fresh it is at ``as_of``."""
    last = runs.groupBy(key).agg(F.max(at).alias("latest"), F.max_by("discovery_total", at).alias("discovery_total"))
    days = F.expr("timestampdiff(SECOND, latest, __now)") / 86400
    return last.withColumn("__now", as_of).withColumn("freshness", freshness(days)).drop("__now")


def drop_flags(runs: DataFrame, keys: tuple[str, ...] = ("platform", "account"), at: str = "started_at") -> DataFrame:
    """M4: platforms on which some account's latest discovery is below 80 % of its largest.

    Runs that only refetch, and totals of zero, don't count; an account needs two runs.
    """
    real = runs.filter(~F.coalesce(F.col("mode").isin(*REFETCH_MODES), F.lit(False)) & (F.col("discovery_total") > 0))
    each = real.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.max("discovery_total").alias("largest"), F.max_by("discovery_total", at).alias("latest_total")
    )
    dropped = (F.col("runs") >= 2) & (F.col("latest_total") < F.col("largest") * DROP_SHARE)
    return each.groupBy(keys[0]).agg(F.bool_or(dropped).alias("dropped"), F.sum("runs").alias("runs"))


def global_kpis(latest: DataFrame) -> DataFrame:
    """M5: over the platforms' latest runs: how many, the newest and the oldest, and which are overdue."""
    return latest.agg(
        F.count("*").alias("platforms"), F.sum("discovery_total").alias("total"), F.max("latest").alias("latest_sync"),
        F.min_by("platform", "latest").alias("most_outdated"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("freshness") == "red", F.col("platform")))), ",").alias("overdue"),
    )


def discovery_series(runs: DataFrame) -> DataFrame:
    """M6"""
    return runs.filter("discovery_total is not null").select("platform", "started_at", "discovery_total")


def history(runs: DataFrame, k: int = 50, at: str = "started_at") -> DataFrame:
    """M7: the newest runs first."""
    return runs.orderBy(F.desc_nulls_last(at), "platform").limit(k)


def named_top(rows: DataFrame, key: str, names: DataFrame, k: int = 15) -> DataFrame:
    """M7: the most frequent keys with their names; a key without one is its own."""
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)
    return best.join(names.groupBy(key).agg(F.min("name").alias("name")), key, "left").withColumn("name", F.coalesce("name", key))


def stale(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """M8: outputs (name, rendered_at) with an input (name, modified) that is newer, or that were never made."""
    newest = inputs.groupBy("name").agg(F.max("modified").alias("newest_input"))
    joined = newest.join(outputs.groupBy("name").agg(F.max("rendered_at").alias("rendered_at")), "name", "left")
    return joined.withColumn("stale", F.col("rendered_at").isNull() | (F.col("newest_input") > F.col("rendered_at")))


def roster(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known platforms and folders with a plausible name that aren't known."""
    plausible = found.filter(F.col("platform").rlike(r"^[A-Za-z][A-Za-z0-9 ._-]*$"))
    extra = plausible.join(known, "platform", "left_anti").select("platform", F.lit(False).alias("known")).distinct()
    return known.select("platform", F.lit(True).alias("known")).union(extra)


def statistics_source(files: DataFrame) -> DataFrame:
    """Of the files of a platform (platform, path, kind) the one to read: automatic, plain, manual table, then the raw document."""
    order = F.when(F.col("kind") == "automatic", 0).when(F.col("kind") == "plain", 1).when(F.col("kind") == "manual", 2).otherwise(3)
    return files.groupBy("platform").agg(F.min_by("path", F.struct(order, F.col("path"))).alias("path"), F.min_by("kind", F.struct(order, F.col("path"))).alias("kind"))
