"""Streaming forms (ST1 to ST6) of batch rules; the batch result is what they have to reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.reconcile import Rule, reconcile
from tessera.plans.monitor import DROP_SHARE, REFETCH_MODES
from tessera.sources.tail import tail_lines


def growing_logs(spark: SparkSession, path: str, state: str, glob: str = "*.jsonl", **options: str | int | float) -> DataFrame:
    """ST1: lines of session logs as they are written, (value, path, start, doc), each once.

    What is appended to a file that was read comes with the next batch, whole lines only; ``state`` keeps the bytes read of
    each file beside the checkpoint. ``options`` and the defined cases are those of ``TailSource``.
    """
    return tail_lines(spark, path, state, glob=glob, **options).withColumn("doc", F.try_parse_json("value"))


def once(events: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """ST2: replayed events dropped by key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def calls_with_results(calls: DataFrame, results: DataFrame, delay: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """ST3: calls (session, call_id, called_at) with the result (session, call_id, result_at, is_error) that comes within a time.

    A call without one comes out once the watermark has passed, with a null ``success``.
    """
    c = calls.withWatermark("called_at", delay).alias("c")
    r = results.withWatermark("result_at", delay).alias("r")
    on = (
        (F.col("c.session") == F.col("r.session"))
        & (F.col("c.call_id") == F.col("r.call_id"))
        & (F.col("r.result_at") >= F.col("c.called_at"))
        & (F.col("r.result_at") <= F.col("c.called_at") + F.expr(f"INTERVAL {within}"))
    )
    return c.join(r, on, "left_outer").select("c.session", "c.call_id", "c.called_at", "r.result_at", (~F.col("r.is_error")).alias("success"))


def late_results(calls: DataFrame, results: DataFrame, delay: str = "1 hour", within: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """ST3: results that come after the time in which ``calls_with_results`` waits for them, up to ``keep`` after their call.

    What the join of calls and results has given out as open is given out here again, with the result that was late; so
    counts of matched, open and late calls come from the two streams together. Returns session, call_id, called_at, result_at.
    """
    c = calls.withWatermark("called_at", delay).alias("c")
    r = results.withWatermark("result_at", delay).alias("r")
    on = (
        (F.col("c.session") == F.col("r.session"))
        & (F.col("c.call_id") == F.col("r.call_id"))
        & (F.col("r.result_at") > F.col("c.called_at") + F.expr(f"INTERVAL {within}"))
        & (F.col("r.result_at") <= F.col("c.called_at") + F.expr(f"INTERVAL {keep}"))
    )
    return c.join(r, on).select("c.session", "c.call_id", "c.called_at", "r.result_at")


class BucketedArchive:
    """ST4: an archive below ``path`` whose rows lie in ``buckets`` parts by a hash of the key; a batch writes only the parts it touches.

    Each batch writes its parts to a version of its own, ``v=<batch>/bucket=<k>``, which counts once it is whole (Spark's
    success mark). A bucket is read from its newest whole version, and a batch builds upon versions below its own number; so a batch
    that is run again gives the same, and one that was cut off changes nothing. A bucket's versions that ``keep`` newer ones of that bucket
    replace are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 256, keep: int = 2):
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path, key, buckets, keep
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _listed(self, *parts: str) -> list[str]:
        folder = self._at(*parts) if parts else self._folder
        return [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []

    def versions(self, below: int | None = None) -> dict[int, list[int]]:
        """For each bucket its whole versions below a batch number, oldest first."""
        out: dict[int, list[int]] = {}
        for v in sorted(int(n[2:]) for n in self._listed() if n.startswith("v=")):
            names = self._listed(f"v={v}")
            if "_SUCCESS" in names and (below is None or v < below):
                for n in names:
                    if n.startswith("bucket="):
                        out.setdefault(int(n[7:]), []).append(v)
        return out

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def read(self, below: int | None = None, of: list[int] | None = None) -> DataFrame | None:
        """The archive (of some buckets) as the batches below a number have left it; None if nothing was written."""
        there = self.versions(below)
        chosen = [f"{self.path}/v={there[b][-1]}/bucket={b}" for b in (there if of is None else of) if b in there]
        return self.spark.read.parquet(*chosen) if chosen else None

    def write(self, batch: int, rows: DataFrame) -> None:
        """``rows`` are all rows of the buckets that they lie in."""
        whole = self.bucketed(rows)
        whole.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/v={batch}")
        for bucket, versions in self.versions(batch + 1).items():
            for old in versions[: -self.keep]:
                self._files.delete(self._at(f"v={old}", f"bucket={bucket}"), True)
        for name in self._listed():
            if name.startswith("v=") and int(name[2:]) < batch and not any(n.startswith("bucket=") for n in self._listed(name)):
                self._files.delete(self._at(name), True)


def merge_into_archive(archive: BucketedArchive, rule: Rule, run_date: Callable[[int], str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """ST4: a foreachBatch function that reconciles each micro-batch with the parts of the archive that its keys fall into.

    A batch is a partial snapshot: rows it doesn't show keep their state, stamp and flag. Of a batch's rows with one key the last by
    ``order`` counts, then by all columns.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rest = sorted(c for c in batch.columns if c not in (*archive.key, *order))
        rank = Window.partitionBy(*archive.key).orderBy(*[F.desc_nulls_last(c) for c in (*order, *rest)])
        rows = batch.withColumn("__rank", F.row_number().over(rank)).filter("__rank = 1").drop("__rank")
        touched = [r["bucket"] for r in archive.bucketed(rows).select("bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return
        before = archive.read(number, touched)
        known = rows.limit(0) if before is None else before.drop("action", "is_new")
        archive.write(number, reconcile(rows, known, archive.key, rule, run_date(number), partial=True))

    return merge


def discovery_alerts(runs: DataFrame, share: float = DROP_SHARE, delay: str = "1 day") -> DataFrame:
    """ST5: (platform, account, started_at, discovery_total, largest, dropped) for each run, in order of the time it started.

    The rule of the batch form: refetches and zero totals don't count, the first run raises nothing. A run waits in the state
    until the watermark has passed its time, so runs that come late or in other batches raise what they would have raised
    in order; those that come later than ``delay`` are dropped. State: the largest total so far, and the runs of one delay.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        largest, at, totals = state.get if state.exists else (0, [], [])
        waiting = list(zip(at, totals))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += [(int(t.value // 1000), int(n)) for t, n in zip(rows["started_at"], rows["discovery_total"])]
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        out = []
        while waiting and waiting[0][0] < passed:
            started, total = waiting.pop(0)
            before, largest = largest, max(largest, total)
            out.append((key[0], key[1], pd.Timestamp(started, unit="us"), total, largest, before > 0 and total < largest * share))
        state.update((largest, [t for t, _ in waiting], [n for _, n in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["platform", "account", "started_at", "discovery_total", "largest", "dropped"])

    real = runs.filter(F.col("discovery_total") > 0).filter(~F.coalesce(F.col("mode").isin(*REFETCH_MODES), F.lit(False)))
    real = real.withColumn("account", F.coalesce("account", F.lit(""))).withWatermark("started_at", delay)
    return real.groupBy("platform", "account").applyInPandasWithState(
        step,
        "platform string, account string, started_at timestamp, discovery_total long, largest long, dropped boolean",
        "largest long, at array<long>, totals array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def windowed_counts(events: DataFrame, time: str, key: Column, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """ST6: events for each window and key; late ones count until the watermark passes."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counts = events.withWatermark(time, delay).groupBy(window.alias("w"), key.alias("key")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")


def activity_sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """ST6: runs of activity of a key without a pause of ``gap``."""
    sessions = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return sessions.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
