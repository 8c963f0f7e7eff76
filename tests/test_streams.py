"""Streams that get their rows in several batches, late, twice or cut off."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.operators import reconcile
from tessera.plans import monitor


def fed(spark, folder, parts, schema, plan):
    """What ``plan`` has given out after each of ``parts``, a run for each."""
    out = []
    for rows in parts:
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")]).write.mode("append").parquet(f"{folder}/in")
        stream = plan(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()), key=repr))
    return out


# --- ST5 ---------------------------------------------------------------------------------------

RUNS = "platform string, account string, started_at timestamp, discovery_total long, mode string"


def test_alerts_wait_for_the_watermark_and_keep_the_order(spark, tmp_path):
    day = lambda k: f"2025-01-{k:02d}"
    parts = [
        [("p", "1", day(3), 60, None), ("p", "1", day(1), 100, "full")],
        [("p", "1", day(2), 90, None), ("p", "1", day(5), 70, "refetch_known_fallback"), ("p", "1", day(9), 200, "refetch"), ("q", None, day(9), 5, None)],
        [("p", "1", day(20), 1, None), ("q", None, day(20), 1, None), ("p", "1", day(1), 999, None)],
        [("p", "1", day(30), 1, None)],
    ]
    got = fed(spark, tmp_path, parts, RUNS, lambda s: streaming.discovery_alerts(s, delay="4 days"))
    flat = lambda rows: [(r[0], r[2].day, r[3], r[4], r[5]) for r in rows]
    assert flat(got[0]) == []
    assert flat(got[1]) == [("p", 1, 100, 100, False), ("p", 2, 90, 100, False), ("p", 3, 60, 100, True)]
    # The run of the first day that comes in the third batch is later than the watermark allows.
    assert sorted(flat(got[-1])) == [("p", 1, 100, 100, False), ("p", 2, 90, 100, False), ("p", 3, 60, 100, True), ("p", 9, 200, 200, False), ("p", 20, 1, 200, True), ("q", 9, 5, 5, False), ("q", 20, 1, 5, True)]


def test_alerts_in_any_batches_equal_the_batch_rule(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"p{k % 3}", str(k % 2), f"2025-01-{1 + k // 8:02d} {k % 8 * 3:02d}:00:00", draw.randrange(1, 200), draw.choice([None, "full", "refetch_known"])) for k in range(160)]
    draw.shuffle(rows)
    end = [(f"p{k % 3}", str(k % 2), "2030-01-01", 1, None) for k in range(6)]
    got = fed(spark, tmp_path, [rows[:50], rows[50:90], rows[90:], end], RUNS, lambda s: streaming.discovery_alerts(s, delay="60 days"))[-1]
    want = []
    for key in {(p, a) for p, a, *_ in rows}:
        largest = 0
        for _, _, at, total, _ in sorted((r for r in rows if r[:2] == key and r[4] != "refetch_known"), key=lambda r: r[2]):
            want.append((*key, at, total, max(largest, total), largest > 0 and total < largest * 0.8))
            largest = max(largest, total)
    assert sorted((r[0], r[1], str(r[2]), r[3], r[4], r[5]) for r in got) == sorted(want)


def test_modes_that_read_a_part_are_the_same_in_both_forms(spark):
    rows = spark.createDataFrame([("p", "a", 1, 100, "full"), ("p", "a", 2, 5, "refetch_known_fallback"), ("p", "a", 3, 5, "refetch_known"), ("q", "a", 1, 100, None), ("q", "a", 2, 50, "refetch")], "platform string, account string, started_at long, discovery_total long, mode string")
    assert sorted(map(tuple, monitor.drop_flags(rows).collect())) == [("p", False, 1), ("q", True, 2)]


# --- ST4 ---------------------------------------------------------------------------------------


def archive_of(spark, path, **settings):
    archive = streaming.BucketedArchive(spark, str(path), ["id"], **settings)
    merge = streaming.merge_into_archive(archive, reconcile.later("t"), lambda n: f"d{n}", ["t"])
    return archive, lambda number, rows: merge(spark.createDataFrame(rows, "id string, t long, x string"), number)


def state(archive, **of):
    rows = archive.read(**of)
    return {} if rows is None else {r["id"]: (r["t"], r["x"], r[reconcile.SEEN], r[reconcile.GONE]) for r in rows.collect()}


def test_batches_again_and_cut_off(spark, tmp_path):
    archive, merge = archive_of(spark, tmp_path / "a", buckets=4)
    merge(0, [(f"k{i}", 1, "old") for i in range(20)])
    merge(1, [("k1", 2, "new"), ("k1", 1, "older"), ("n", 1, "first")])
    before = state(archive)
    assert before["k1"] == (2, "new", "d1", False) and before["n"] == (1, "first", "d1", False) and before["k2"] == (1, "old", "d0", False) and len(before) == 21
    merge(1, [("k1", 2, "new"), ("k1", 1, "older"), ("n", 1, "first")])  # again, as after a failure
    assert state(archive) == before
    merge(2, [("k2", 5, "cut")])
    os.remove(tmp_path / "a" / "v=2" / "_SUCCESS")  # the write was cut off
    assert state(archive) == before
    merge(2, [("k2", 5, "whole")])
    assert state(archive)["k2"] == (5, "whole", "d2", False) and {k: v for k, v in state(archive).items() if k != "k2"} == {k: v for k, v in before.items() if k != "k2"}
    merge(3, [])
    assert state(archive)["k2"][1] == "whole" and state(archive, below=2) == before


def test_rows_of_one_key_in_any_order_give_the_same(spark, tmp_path):
    rows = [("a", 1, x) for x in "cab"] + [("a", None, "z"), ("b", 2, "p"), ("b", 2, "q")]
    got = []
    for k, order in enumerate((rows, rows[::-1])):
        archive, merge = archive_of(spark, tmp_path / str(k), buckets=2)
        merge(0, order)
        got.append(state(archive))
    assert got[0] == got[1] == {"a": (1, "c", "d0", False), "b": (2, "q", "d0", False)}


def test_a_batch_writes_the_parts_it_touches_and_old_versions_go(spark, tmp_path):
    archive, merge = archive_of(spark, tmp_path / "a", buckets=32)
    merge(0, [(f"k{i}", 1, "old") for i in range(500)])
    size = lambda v: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "a" / f"v={v}") for f in names if f.startswith("part"))
    whole = size(0)
    for n in range(1, 6):
        merge(n, [("k7", n + 1, f"new{n}")])
        assert size(n) < whole / 10
    assert state(archive)["k7"] == (6, "new5", "d5", False) and len(state(archive)) == 500
    touched = [b for b, versions in archive.versions().items() if versions[-1] == 5]
    assert len(touched) == 1 and archive.versions()[touched[0]] == [4, 5] and len(archive.versions()) == 32
    assert sorted(n for n in os.listdir(tmp_path / "a") if n.startswith("v=")) == ["v=0", "v=4", "v=5"]


# --- ST3 ---------------------------------------------------------------------------------------


def test_late_results_are_counted_beside_open_calls(spark, tmp_path):
    calls = spark.sql("select 's' session, id call_id, timestamp'2025-01-01 00:00:00' called_at from values ('in time'), ('late'), ('never'), ('too late') v(id) union all select 'e', 'end', timestamp'2025-02-01 00:00:00'")
    results = spark.sql("select 's' session, id call_id, timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) result_at, false is_error from values ('in time', 1), ('late', 3), ('too late', 30) v(id, h) union all select 'e', 'x', timestamp'2025-02-01 00:00:00', false")
    got = {}
    for name, plan in (("joined", streaming.calls_with_results), ("late", streaming.late_results)):
        for k, df in (("c", calls), ("r", results)):
            df.write.parquet(f"{tmp_path}/{name}/{k}")
        c, r = spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/{name}/c"), spark.readStream.schema(results.schema).parquet(f"{tmp_path}/{name}/r")
        plan(c, r).writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start().awaitTermination()
        got[name] = spark.read.parquet(f"{tmp_path}/{name}/out")
    assert {r["call_id"]: r["success"] for r in got["joined"].filter("session = 's'").collect()} == {"in time": True, "late": None, "never": None, "too late": None}
    assert [r["call_id"] for r in got["late"].collect()] == ["late"]


# --- ST6 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("plan", ["windows", "sessions"])
def test_rows_beyond_the_watermark_are_the_only_difference(spark, tmp_path, plan):
    schema = "at timestamp, who string"
    day = lambda k, h: f"2025-01-{k:02d} {h:02d}:00:00"
    parts = [[(day(1, 0), "a"), (day(10, 0), "b")], [(day(1, 1), "a"), (day(9, 20), "b"), (day(9, 23), "b")], [(day(25, 0), "end")], [(day(25, 1), "end")]]
    run = (lambda s: streaming.windowed_counts(s, "at", F.col("who"), "1 day")) if plan == "windows" else (lambda s: streaming.activity_sessions(s, "at", "who", "2 hours"))
    got = [(r[0].day, r[-2], r[-1]) for r in fed(spark, tmp_path, parts, schema, run)[-1]]
    # The second row of a comes when the watermark stands at the ninth day; those of b are in time.
    assert sorted(got) == ([(1, "a", 1), (9, "b", 2), (10, "b", 1)] if plan == "windows" else [(1, "a", 1), (9, "b", 1), (9, "b", 2)])


# --- P14, P15, S16, S13 -------------------------------------------------------------------------


def test_a_refused_version_leaves_the_archive_and_rows_are_made_once(spark, tmp_path):
    archive = reconcile.VersionedArchive(spark, str(tmp_path / "a"))
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    def snapshot(n, t):
        return spark.range(n).selectExpr("cast(id as string) id", f"{t} t").mapInPandas(counted, "id string, t int")

    write = lambda n, t, **more: archive.reconcile(snapshot(n, t), ["id"], reconcile.later("t"), f"d{t}", **more)
    first = write(100, 1)
    assert (first.version, first.rows, first.seen, first.before) == (1, 100, 100, 0) and made.value == 100
    with pytest.raises(reconcile.DropTooLarge, match="49 rows against 100"):
        write(49, 2)
    assert made.value == 149 and archive.current() == 1 and archive.read().count() == 100 and not (tmp_path / "a" / "v=2").exists()
    with pytest.raises(reconcile.DropTooLarge, match="largest capture"):
        write(79, 2, largest_capture=100)
    third = write(80, 2, largest_capture=100)
    assert third.actions == {"to_use": 80, "to_copy": 0, "preserved_missing": 20} and archive.read().filter(reconcile.GONE).count() == 20
    (tmp_path / "a" / "v=9").mkdir()  # a driver that was lost
    assert archive.current() == third.version and write(80, 3).version == 10


def test_run_logs_of_both_layouts(spark, tmp_path):
    def put(place, *lines):
        (tmp_path / "logs of runs" / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "logs of runs" / place).write_text("\n".join(lines))

    put("p/log.jsonl", '{"added": 1}', "", "{broken")
    put("p/account-1/log.jsonl", '{"added": 100}')
    put("q/account-1/log.jsonl", '{"threads_added": 2, "warnings": [1]}')
    put("q/other/log.jsonl", '{"convs_preserved_missing": 3}')
    put("q/account-1/deeper/log.jsonl", '{"added": 100}')
    put("q/account-1/else.jsonl", '{"added": 100}')
    from tessera import sources

    log = sources.run_logs(spark, str(tmp_path / "logs of runs"), "log.jsonl")
    runs = monitor.reconcile_runs(log).select("platform", "folder", "account", "added", "preserved", "warnings").collect()
    assert sorted(map(tuple, runs), key=repr) == [("p", None, None, 1, 0, 0), ("q", "account-1", "1", 2, 0, 1), ("q", "other", None, 0, 3, 0)]
    assert [tuple(r) for r in sources.rejected_lines(log).collect()] == [("p", None, "{broken")]
