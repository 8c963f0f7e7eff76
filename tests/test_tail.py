"""The source of appended lines: growth, restarts, cuts, half-written lines."""

import os
import random

import pytest

from tessera.sources.tail import States, TailReader, tail_lines
from tessera.streaming import growing_logs


def lines_of(reader, start, end):
    return [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


def reader(tmp_path, **options):
    return TailReader({"path": f"{tmp_path}/logs", "state": f"{tmp_path}/state", **{k: str(v) for k, v in options.items()}})


def append(tmp_path, name, data):
    os.makedirs(f"{tmp_path}/logs", exist_ok=True)
    with open(f"{tmp_path}/logs/{name}", "ab") as out:
        out.write(data)


@pytest.mark.parametrize("options", [{}, {"split_bytes": 3}, {"max_bytes": 7}, {"split_bytes": 5, "max_bytes": 40}])
def test_every_line_once_whatever_is_written_when(tmp_path, options):
    draw = random.Random(str(options))
    written = {f"{k}.log": b"".join(bytes(draw.choices(b"ab\n\r\xc3", k=draw.randrange(9))) + draw.choice([b"\n", b"\r\n", "ü".encode()]) for _ in range(60)) + b"\n" for k in range(4)}
    at, got, offset, tail = dict.fromkeys(written, 0), [], {"version": 0}, reader(tmp_path, **options)
    while True:
        for name, data in written.items():
            n = draw.randrange(40)
            append(tmp_path, name, data[at[name] : at[name] + n])
            at[name] = min(len(data), at[name] + n)
        if draw.randrange(3) == 0:
            tail = reader(tmp_path, **options)  # a restart
        end = tail.latestOffset()
        new = lines_of(tail, offset, end)
        assert new == lines_of(reader(tmp_path, **options), offset, end)  # a batch that is run again
        tail.commit(end)
        got, offset, done = got + new, end, end == offset
        if done and all(at[k] == len(d) for k, d in written.items()):
            break
    for name, data in written.items():
        own = sorted((r for r in got if r["path"].endswith(name)), key=lambda r: r["start"])
        want = data.removesuffix(b"\n").split(b"\n")
        assert [r["value"] for r in own] == [x.removesuffix(b"\r").decode("utf-8", "replace") for x in want]
        assert [r["start"] for r in own] == [sum(len(x) + 1 for x in want[:k]) for k in range(len(want))]


def test_cut_files_closed_files_and_other_names(tmp_path):
    append(tmp_path, "a.log", b"one\ntwo\nhalf")
    append(tmp_path, "b.txt", b"other\n")
    tail = reader(tmp_path, glob="*.log")
    first = tail.latestOffset()
    assert [r["value"] for r in lines_of(tail, {"version": 0}, first)] == ["one", "two"]
    assert tail.latestOffset() == first  # nothing new
    with open(f"{tmp_path}/logs/a.log", "wb") as out:
        out.write(b"new\n")  # shorter: from its beginning
    second = tail.latestOffset()
    assert [(r["value"], r["start"]) for r in lines_of(tail, first, second)] == [("new", 0)]
    append(tmp_path, "a.log", b"rest")
    assert tail.latestOffset() == second
    os.utime(f"{tmp_path}/logs/a.log", (1, 1))
    closed = reader(tmp_path, glob="*.log", closed_after=60)
    third = closed.latestOffset()
    assert [(r["value"], r["start"]) for r in lines_of(closed, second, third)] == [("rest", 4)]


def test_old_versions_go_and_a_lost_state_is_an_error(tmp_path):
    tail, offset = reader(tmp_path), {"version": 0}
    for k in range(70):
        append(tmp_path, "a.log", f"{k}\n".encode())
        end = tail.latestOffset()
        assert [r["value"] for r in lines_of(tail, offset, end)] == [str(k)]
        tail.commit(end)
        offset = end
    states = States(f"{tmp_path}/state")
    assert len(states._versions("changes")) < 45 and len(states._versions("whole")) == 1
    assert states.latest() == (70, {f"{tmp_path}/logs/a.log": os.path.getsize(f"{tmp_path}/logs/a.log")})
    assert reader(tmp_path).latestOffset() == {"version": 70}
    with pytest.raises(ValueError, match="another checkpoint"):
        tail.partitions({"version": 3}, {"version": 5})


def test_no_folder_and_no_files(tmp_path):
    assert reader(tmp_path).latestOffset() == {"version": 0}
    append(tmp_path, "a.log", b"")
    assert reader(tmp_path).latestOffset() == {"version": 0}


def test_stream_gets_what_is_appended(spark, tmp_path):
    got = []

    def run():
        rows = growing_logs(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/state").select("value", "path", "start", "doc")
        take = lambda batch, _: got.extend(batch.selectExpr("value", "start", "variant_get(doc, '$.n', 'int') AS n").collect())
        rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    append(tmp_path, "s.jsonl", b'{"n":1}\n{"n"')
    run()
    append(tmp_path, "s.jsonl", b":2}\nno json\n")
    append(tmp_path, "t.jsonl", b'{"n":3}\n')
    run()
    run()
    assert sorted((r["value"], r["start"], r["n"]) for r in got) == [("no json", 16, None), ('{"n":1}', 0, 1), ('{"n":2}', 8, 2), ('{"n":3}', 0, 3)]
    assert tail_lines(spark, f"{tmp_path}/logs", f"{tmp_path}/x").columns == ["value", "path", "start"]


@pytest.mark.parametrize("most", [1, 2, 7])
def test_tasks_of_a_batch_stay_few(tmp_path, most):
    """Pieces get longer where a batch would have too many; each line still comes once."""
    (tmp_path / "l").mkdir()
    for name in "ab":
        (tmp_path / "l" / name).write_text("".join(f"{name}{k}\n" for k in range(500)))
    tail = TailReader({"path": f"{tmp_path}/l", "state": f"{tmp_path}/s", "split_bytes": "10", "most_tasks": str(most)})
    end = tail.latestOffset()
    parts = tail.partitions({"version": 0}, end)
    assert len(parts) <= most + 2
    got = [r["value"] for p in parts for b in tail.read(p) for r in b.to_pylist()]
    assert sorted(got) == sorted(f"{name}{k}" for name in "ab" for k in range(500))
