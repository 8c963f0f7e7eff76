"""One JSON map read in splits equals the map read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import sources


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(draw, deep=0):
    kind = draw.randrange(9 if deep < 3 else 5)
    if kind < 3:
        return "".join(draw.choices('ab{}[]",:\\\n\t ü/', k=draw.randrange(12)))
    if kind < 5:
        return draw.choice([None, True, 3, -1.5])
    if kind < 7:
        return [value(draw, deep + 1) for _ in range(draw.randrange(4))]
    return {f"{value(draw, 9)}{k}": value(draw, deep + 1) for k in range(draw.randrange(4))}


def snapshot(draw, docs):
    root = [("conversations", docs)] + [(name, value(draw)) for name in ("list", "map", 'odd "}', "text")]
    root += [("many", [value(draw, 1) for _ in range(6)]), ("other", {f"conversations{k}": {"x": {}} for k in range(5)})]
    draw.shuffle(root)
    text = json.dumps(dict(root[: draw.randrange(1, 8)]) | {"conversations": docs}, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1]))
    return draw.choice(["", "\n "]) + text + draw.choice(["", "\n", "  \n\n"])


def got(spark, folder):
    return sorted((r["id"], json.dumps(json.loads(r["doc"]), sort_keys=True)) for r in sources.json_map(spark, str(folder)).select("id", F.to_json("doc").alias("doc")).collect())


def test_any_snapshot_in_any_splits(spark, tmp_path, small_splits):
    want = []
    for seed in range(24):
        draw = random.Random(seed)
        docs = {f"{seed}/{k}{value(draw, 9)}": value(draw) if k % 4 else {"t": value(draw)} for k in range(draw.randrange(9))}
        (tmp_path / f"{seed}.json").write_text(snapshot(draw, docs))
        want += [(k, json.dumps(v, sort_keys=True)) for k, v in docs.items()]
    assert sources.json_map(spark, str(tmp_path)).rdd.getNumPartitions() >= 1
    assert got(spark, tmp_path) == sorted(want)


def test_only_the_fields_own_entries(spark, tmp_path, small_splits):
    text = '{"a":[{"conversations":{"no":{}}},{"x":[{}]}],"conversations":{"1":{"conversations":{"no":{}}},"2":[{},{}],"3":"}"},"b":{"no":{},"no2":{}},"c":[{},{}]}'
    (tmp_path / "a.json").write_text(text)
    assert [k for k, _ in got(spark, tmp_path)] == ["1", "2", "3"]
    (tmp_path / "a.json").write_text('{"conversations":null}')
    (tmp_path / "b.json").write_text('{"b":{"conversations":{"no":{}}}}')
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text('{"conversations":{}}')
    assert got(spark, tmp_path) == []


@pytest.mark.parametrize("text", ['{"conversations":{"a":{}}', '{"conversations":{"a":{},"b"}}', '{"conversations":{"a":{}}}}', '{"conversations":{"a":{} {}}}', '[{"conversations":{}}]', '{"conversations":{"a":"}}', '{"conversations":{"a":{}},"x":', "7"])
def test_what_is_no_json_is_an_error(spark, tmp_path, small_splits, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED"):
        got(spark, tmp_path)


def test_plan_has_no_python_and_many_tasks(spark, tmp_path, small_splits):
    docs = {str(k): {"title": "x" * 40} for k in range(400)}
    (tmp_path / "a.json").write_text(json.dumps({"conversations": docs}))
    df = sources.json_map(spark, str(tmp_path))
    assert len(df.select("id").distinct().collect()) == 400
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 100
