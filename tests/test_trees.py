"""Trees of many small files: what tasks write, list and read is what Spark's reader gives."""

import gzip

import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.plans import queries_raw, registry
from tessera.sources import trees


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_same_files_as_of_sparks_reader(spark, tmp_path):
    names = ["a.md", "b.txt", "x/c.md", "x/y/d.md", "x/y/z/w/e.md", "x/.hidden.md", "_drafts/f.md", "k=_1/g.md", "_k=2/h.md", "ü +%41.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}\n\nend")
    (tmp_path / "x" / "empty.md").write_text("")
    ours, theirs = (sources.text_files(spark, f"file://{tmp_path}", "*.md", by_tasks=b) for b in (True, False))
    assert rows(ours, "file_name", "content", "modified") == rows(theirs, "file_name", "content", "modified")
    assert ours.count() == 7 and set(ours.columns) == set(theirs.columns)
    (tmp_path / "z.txt.gz").write_bytes(gzip.compress(b"packed"))
    assert rows(sources.text_files(spark, str(tmp_path), "*.gz", by_tasks=True), "content") == [("packed",)]
    assert rows(sources.text_files(spark, str(tmp_path), "none", by_tasks=True), "content") == []
    with pytest.raises(Exception, match="not.*exist|No such"):
        sources.text_files(spark, str(tmp_path / "lost"), "*", by_tasks=True).collect()


def test_written_files_come_back(spark, tmp_path):
    files = spark.range(50).select(F.concat((F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".json")).alias("path"), F.when(F.col("id") > 0, F.concat(F.lit('{"id":'), "id", F.when(F.col("id") % 5 > 0, "}").otherwise(""))).alias("value"))
    trees.write_files(files, f"file://{tmp_path}/t")
    docs = sources.json_documents(spark, f"file://{tmp_path}/t", by_tasks=True)
    assert docs.count() == 49  # empty files are passed over
    assert sources.rejected(docs).count() == 9


def test_files_are_listed_by_tasks(spark, tmp_path):
    """The plan of a tree has no file names; Spark's reader holds them all in the driver."""
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("x")
    assert len(sources.text_files(spark, str(tmp_path), "*.txt").inputFiles()) == 3
    assert sources.text_files(spark, str(tmp_path), "*.txt", by_tasks=True).inputFiles() == []


@pytest.mark.parametrize("name", ["s08_rejected_documents", "s09_accounts", "s11_text_files"])
def test_queries_do_not_list_files_in_the_driver(spark, tmp_path, name):
    spark.createDataFrame([(k // 2, k % 2, "user", f"t{k}") for k in range(20)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert got.inputFiles() == [] and got.count() == {"s08_rejected_documents": 2, "s09_accounts": 8, "s11_text_files": 20}[name]


def test_repeated_messages_are_files_of_their_own(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b\n")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(registry.QUERIES["s11_text_files"](spark, str(tmp_path)), "message_id", "content") == [("1_0", "a"), ("1_0", "a"), ("1_0", "b")]


def test_accounts_need_no_commit_and_no_folder_for_each_document(spark, tmp_path, monkeypatch):
    """Spark's writer gave each document a folder and moved it there in the driver, which took most of the time."""
    monkeypatch.setattr(queries_raw, "scratch", lambda spark, what: str(tmp_path / what))
    spark.createDataFrame([(k // 2, k % 2, "user", f"t{k}") for k in range(200)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["s09_accounts"](spark, str(tmp_path))
    assert rows(got, "account", "id") == sorted((str(k % 3), f"account-{k % 3}_{k}") for k in range(100) if k % 5)
    files = [p for p in (tmp_path / "accounts").rglob("*") if p.is_file()]
    assert sorted(p.name for p in files) == sorted(f"{k}.txt" for k in range(100)) and len({p.parent for p in files}) == 3
