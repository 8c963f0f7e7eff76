"""Trees of very many small files (S8, S11): tasks write, list and read them, and the driver never holds their names.

Addresses are those that Arrow's file systems open (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tail import _opened

#: Names, and bytes of texts, that a task hands on at once.
NAMES, TEXT_BYTES = 10_000, 4 << 20
#: Levels of folders that are dealt out to tasks one by one; a task lists all that is below.
LEVELS = 2

_ENTRIES = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("micros", pa.int64())])
_TEXTS = pa.schema([("value", pa.string()), ("path", pa.string()), ("file_name", pa.string()), ("micros", pa.int64())])


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.bool_(): "boolean", pa.int64(): "long"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def write_files(files: DataFrame, root: str) -> None:
    """Each row's ``value`` as a file of its own, at ``path`` below ``root``; a null is an empty file.

    A task that runs twice writes the same files again. Of rows with one path, any may be what is there at the end.
    """

    def created(fs: pa.fs.FileSystem, path: str) -> pa.NativeFile:
        try:
            return fs.open_output_stream(path)
        except FileNotFoundError:
            fs.create_dir(path.rpartition("/")[0])
            return fs.open_output_stream(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base, _ = _opened(root)
        for batch in batches:
            for path, value in zip(*(c.to_pylist() for c in batch.columns)):
                with created(fs, f"{base}/{path}") as out:
                    out.write((value or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    dealt = files.select("path", "value").repartition(_tasks(files.sparkSession), "path")
    dealt.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over too."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _listing(root: str, glob: str, below: bool):
    """Entries with each folder replaced by what is in it or, with ``below``, by all files under it."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = _opened(root)[0]
        for batch in batches:
            is_folder = batch.column(1)
            files = batch.filter(pa.compute.invert(is_folder))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(files.columns, _ENTRIES)], schema=_ENTRIES)
            for folder in batch.filter(is_folder).column(0).to_pylist():
                found = fs.get_file_info(pa.fs.FileSelector(folder, recursive=below))
                for k in range(0, len(found), NAMES):
                    rows = [
                        (i.path, not i.is_file, i.mtime_ns // 1_000_000 * 1000 if i.mtime_ns else None) for i in found[k : k + NAMES]
                        if (i.size and fnmatch.fnmatchcase(i.base_name, glob) if i.is_file else not below)
                        and not any(map(_hidden, i.path[len(folder.rstrip("/")) + 1 :].split("/")))
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _ENTRIES)], schema=_ENTRIES)

    return expand


def tree_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(value, path, file_name, modified) of each file below the folder ``root`` whose name fits (``*``, ``?``, ``[...]``).

    The same files as of Spark's reader: empty files, and names that begin with a dot or an underscore, are passed over, what ends in
    ``.gz``, ``.bz2`` or ``.zst`` is unpacked, and times are in milliseconds. ``path`` is the file's plain address, not its URL form; bytes that are no UTF-8
    become replacement characters. A file that goes away while it is read, and a ``root`` that isn't there, fail the query.
    """
    n, base = _tasks(spark), _opened(root)[1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, scheme = _opened(root)
        rows, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TEXTS)], schema=_TEXTS)
        for batch in batches:
            for path, micros in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                with fs.open_input_stream(path) as file:
                    text = file.read()
                rows.append((text.decode("utf-8", "replace"), scheme + path, path.rpartition("/")[2], micros))
                size += len(text)
                if size >= TEXT_BYTES or len(rows) >= NAMES:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    entries = spark.range(1).select(F.lit(base).alias("path"), F.lit(True).alias("is_folder"), F.lit(None).cast("long").alias("micros"))
    for level in range(LEVELS + 1):
        entries = entries.mapInArrow(_listing(root, glob, level == LEVELS), _ddl(_ENTRIES)).repartition(n, "path")
    return entries.mapInArrow(read, _ddl(_TEXTS)).withColumn("modified", F.timestamp_micros("micros")).drop("micros")
