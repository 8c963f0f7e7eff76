"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of ids, in ascending order, one frame a document (its ids
as little-endian unsigned 32-bit integers). After the frames come two skippable frames, so that any
zstandard decoder reads the file as the plain run of ids:

* the directory: for each document its id (signed 64-bit), then for each document a byte, 0 where it has no id;
* the seek table of the public seekable format: compressed size, decompressed size and checksum
  (low 32 bits of the frame content's XXH64) of each frame, then the number of frames, a flag byte
  and the magic number.

A reader takes the table from the end of the file, and from there only the frames it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.tokenizing import cached_encoder

# Fixed values of the public seekable zstandard format.
SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
#: Bytes of text that a file holds on average, at most.
FILE_BYTES = 128 << 20
_BATCH_BYTES = 1 << 22


class Corrupt(ValueError):
    """A file whose table or a frame's checksum doesn't fit."""


class FrameWriter:
    """Writes one file; at any time it holds one frame and twenty bytes for each document before."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        directory = np.array([i or 0 for i in self.ids], "<i8").tobytes() + bytes(i is not None for i in self.ids)
        table = np.array(self.entries, _ENTRY).tobytes()
        table += struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(directory)) + directory)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)


class FrameReader:
    """Reads the directory and single frames of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise Corrupt("no seek table at the end")
        start = size - 9 - count * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(start, count * _ENTRY.itemsize), _ENTRY)
        directory = self._at(start - 8 - 9 * count, 9 * count)
        self.ids, self.has_id = np.frombuffer(directory, "<i8", count), np.frombuffer(directory, bool, count, 8 * count)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        packed, plain, checksum = (int(x) for x in self.entries[k])
        ids = self.unpacker.decompress(self._at(int(self.starts[k]), packed), max_output_size=max(plain, 1))
        if len(ids) != plain or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != checksum:
            raise Corrupt(f"frame {k} doesn't fit its checksum")
        return ids


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    level: int = 3,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids to ``path`` in order of doc_id.

    ``path`` is a URI that driver and executors share. A file is written under a name of its own
    and renamed when complete, so a task that runs twice leaves one whole file. Files hold about ``FILE_BYTES`` of text at most,
    unless ``partitions`` says how many there are. Returns (and stores)
    the manifest: part, file, n_docs, n_tokens, start (ids in all files before).

    Defined cases: a null text counts as empty and gives the end id alone; a null id sorts first and
    comes back as null; rows with equal ids are all written, ordered by text; an empty table writes
    no file; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    if partitions is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = cached_encoder(tokenizer_path)
        writer = out = None
        tokens = 0
        fs, folder = _filesystem(path)
        name = f"{folder}/part-{part:06d}.tokz"
        draft = f"{folder}/.draft-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for ids, texts in _small_batches(batch):
                for doc_id, encoded in zip(ids, encoder.encode(texts)):
                    if writer is None:
                        fs.create_dir(folder, recursive=True)
                        out = fs.open_output_stream(draft)
                        writer = FrameWriter(out, level)
                    writer.add(doc_id, encoded + end)
                    tokens += len(encoded) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [f"part-{part:06d}.tokz"], "n_docs": [len(writer.ids)], "n_tokens": [tokens]},
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    manifest = stored(
        # An id's rows may be cut where their texts' beginnings differ, which keeps them in order.
        rows.repartitionByRange(partitions, "doc_id", F.substring("text", 1, 16))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "part int, file string, n_docs long, n_tokens long"),
        "token-manifest",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _small_batches(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _BATCH_BYTES, side="right")))
        yield batch.column(0)[start:stop].to_pylist(), batch.column(1)[start:stop].to_pylist()
        start = stop


def read_token_files(manifest: DataFrame, path: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of the files in ``manifest``: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    With ``doc_ids`` only the frames of these documents are read and decompressed. Every frame's
    checksum is verified; one that doesn't fit fails the task.
    """
    spark: SparkSession = manifest.sparkSession
    wanted = None if doc_ids is None else np.unique(np.array(doc_ids, np.int64))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    fields += [("ids", pa.list_(pa.int64()))] * with_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as source:
                    reader = FrameReader(source)
                    counts = reader.entries["plain"].astype(np.int64) // 4
                    starts = start + np.concatenate([[0], np.cumsum(counts)])
                    chosen = np.arange(len(counts)) if wanted is None else np.flatnonzero(np.isin(reader.ids, wanted) & reader.has_id)
                    for some in np.array_split(chosen, max(1, len(chosen) // 512)):
                        frames = [reader.frame(int(k)) for k in some]
                        ids = pa.array(reader.ids[some], mask=~reader.has_id[some])
                        columns = [ids, starts[some], counts[some], [zlib.crc32(x) for x in frames]]
                        if with_ids:
                            columns.append([np.frombuffer(x, "<u4").astype(np.int64) for x in frames])
                        yield pa.RecordBatch.from_arrays(
                            [c if c is ids else pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]
                        )

    files = manifest.select("file", "start")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, schema)
