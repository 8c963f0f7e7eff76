"""A streaming source of lines that are appended to growing files; its offsets are the bytes read of each file."""

from __future__ import annotations

import fnmatch
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that are searched or read at once.
CHUNK = 1 << 20
#: A task gets at most about so many bytes of a file, unless the options ``split_bytes`` or ``most_tasks`` say otherwise.
SPLIT_BYTES = 64 << 20
#: A batch has about so many tasks a core at most, besides one for each file; where there would be more, each gets more bytes.
TASKS_A_CORE = 8
#: So many versions after the last one, the whole state is written and older versions go.
WHOLE_EVERY = 20

_RANGES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_LINES = pa.schema([("value", pa.string()), ("path", pa.string()), ("start", pa.int64())])


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str, str]:
    """File system, path within it, and what stands before that path in an address."""
    fs, path = pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))
    return fs, path.rstrip("/"), uri[: len(uri.rstrip("/")) - len(path.rstrip("/"))] if uri.rstrip("/").endswith(path.rstrip("/")) else ""


def last_line_end(file: pa.NativeFile, start: int, end: int) -> int:
    """The byte after the last newline in [start, end), ``start`` without one."""
    while end > start:
        low = max(start, end - CHUNK)
        file.seek(low)
        found = file.read(end - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        end = low
    return start


def next_line_end(file: pa.NativeFile, start: int, end: int) -> int:
    """The byte after the first newline in [start, end), ``end`` without one."""
    file.seek(start)
    while start < end:
        data = file.read(min(CHUNK, end - start))
        if not data:
            break
        found = data.find(b"\n")
        if found >= 0:
            return start + found + 1
        start += len(data)
    return end


class States:
    """What was read of each file, as a folder of numbered versions: changes since the version before, now and then the whole.

    The stream's checkpoint holds version numbers only, however many files there are.
    """

    def __init__(self, uri: str):
        self.fs, self.folder, _ = _opened(uri)
        self.fs.create_dir(self.folder)

    def _versions(self, kind: str) -> list[int]:
        infos = self.fs.get_file_info(pa.fs.FileSelector(self.folder))
        return sorted(int(i.base_name[len(kind) + 1 : -8]) for i in infos if i.base_name.startswith(f"{kind}-") and i.base_name.endswith(".parquet"))

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}-{version}.parquet"

    def read(self, kind: str, version: int) -> list[dict]:
        try:
            return pa.parquet.read_table(self._path(kind, version), filesystem=self.fs).to_pylist()
        except FileNotFoundError as e:
            raise ValueError(f"{self.folder} lacks version {version}: it belongs to another checkpoint or was cleared") from e

    def write(self, kind: str, version: int, rows: list[dict]) -> None:
        """Under a draft name first: a version is there as a whole or not at all."""
        draft = f"{self.folder}/draft-{uuid.uuid4().hex}"
        pa.parquet.write_table(pa.Table.from_pylist(rows, _RANGES), draft, filesystem=self.fs)
        self.fs.move(draft, self._path(kind, version))

    def latest(self) -> tuple[int, dict[str, int]]:
        whole, changes = self._versions("whole"), self._versions("changes")
        version = whole[-1] if whole else 0
        ends = {r["path"]: r["end"] for r in self.read("whole", version)} if whole else {}
        for version in [v for v in changes if v > version]:
            ends |= {r["path"]: r["end"] for r in self.read("changes", version)}
        return version, ends

    def between(self, start: int, end: int) -> list[dict]:
        """The ranges that came with the versions after ``start`` up to ``end``."""
        return [r for v in range(start + 1, end + 1) for r in self.read("changes", v)]

    def forget(self, done: int) -> None:
        """Write the whole state as of ``done`` where the last whole one is old, and drop what it replaces."""
        whole, changes = self._versions("whole"), self._versions("changes")
        last = whole[-1] if whole else 0
        if done - last < WHOLE_EVERY:
            return
        ends = {r["path"]: r["end"] for r in self.read("whole", last)} if whole else {}
        for version in [v for v in changes if last < v <= done]:
            ends |= {r["path"]: r["end"] for r in self.read("changes", version)}
        self.write("whole", done, [{"path": p, "start": 0, "end": e} for p, e in ends.items()])
        for kind, old in (("whole", whole), ("changes", [v for v in changes if v <= last])):
            for version in old:
                self.fs.delete_file(self._path(kind, version))


class Lines(InputPartition):
    """The lines of a file that begin in [start, end); [low, high) are whole lines."""

    def __init__(self, path: str, low: int, start: int, end: int, high: int):
        self.path, self.low, self.start, self.end, self.high = path, low, start, end, high


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        # The names of options come in lower case.
        self.uri, self.glob = options["path"], options.get("glob", "*")
        self.most = int(options.get("max_bytes", 0)) or None
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.most_tasks = int(options.get("most_tasks", 0)) or None
        self.closed_after = float(options.get("closed_after", 0)) or None
        self.state = options["state"]
        self._known: tuple[int, dict[str, int]] | None = None

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        states = States(self.state)
        version, ends = self._known or states.latest()
        fs, folder, _ = _opened(self.uri)
        left, changes = self.most, []
        files = [i for i in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True, recursive=True)) if i.is_file]
        for info in sorted(files, key=lambda i: i.path):
            if not fnmatch.fnmatch(info.base_name, self.glob):
                continue
            start = ends.get(info.path, 0)
            if info.size < start:  # cut or written anew: from its beginning
                start = 0
            elif info.size == start:
                continue
            if left is not None and left <= 0:
                break
            end = self._whole_lines(fs, info, start, left)
            if end > start or info.path in ends and start < ends[info.path]:
                changes.append({"path": info.path, "start": start, "end": end})
                left = None if left is None else left - (end - start)
        if changes:
            version += 1
            states.write("changes", version, changes)
            ends = ends | {c["path"]: c["end"] for c in changes}
        self._known = version, ends
        return {"version": version}

    def _whole_lines(self, fs: pa.fs.FileSystem, info: pa.fs.FileInfo, start: int, left: int | None) -> int:
        """Where the whole lines end; the rest of a line that is being written waits for its newline."""
        if self.closed_after and time.time() - info.mtime.timestamp() > self.closed_after and (left is None or info.size - start <= left):
            return info.size
        with fs.open_input_file(info.path) as file:
            end = last_line_end(file, start, info.size if left is None else min(info.size, start + left))
            if end == start and left is not None:  # one line is longer than a batch shall be
                end = last_line_end(file, start, next_line_end(file, start, info.size))
            return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, ranges = [], States(self.state).between(start["version"], end["version"])
        split = self.split
        if self.most_tasks:
            split = max(split, -(-sum(r["end"] - r["start"] for r in ranges) // self.most_tasks))
        for r in ranges:
            cuts = [*range(r["start"], r["end"], split), r["end"]]
            out += [Lines(r["path"], r["start"], a, b, r["end"]) for a, b in zip(cuts, cuts[1:])]
        return out

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        fs, _, scheme = _opened(self.uri)
        with fs.open_input_file(part.path) as file:
            at = part.start if part.start == part.low else next_line_end(file, part.start - 1, part.high)
            # The last line may begin before the end and go on beyond it.
            stop = part.end if part.end == part.high else next_line_end(file, part.end - 1, part.high)
            file.seek(at)
            rest = b""
            while at < stop:
                chunk = file.read(min(4 * CHUNK, stop - at - len(rest)))
                if not chunk:
                    raise OSError(f"{part.path} is shorter than it was")
                data = rest + chunk
                if data.endswith(b"\n") or at + len(data) >= stop:
                    lines, rest = data.removesuffix(b"\n").split(b"\n"), b""
                else:
                    *lines, rest = data.split(b"\n")
                starts = []
                for line in lines:
                    starts.append(at)
                    at += len(line) + 1
                if lines:
                    values = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([scheme + part.path] * len(values)), pa.array(starts)], schema=_LINES)

    def commit(self, end: dict) -> None:
        States(self.state).forget(end["version"])


class TailSource(DataSource):
    """Lines (value, path, start) of all files below ``path``, each once, also those that are appended later.

    Options: ``path``; ``state``, a folder of the stream's own that lives as long as its checkpoint; ``glob`` for file names;
    ``max_bytes`` of a batch (none: all there is); ``split_bytes`` of a task, more where a batch would have more than ``most_tasks`` (``tail_lines`` sets it by the cores); ``closed_after`` seconds without a change
    a file counts as closed. Paths are addresses that Arrow's file systems open (local, HDFS, S3, GCS).

    ``start`` is the byte at which a line begins, so (path, start) names it and orders the lines of a file.

    Defined cases: a last line without newline waits until its newline is there, or until its file is closed; a file that
    is shorter than what was read of it was written anew and is read from its beginning; a file that was renamed is another
    file; a file that goes away takes nothing back, but one that goes between a batch's plan and its reading fails the batch. Lines end with a newline, a carriage return before it is dropped; empty
    lines are lines; bytes that are no UTF-8 become replacement characters. Two streams can't share a ``state``.
    """

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "value string, path string, start long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, state: str, **options: str | int | float):
    """A stream of the lines below ``path``; see ``TailSource`` for the options."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail_lines").option("path", path).option("state", state)
    reader = reader.option("most_tasks", TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return reader.options(**options).load()
