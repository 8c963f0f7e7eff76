"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, stored
from tessera.llm.components import connected_components

#: Rows of a bucket that are compared at once; larger buckets are cut into such blocks.
BLOCK_ROWS = 1024
#: Vectors that share a bucket by chance.
BUCKET_ROWS = 32
#: Share of the pairs right at the threshold that no table brings together, for independent bits.
MISSES = 8e-4
#: The mean direction is taken out up to this length, which balances the bits and leaves near vectors near.
LONGEST_CENTRE = 0.3
#: Bucket entries that a task sorts and compares.
TASK_ROWS = 500_000
#: Numbers (of doubles) in the sample that the rotations are fitted on.
SAMPLE_NUMBERS = 2_000_000


def planned_tables(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables for groups of up to ``rows`` vectors.

    Bits grow with the logarithm of the rows, so that a bucket stays small. A bit of two vectors at
    an angle of t agrees with probability 1 - t / pi; the tables are as many as are needed for
    one at least to agree for all but ``MISSES`` of the pairs at the threshold. At cosine 0.93 rows times
    tables grow as the 1.18th power of the rows.
    """
    bits = min(32, max(8, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))))
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSES) / math.log1p(-agree))) if agree < 1 else 1


def hamming_radius(total_bits: int, threshold: float) -> float:
    """Distance of whole codes that pairs at the threshold exceed practically never: six deviations above the mean."""
    apart = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return total_bits * apart + 6 * math.sqrt(total_bits * apart * (1 - apart))


@dataclass
class Quantiser:
    """Centre and rotations; a vector's code is the signs of its centred, rotated direction, ``bits`` a table."""

    centre: np.ndarray
    rotations: np.ndarray  # dimension x bits of all tables
    tables: int
    bits: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """One unsigned number of ``bits`` bits for each vector and table."""
        signs = (unit - self.centre) @ self.rotations[:, : self.bits * self.tables] > 0
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return (signs.reshape(len(unit), self.tables, self.bits) @ weights).astype(code_type(self.bits))


def code_type(bits: int) -> np.dtype:
    return np.dtype("u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4")


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest number first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_quantiser(sample: np.ndarray, tables: int, bits: int = 8, rounds: int = 30, seed: int = 5) -> Quantiser:
    """Learn rotations for which signs lose least: alternate between the codes and the orthogonal
    rotation that maps the directions nearest to them (Procrustes). Each rotation gives as many bits
    as there are dimensions; several, from different random starts, fill all tables. Without a
    sample the rotations are random.
    """
    dim = sample.shape[1]
    unit = unit_rows(sample) if len(sample) else sample
    centre = unit.mean(axis=0) if len(unit) else np.zeros(dim)
    # Seen from the very centre of a tight group, its members lie in all directions.
    centre *= min(1.0, LONGEST_CENTRE / max(np.linalg.norm(centre), 1e-12))
    x = unit - centre
    random = np.random.default_rng(seed)
    rotations = []
    while sum(r.shape[1] for r in rotations) < bits * tables:
        r = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(x) > 1 else 0):
            u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ vt
        rotations.append(r)
    return Quantiser(centre, np.hstack(rotations), tables, bits)


def _coded(fitted: dict[int, Quantiser], tables: int, bits: int):
    """Adds to (rep, label, copies, v) rows code and vector as bytes and the vector's length in place of v."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers = dict(fitted)
        for batch in batches:
            column = batch.column(3)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            sizes = np.diff(offsets)
            code, vector = [b""] * len(sizes), [b""] * len(sizes)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                if dim not in quantisers:  # a length that the sample lacks
                    quantisers[dim] = fit_quantiser(np.zeros((0, dim)), tables, bits)
                x = flat[offsets[rows][:, None] + np.arange(dim)]
                for k, c, v in zip(rows.tolist(), quantisers[dim].codes(unit_rows(x)), x):
                    code[k], vector[k] = c.tobytes(), _packed(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(code, pa.binary()), pa.array(vector, pa.binary())],
                names=["rep", "label", "copies", "size", "code", "vector"],
            )

    return run


def _packed(v: np.ndarray) -> bytes:
    """The numbers as four-byte floats where those hold them exactly, else as eight-byte ones."""
    short = v.astype("<f4")
    return short.tobytes() if (short == v).all() else v.astype("<f8").tobytes()


def _numbers(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * dim else "<f8").astype(np.float64)


def _compared(threshold: float, tables: int, bits: int):
    """Rows (rep, other, links): links with other = rep are counts of linked vectors, with another
    they are 0 and the row is an edge that joins two vectors of a component.

    Of a block's pairs those within the Hamming radius are looked at, each by the first table that
    brings it together; what links is decided by the cosine of the original vectors.
    """
    types = {"rep": pa.int64(), "other": pa.int64(), "links": pa.int64()}
    radius, kind = hamming_radius(tables * bits, threshold), code_type(bits)

    def near(codes: np.ndarray, table: int, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within the radius, a before b, that this table is the first to bring together."""
        raw = codes.view(np.uint8).reshape(len(codes), -1)
        words = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
        words[:, : raw.shape[1]] = raw
        words = words.view(np.uint64)
        left, right = [], []
        for k in range(len(codes) - 1):
            rest = slice(k + 1, None)
            ok = np.bitwise_count(words[rest] ^ words[k]).sum(axis=1, dtype=np.int64) <= radius
            if apart is not None:
                ok &= apart[rest] != apart[k]
            found = k + 1 + np.flatnonzero(ok)
            found = found[(codes[found] == codes[k]).argmax(axis=1) == table] if len(found) else found
            left.append(np.full(len(found), k))
            right.append(found)
        return np.concatenate(left), np.concatenate(right)

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        size, table, i, j = rows[0][1], rows[0][2], rows[0][4], rows[0][5]
        rep, copies, chunk = (np.array([r[k] for r in rows]) for k in (6, 7, 8))
        codes = np.stack([np.frombuffer(r[9], kind) for r in rows])
        a, b = near(codes, table, chunk if i != j else None)
        if not len(a):
            return
        x = unit_rows(np.stack([_numbers(r[10], size) for r in rows]))
        step = max(1, (1 << 20) // size)
        cosine = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + step]], x[b[k : k + step]]) for k in range(0, len(a), step)])
        a, b = a[cosine >= threshold], b[cosine >= threshold]
        if not len(a):
            return
        links = np.bincount(a, copies[b], minlength=len(rows)) + np.bincount(b, copies[a], minlength=len(rows))
        parent = np.arange(len(rows))
        while True:  # least neighbour's label, until it stays
            low = np.minimum(parent[a], parent[b])
            now = parent.copy()
            np.minimum.at(now, a, low)
            np.minimum.at(now, b, low)
            now = now[now]
            if (now == parent).all():
                break
            parent = now
        some = np.flatnonzero(links)
        edge = np.flatnonzero(parent != np.arange(len(rows)))
        columns = [
            np.concatenate([rep[some], rep[edge]]),
            np.concatenate([rep[some], rep[parent[edge]]]),
            np.concatenate([links[some], np.zeros(len(edge))]).astype(np.int64),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:6] != rows[0][:6]:
                    yield from flush(rows)
                    rows = []
                rows.append(row)
        yield from flush(rows)

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    sample_rows: int = 20_000,
    tables: tuple[int, int] | None = None,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links are pairs of one label with cosine >= ``threshold``.

    The quantisers, one for each length of vectors, are fitted on the ``sample_rows`` vectors (or as many as
    hold ``SAMPLE_NUMBERS`` numbers) that come first by a hash of the id; every vector is indexed.
    ``tables`` (bits of a table, tables) follow from the size of the largest group of one label and
    length unless given, see ``planned_tables``. Vectors meet in the buckets of the tables, pass the
    Hamming test on their whole codes, and are decided on in double precision, so no link is wrong.
    Equal vectors of a label are one class before anything is compared; buckets are compared in
    blocks inside tasks, which give counts and a spanning forest, never the pairs.

    Defined cases: vectors that are null, empty or zero, or hold nulls or non-finite numbers, link
    with nothing, as do those with a null label or id; they are their own component. Vectors of
    different lengths don't link. Rows with equal ids are one node. An empty table gives no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    vec = F.col("v")
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    )
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull()
        & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("sound", sound)
    good = rows.filter("sound")
    groups = good.groupBy("label", F.size("v").alias("size")).count()
    largest, longest, total = groups.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    bits, n_tables = tables or planned_tables(largest, threshold)
    sample_rows = max(1, min(sample_rows, SAMPLE_NUMBERS // longest))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow().column("v").to_pylist()
    by_size: dict[int, list[list[float]]] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    fitted = {size: fit_quantiser(np.array(some), n_tables, bits) for size, some in by_size.items()}

    # Adding 0.0 makes the two zeros equal.
    content = F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)
    keyed = good.withColumn("content", F.unhex(content))
    classes = stored(
        keyed.groupBy("label", "content").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")),
        "vector-classes",
    )
    base = classes.select("rep", "label", "copies", "v")
    schema = T.StructType([*base.schema.fields[:3], T.StructField("size", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("code", "vector")]])
    coded = stored(base.mapInArrow(_coded(fitted, n_tables, bits), schema), "vector-codes")
    width = code_type(bits).itemsize
    narrow = coded.select(
        "rep",
        "label",
        "size",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_tables - 1)), lambda k: F.substring("code", k * width + 1, F.lit(width)))).alias("table", "bucket"),
    )
    bucket = ["label", "size", "table", "bucket"]
    full = narrow.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").select(*bucket, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("chunks"))
    group = ["label", "size", "table", "bucket", "i", "j"]
    placed = (
        narrow.join(full, bucket)
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*bucket, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rep", "chunk")
        .join(coded.select("rep", "copies", "code", "vector"), "rep")
        .select(*group, "rep", "copies", "chunk", "code", "vector")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * n_tables // TASK_ROWS))
    found = stored(
        placed.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(_compared(threshold, n_tables, bits), "rep long, other long, links long"),
        "vector-links",
    )
    counts = found.filter("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("links = 0").select("rep", "other"))
    discard(coded)
    by_class = (
        classes.select("label", "content", "rep", "copies")
        .join(counts, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "content",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    done = keyed.select("vec_id", "label", "content").join(by_class, ["label", "content"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
