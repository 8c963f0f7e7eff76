"""Hard negatives by segment summaries: bounds from means and deviations, refined level by level before exact scores."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stored

#: Anchors and rows of a cell of the grid; a task holds one cell's anchors and ``STEP`` rows at a time.
ANCHOR_BLOCK, ROW_BLOCK, STEP = 1024, 2048, 1024
#: Segments of the finest stored level; coarser levels have a quarter each.
SEGMENTS = 32
#: Rows that a task gets.
TASK_ROWS = 200_000
#: Bytes of the table of groups up to which it is broadcast.
BROADCAST_BYTES = 1 << 20
#: Numbers (of doubles) in the sample that the rotations are fitted on.
SAMPLE_NUMBERS = 2_000_000
#: From this share of a block's pairs on, one matrix product is cheaper than gathered pairs.
DENSE = 0.1
#: Bounds are widened by this share of the product of the lengths, far beyond what rounding can do.
SLACK = 1e-9
_LEAST, _MOST = -(2**63), 2**63 - 1
_EXACT = 2**53


def haar(n: int) -> np.ndarray:
    """The orthonormal Haar basis of ``n`` (a power of two) numbers, coarse rows first."""
    if n == 1:
        return np.ones((1, 1))
    return np.vstack([np.kron(haar(n // 2), [1, 1]), np.kron(np.eye(n // 2), [1, -1])]) / math.sqrt(2)


def fit_rotation(sample: np.ndarray) -> np.ndarray:
    """An orthogonal map (to the next power of two) under which the means of the first 2**l segments hold the 2**l principal directions.

    Inner products stay; only how much of them the means can tell depends on the sample.
    """
    dim = sample.shape[1]
    padded = 1 << max(1, math.ceil(math.log2(max(dim, 2))))
    scaled = sample / np.maximum(np.abs(sample).max(axis=1, keepdims=True), 1) if len(sample) else sample
    directions = np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1] if len(sample) else np.eye(dim)
    return directions @ haar(padded)[:dim]


def summaries(turned: np.ndarray, segments: int) -> np.ndarray:
    """Means (times the root of the length) of each row's equal segments, then the lengths of what deviates from them."""
    parts = turned.reshape(len(turned), segments, -1)
    means = parts.mean(axis=2)
    away = np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))
    return np.hstack([means * math.sqrt(parts.shape[2]), away])


def coarser(summary: np.ndarray) -> np.ndarray:
    """The summaries of segments four times as long, from those of their parts."""
    means, away = np.hsplit(summary, 2)
    means, away = (x.reshape(len(x), -1, 4) for x in (means, away))
    total = means.sum(axis=2) / 2
    spread = (means**2).sum(axis=2) - total**2 + (away**2).sum(axis=2)
    return np.hstack([total, np.sqrt(np.maximum(spread, 0))])


def levels(summary: np.ndarray) -> list[np.ndarray]:
    """All levels, coarse to fine."""
    out = [summary]
    while out[0].shape[1] >= 32:
        out.insert(0, coarser(out[0]))
    return out


def packed(v: np.ndarray) -> bytes:
    """The numbers as four-byte floats where those hold them exactly, else as eight-byte ones."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return short.tobytes() if (short == v).all() else v.astype("<f8").tobytes()


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype(np.float64) for r in raw])


def exact_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``x``; beyond the range of a long its end."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if top < _EXACT:
        return (a @ x.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in side] for side in (a, x)]
    return np.array([[min(max(sum(map(int.__mul__, p, q)), _LEAST + 1), _MOST) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(x))


class Cell:
    """The anchors of one cell and the best rows for each of their windows so far."""

    def __init__(self, anchors: list[tuple], same_label: bool, keep: int):
        self.size, self.same_label, self.keep = anchors[0][3], same_label, keep
        self.keys = np.array([r[1] for r in anchors], np.int64)
        self.labels = [r[4] for r in anchors]
        self.vectors = unpacked([r[5] for r in anchors], self.size)
        self.levels = levels(np.stack([np.frombuffer(r[6]) for r in anchors]))
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        n, windows = len(anchors), max(len(r[7]) for r in anchors)
        # A window that an anchor lacks has its lowest score above its highest.
        self.low, self.high = np.full((n, windows), _MOST), np.full((n, windows), _LEAST)
        for k, r in enumerate(anchors):
            for w, (low, high) in enumerate(r[7]):
                self.low[k, w], self.high[k, w] = low, high
        #: For each window: anchor's number, score, row's id, row's key; and the score that a further row must reach.
        self.best = [[np.zeros(0, np.int64)] * 4 for _ in range(windows)]
        self.floor = self.low.copy()

    def alive(self, keys: np.ndarray, labels: list, own: list[np.ndarray], norms: np.ndarray) -> np.ndarray:
        """Pairs that no level's bounds rule out."""
        code = {label: k for k, label in enumerate(dict.fromkeys([*self.labels, *labels]))}
        left, right = np.array([code[x] for x in self.labels]), np.array([code[x] for x in labels])
        ok = (left[:, None] == right) if self.same_label else (left[:, None] != right)
        ok &= self.keys[:, None] != keys
        slack = SLACK * self.norms[:, None] * norms + 1e-6
        for mine, theirs in zip(self.levels, own):
            (m, d), (n, e) = np.hsplit(mine, 2), np.hsplit(theirs, 2)
            rows, columns = np.nonzero(ok)
            if len(rows) < DENSE * ok.size:  # the few pairs that are left
                middle, away = (np.concatenate([np.einsum("ij,ij->i", p[r], q[c]) for r, c in _steps(rows, columns)] or [np.zeros(0)]) for p, q in ((m, n), (d, e)))
                ok[rows, columns] = self._within(middle + away + slack[rows, columns], middle - away - slack[rows, columns], rows)
            else:
                middle, away = m @ n.T, d @ e.T + slack
                ok &= self._within(middle + away, middle - away, np.arange(len(ok))[:, None])
        return ok

    def _within(self, most: np.ndarray, least: np.ndarray, rows: np.ndarray) -> np.ndarray:
        fits = np.zeros(most.shape, bool)
        for w in range(self.low.shape[1]):
            fits |= (most >= self.floor[rows, w]) & (least <= self.high[rows, w]) & (self.floor[rows, w] <= self.high[rows, w])
        return fits

    def add(self, rows: list[tuple]) -> None:
        """Score the rows that the bounds leave and keep the best ones."""
        keys, ids = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        vectors = unpacked([r[5] for r in rows], self.size)
        own = levels(np.stack([np.frombuffer(r[6]) for r in rows]))
        ok = self.alive(keys, [r[4] for r in rows], own, np.sqrt((vectors**2).sum(axis=1)))
        used, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        if not len(used):
            return
        scores = np.full(ok.shape, _LEAST)
        a, b = np.nonzero(ok)
        if len(a) < DENSE * len(used) * len(columns):
            for r, c in _steps(a, b):
                scores[r, c] = _pair_products(self.vectors[r], vectors[c])
        else:
            scores[np.ix_(used, columns)] = exact_products(self.vectors[used], vectors[columns])
        for w in range(self.low.shape[1]):
            fit = np.where(ok & (scores >= self.floor[:, w, None]) & (scores <= self.high[:, w, None]), scores, _LEAST)
            if fit.shape[1] > self.keep:
                fit[fit < np.partition(fit, -self.keep, axis=1)[:, -self.keep, None]] = _LEAST
            r, c = np.nonzero(fit > _LEAST)
            if not len(r):
                continue
            found = [np.concatenate(x) for x in zip(self.best[w], (r, fit[r, c], ids[c], keys[c]))]
            order = np.lexsort((found[3], found[2], ~found[1], found[0]))
            found = [x[order] for x in found]
            place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
            self.best[w] = [x[place < self.keep] for x in found]
            last = place == self.keep - 1
            self.floor[found[0][last], w] = found[1][last]

    def results(self) -> Iterator[pa.RecordBatch]:
        for w, (anchor, score, ids, keys) in enumerate(self.best):
            if len(anchor):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (self.keys[anchor], np.full(len(anchor), w, np.int64), ids, keys, score)],
                    names=["anchor_key", "window", "id", "key", "score"],
                )


FOUND = "anchor_key long, window long, id long, key long, score long"


def _steps(a: np.ndarray, b: np.ndarray, n: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, len(a), n):
        yield a[k : k + n], b[k : k + n]


def _pair_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if top < _EXACT:
        return np.einsum("ij,ij->i", a, x).astype(np.int64)
    return np.array([exact_products(p[None], q[None])[0, 0] for p, q in zip(a, x)], np.int64)


def _searched(same_label: bool, keep: int):
    """Batches sorted by cell, anchors first, to the best rows of each cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, members in itertools.groupby(rows, key=lambda r: r[8]):
            anchors, cell, block = [], None, []
            for r in members:
                if r[0]:
                    anchors.append((*r[:7], [tuple(w.values()) for w in r[7]]))
                    continue
                if not anchors:
                    break
                block.append(r)
                if len(block) == STEP:
                    cell = cell or Cell(anchors, same_label, keep)
                    cell.add(block)
                    block = []
            if anchors and block:
                cell = cell or Cell(anchors, same_label, keep)
                cell.add(block)
            if cell:
                yield from cell.results()

    return run


def _summarised(rotations: dict[int, np.ndarray]):
    """Adds vector and summary as bytes in place of v."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = dict(rotations)
        for batch in batches:
            column = batch.column(3)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            sizes = np.diff(offsets)
            vector, summary = [b""] * len(sizes), [b""] * len(sizes)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                if dim not in fitted:  # a length that the sample lacks
                    fitted[dim] = fit_rotation(np.zeros((0, dim)))
                x = flat[offsets[rows][:, None] + np.arange(dim)]
                turned = x @ fitted[dim]
                segments = min(SEGMENTS, turned.shape[1])
                for k, v, s in zip(rows.tolist(), x, summaries(turned, segments)):
                    vector[k], summary[k] = packed(v), s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(vector, pa.binary()), pa.array(summary, pa.binary())],
                names=["id", "label", "is_anchor", "size", "vector", "summary"],
            )

    return run


def _best(anchors: DataFrame, rows: DataFrame, group: list[str], same_label: bool, keep: int) -> DataFrame:
    """Each anchor's best ``keep`` rows of every window, over a grid of anchor blocks and row blocks within each group."""
    spark = rows.sparkSession
    n_rows = rows.groupBy(*group).agg(F.count("*").alias("n"), F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("row_blocks"))
    n_anchors = anchors.groupBy(*group).agg(F.ceil(F.count("*") / ANCHOR_BLOCK).cast("int").alias("anchor_blocks"))
    blocks = n_rows.join(n_anchors, group)
    names = F.sum(F.octet_length(F.concat_ws(",", *(F.col(c).cast("string") for c in group))) + 32)
    total, size = blocks.agg(F.coalesce(F.sum(F.col("n") * F.col("anchor_blocks")), F.lit(0)), F.coalesce(names, F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    blocks = blocks.drop("n")
    blocks = F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks  # many labels: a join that shuffles
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")

    def placed(side: DataFrame, first: bool) -> DataFrame:
        own, other = ("anchor_blocks", "row_blocks") if first else ("row_blocks", "anchor_blocks")
        mine, theirs = F.pmod(F.xxhash64("key"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        dealt = side.join(blocks, group).select("*", mine.alias("mine"), theirs.alias("theirs"))
        i, j = ("mine", "theirs") if first else ("theirs", "mine")
        return dealt.select(
            F.lit(first).alias("first"), "key", "id", "size", F.col("label").cast("string").alias("label"), "vector", "summary",
            F.col("windows") if first else none.alias("windows"), F.struct(*group, F.col(i).alias("i"), F.col(j).alias("j")).alias("cell"),
        )

    found = (
        placed(anchors, True)
        .unionByName(placed(rows, False))
        .repartition(parts, "cell")
        .sortWithinPartitions("cell", F.desc("first"))
        .mapInArrow(_searched(same_label, keep), FOUND)
    )
    order = Window.partitionBy("anchor_key", "window").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    sample_rows: int = 20_000,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The vectors hold whole numbers; a score is the inner product with the anchor, higher ones first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of the same label. For each
    of them come the first ``negatives`` rows of other labels with a score from ``low_percent`` to
    ``high_percent`` percent of the positive's.

    Every vector is stored with the mean and the deviation of each of its segments, under a rotation (one
    for each length, fitted on at most ``sample_rows`` vectors) that makes the means tell most. The product of two
    vectors' means, plus and minus the product of their deviations, bounds their score. Anchors meet all
    rows in blocks of a grid; pairs that the coarse segments can't rule out go on to finer ones, and what is
    left is scored exactly. A label or a vector that many rows have is spread over blocks by the row's key, so no
    task holds a group, and each block gives a few rows for each anchor. The result is exact whatever the sample.

    Defined cases: rows with a null id or label, a null or empty vector, or a null or non-finite component take no part.
    Vectors of different lengths don't meet. Repeated rows count each, so a second row with the anchor's id is another
    row, and each copy of an anchor has rows of its own. Scores beyond the range of a long count as its end. Anchors
    without positives or negatives give no rows; an empty table gives none; other columns are ignored.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        v.alias("v"), fine.alias("fine"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce("fine", F.lit(False)) & (F.size("v") > 0)).drop("fine")
    longest = good.agg(F.max(F.size("v"))).first()[0] or 1
    sample = good.orderBy(F.xxhash64("id"), "id").limit(max(1, min(sample_rows, SAMPLE_NUMBERS // longest))).select("v").toArrow().column("v").to_pylist()
    by_size: dict[int, list[list[float]]] = {}
    for x in sample:
        by_size.setdefault(len(x), []).append(x)
    rotations = {size: fit_rotation(np.array(some)) for size, some in by_size.items()}
    schema = T.StructType(
        [*good.schema.fields[:3], T.StructField("size", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("vector", "summary")]]
    )
    rows = stored(
        good.mapInArrow(_summarised(rotations), schema).withColumn("key", F.monotonically_increasing_id()), "negative-vectors"
    )
    anchors = rows.filter("is_anchor")

    everything = F.array(F.struct(F.lit(_LEAST + 1).alias("low"), F.lit(_MOST).alias("high")))
    near = stored(_best(anchors.withColumn("windows", everything), rows, ["label", "size"], True, positives), "negative-positives")
    targets = near.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("targets"))
    # The bounds in whole numbers; decimals, as a hundred times a score may pass the range of a long.
    percent = lambda s, p: s.cast("decimal(38,0)") * F.lit(p).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)")
    windows = F.transform(
        "targets",
        lambda t: F.struct(F.ceil(percent(t.score, low_percent)).cast("long").alias("low"), F.floor(percent(t.score, high_percent)).cast("long").alias("high")),
    )
    searching = anchors.join(targets.select(F.col("anchor_key").alias("key"), windows.alias("windows")), "key")
    far = _best(searching, rows, ["size"], False, negatives).select("anchor_key", (F.col("window") + 1).alias("place"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor_key", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        far.join(pairs, ["anchor_key", "place"])
        .join(anchors.select(F.col("key").alias("anchor_key"), F.col("id").alias("anchor_id")), "anchor_key")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def quantised(vector: Column, scale: int = 256) -> Column:
    """Each component as the greatest whole number that isn't above ``scale`` times it, kept as a double."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole

    return F.transform(vector, whole)
