"""Quality scores from histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytes_np import LOWER, WHITE, Substrings, bounds, word_spans
from tessera.llm.common import utf8_chunks

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "marks", "blanks", "beyond_ascii",
    "words_per_line", "words_per_sentence", "distinct_words", "repeated_neighbours", "top_word", "distinct_lines",
    "top_line", "marked_words", "mark_only_words", "top_mark", "distinct_marks", "capital_words", "comma_share",
)

_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_PLAIN_MARKS = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_ODD = _MARKS.copy()
_ODD[_PLAIN_MARKS] = False
_CLASS = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 mark, 4 white, 5 beyond ASCII
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[_MARKS] = 3
_CLASS[WHITE] = 4
_CLASS[0x80:] = 5
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _shares(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the share of distinct values among its hashes, and the share of the most frequent."""
    distinct, top = np.ones(n), np.zeros(n)
    for i in range(n):
        own = hashes[at[i] : at[i + 1]]
        if len(own):
            counts = np.unique(own, return_counts=True)[1]
            distinct[i], top[i] = len(counts) / len(own), counts.max() / len(own)
    return distinct, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; an empty text has zeros and shares of one."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text_of = np.repeat(np.arange(n), size)
    classes = np.bincount(text_of * 6 + _CLASS[data], minlength=6 * n).reshape(n, 6)
    starts, ends, word_text = word_spans(data, offsets, ~WHITE)
    at = bounds(word_text, n)
    words = np.diff(at)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    sub = Substrings(data)
    hashes = sub.hashes(starts, ends)
    lengths = ends - starts
    longest = np.zeros(n)
    np.maximum.at(longest, word_text, lengths)
    sum_of = lambda values: np.bincount(word_text, values, minlength=n)
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (word_text[1:] == word_text[:-1])
    odd = np.concatenate([[0], np.cumsum(_ODD[data])])
    odd_in = odd[ends] - odd[starts]
    mark = np.concatenate([[0], np.cumsum(_MARKS[data])])
    only_marks = (mark[ends] - mark[starts]) == lengths
    capital = _CLASS[data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    stops = np.isin(data, np.frombuffer(b".!?", np.uint8))
    sentences = np.bincount(text_of[stops], minlength=n)
    commas = np.bincount(text_of[data == ord(",")], minlength=n)
    line_starts, line_ends, line_text = word_spans(data, offsets, _NOT_NEWLINE)
    line_at = bounds(line_text, n)
    distinct_lines, top_line = _shares(sub.hashes(line_starts, line_ends), line_at, n)
    distinct_words, top_word = _shares(hashes, at, n)
    odd_marks = np.bincount(text_of[_ODD[data]] * 256 + data[_ODD[data]], minlength=256 * n).reshape(n, 256)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), sum_of(lengths) / per_word, np.log1p(longest),
            classes[:, 1] / per_byte, classes[:, 2] / per_byte, classes[:, 3] / per_byte, classes[:, 4] / per_byte,
            classes[:, 5] / per_byte, words / np.maximum(np.diff(line_at), 1), words / np.maximum(sentences, 1),
            distinct_words, sum_of(same) / per_word, top_word, distinct_lines, top_line,
            sum_of(odd_in > 0) / per_word, sum_of(only_marks) / per_word, odd_marks.max(axis=1) / per_word,
            (odd_marks > 0).sum(axis=1), sum_of(capital) / per_word, commas / per_word,
        ]
    )


@dataclass
class FlatTrees:
    """Trees of equal depth as arrays: node k has children 2k + 1 (at or below the threshold) and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches; all rows go down a level at once."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, min_rows: float = 5.0
) -> FlatTrees:
    """Gradient boosting with logistic loss; splits are searched in histograms of quantile bins.

    With one class, or no rows, the trees are empty and the score is that of the base rate.
    """
    n, width = len(x), x.shape[1]
    inner, leaves = 2**depth - 1, 2**depth
    rate_of_ones = (y.sum() + 0.5) / (n + 1) if n else 0.5
    model = FlatTrees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(rate_of_ones / (1 - rate_of_ones))))
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)])
    columns = np.arange(width) * bins
    margin = np.full(n, model.base)
    out_feature, out_threshold, out_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * bins) + columns + binned).ravel()
            shape = (count, width, bins)
            g = np.bincount(slot, np.repeat(grad, width), minlength=count * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(hess, width), minlength=count * width * bins).reshape(shape).cumsum(axis=2)
            m = np.bincount(slot, minlength=count * width * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h, all_m = g[:, :1, -1:], h[:, :1, -1:], m[:, :1, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(m < min_rows) | (all_m - m < min_rows)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            split_bin = np.array([np.searchsorted(cuts[f], t, side="left") if np.isfinite(t) else bins for f, t in zip(feature, threshold)])
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split_bin[node])
        own = node - inner
        leaf = -rate * np.bincount(own, grad, minlength=leaves) / (np.bincount(own, hess, minlength=leaves) + l2)
        margin += leaf[own]
        out_feature.append(feature)
        out_threshold.append(threshold)
        out_leaf.append(leaf)
    return FlatTrees(np.array(out_feature), np.array(out_threshold), np.array(out_leaf), model.base)


def learn_quality(sample: DataFrame, **settings) -> FlatTrees:
    """Trees from a bounded (doc_id, text, label) sample; executors send statistics, not texts."""

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for a, b, data, offsets in utf8_chunks(batch.column(0)):
                rows = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[a:b], pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "x"]
                )

    got = sample.select("text", "label", "doc_id").mapInArrow(collect, "label int, x array<double>").toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the sample arrives in any order; the model shall not depend on it
    return fit_trees(x[order], y[order], **settings)


def quality_score(model: FlatTrees):
    """A column function: text -> score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(statistics(data, offsets)) for _, _, data, offsets in utf8_chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_quality(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every whole text.

    Defined cases: null and empty texts have the statistics of no bytes and are scored by them;
    repeated rows and rows with a null id are scored each; an empty table gives no rows; other columns are ignored.
    """
    return docs.select("doc_id", quality_score(model)(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
