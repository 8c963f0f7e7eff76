"""Runs of repeated word sequences by maximal pairs in the LCP intervals of each text's suffixes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytes_np import WHITE, bounds, word_spans
from tessera.llm.common import give_back, utf8_chunks

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts are searched in batches of about so many bytes (one text at least).
BATCH_BYTES = 1 << 20


@dataclass
class Words:
    """The words of a batch of texts: bytes, spans, text numbers, where each text's words begin, and equal numbers for equal words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_of: np.ndarray
    at: np.ndarray
    code: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The maximal runs of bytes other than blank and tab to carriage return."""
    starts, ends, text_of = word_spans(data, offsets, ~WHITE)
    return Words(data, starts, ends, text_of, bounds(text_of, len(offsets) - 1), span_codes(data, starts, ends))


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, the same for equal bytes; spans ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.int64)
    cuts = np.empty(2 * len(starts) + 1, np.int64)  # spans and the gaps between them, in turn
    cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, ends[-1]
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)


def _first_of_equal(values: np.ndarray) -> np.ndarray:
    """For ascending values, the place of the first equal one."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


@dataclass
class Suffixes:
    """Suffixes that share their first four words with another one of their text, sorted, with what neighbours have in common."""

    place: np.ndarray
    common: np.ndarray  # words shared with the suffix before; 0 where four words aren't


def sorted_suffixes(w: Words) -> Suffixes:
    """Sort by doubling: ranks by 1, 2, 4, ... words; suffixes that are alone leave after each round.

    Words of different texts differ, so no suffix is compared beyond its text.
    """
    n = len(w.code)
    none = Suffixes(np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not n:
        return none
    end = w.at[1:][w.text_of]
    key = w.text_of * (int(w.code.max()) + 1) + w.code
    live = np.argsort(key)
    rank = np.empty(n, np.int32)
    rank[live] = _first_of_equal(key[live])
    ranks, step = [rank], 1
    while True:
        held = rank[live]
        live = live[np.bincount(held, minlength=n)[held] > 1]
        if not len(live):
            break
        after = live + step
        inside = after < end[live]
        second = np.zeros(len(live), np.int64)  # a text's end comes before all words
        second[inside] = rank[after[inside]] + 1
        own = rank[live].astype(np.int64)
        pair = own * (n + 1) + second
        by = np.argsort(pair)
        live, own, pair = live[by], own[by], pair[by]
        rank = rank.copy()
        rank[live] = own + _first_of_equal(pair) - _first_of_equal(own)
        ranks.append(rank)
        step *= 2
    if len(ranks) < 3:
        return none
    four = ranks[2]
    place = np.flatnonzero(np.bincount(four, minlength=n)[four] > 1)
    place = place[np.argsort(rank[place])]
    common = np.zeros(len(place), np.int64)
    a, b = place[:-1], place[1:]
    near = np.flatnonzero(four[a] == four[b])
    length = 1 << (len(ranks) - 1)
    for level in reversed(ranks):
        x, y = a[near] + common[near + 1], b[near] + common[near + 1]
        equal = np.maximum(x, y) < end[a[near]]
        equal[equal] = level[x[equal]] == level[y[equal]]
        common[near[equal] + 1] += length
        length >>= 1
    return Suffixes(place, common)


def _interval_pairs(places: list[int], common: list[int], classes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, j, words in common) of the maximal pairs of neighbours in the LCP intervals of one group, bottom up.

    An interval holds its suffixes in the order of the text, each with the class of the word on its left. When two
    children meet they differ in the word after the common ones; so a pair across them with different classes is
    maximal. Of an interval's pairs only those of neighbours are looked at: were there a third occurrence between the
    two of a pair that is near enough, the pair's distance would not be the run's smallest period.
    """
    stack: list[tuple[int, list[int]]] = []  # of open intervals: common words, places in ascending order

    def joined(size: int, a: list[int], b: list[int]) -> Iterator[tuple[int, int, int]]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect_left(a, x)
            for y in (*a[max(k - 1, 0) : k], *a[k : k + 1]):
                low, high = (x, y) if x < y else (y, x)
                distance = high - low
                if size >= (LEAST_PERIODS - 1) * distance and size + distance >= LEAST_WORDS and classes[low] != classes[high]:
                    yield low, high, size
        for x in b:
            insort(a, x)

    own = [places[0]]
    for k in range(1, len(places) + 1):
        size = common[k] if k < len(places) else 0
        while stack and stack[-1][0] > size:
            above, before = stack.pop()
            yield from joined(above, before, own)
            own = before if len(before) >= len(own) else own
        if k < len(places):
            stack.append((size, own))
            own = [places[k]]


def runs_of(w: Words) -> np.ndarray:
    """Rows (text, first word, words, period) of all runs, by text, start and period; words are numbered within their text.

    A run from s to e with smallest period q is the maximal pair (s, s + q) with e - s - q words in common, and
    every maximal pair whose distance fits the lengths is a run of that distance. A distance that isn't the smallest
    period of its stretch is a multiple of it (at least four distances are in the stretch), so the least one counts.
    """
    found = []
    suffixes = sorted_suffixes(w)
    place, common = suffixes.place, suffixes.common
    # With at least six words and four periods, a pair has five words in common.
    group = np.cumsum(common < LEAST_WORDS - 1) - 1
    left = np.full(len(w.code), -1)
    left[1:] = np.where(w.text_of[1:] == w.text_of[:-1], w.code[:-1], -1)
    if len(place):
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[begin, len(place)])
        by = np.lexsort((place, group))
        gap = np.full(len(place), np.iinfo(np.int64).max)
        gap[1:] = np.where(group[1:] == group[:-1], np.diff(place[by]), gap[1:])
        own = left[place]
        # One class of words on the left has no maximal pair; nor has a group whose places lie too far apart.
        worth = (np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)) & (
            np.minimum.reduceat(gap, begin) <= np.maximum.reduceat(common, begin) // (LEAST_PERIODS - 1)
        )
        classes = left.tolist() if worth.any() else []
        for first, n in zip(begin[worth].tolist(), size[worth].tolist()):
            for low, high, shared in _interval_pairs(place[first : first + n].tolist(), common[first : first + n].tolist(), classes):
                found.append((low, shared + high - low, high - low))
    rows = np.array(found, np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    least = np.ones(len(rows), bool)
    least[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[least]
    text = w.text_of[rows[:, 0]]
    out = np.column_stack([text, rows[:, 0] - w.at[text], rows[:, 1], rows[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def collapsed(w: Words, offsets: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts as their words joined by one blank, each run cut to its first period."""
    inside = np.zeros(len(w.starts) + 1, np.int64)
    first = w.at[runs[:, 0]] + runs[:, 1]
    np.add.at(inside, first + runs[:, 3], 1)
    np.add.at(inside, first + runs[:, 2], -1)
    kept = np.cumsum(inside)[:-1] == 0
    starts, ends, text_of = w.starts[kept], w.ends[kept], w.text_of[kept]
    joins = np.zeros(len(starts), bool)  # a blank follows, at the place of the white space after the word
    joins[:-1] = text_of[1:] == text_of[:-1]
    edges = np.zeros(len(w.data) + 1, np.int8)
    edges[starts] += 1
    np.add.at(edges, ends + joins, -1)
    use = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    data = w.data.copy()
    data[ends[joins]] = ord(" ")
    sizes = np.bincount(text_of, ends - starts + joins, minlength=len(offsets) - 1).astype(np.int64)
    return data[use], np.concatenate([[0], np.cumsum(sizes)])


SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in utf8_chunks(batch.column(0), BATCH_BYTES):
            w = words_of(data, offsets)
            runs = runs_of(w)
            text, cuts = collapsed(w, offsets, runs)
            n = b - a
            struct = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
            strings = pa.LargeStringArray.from_buffers(n, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).slice(a, n) for k in range(1, batch.num_columns)),
                    pa.array(np.diff(w.at)),
                    pa.ListArray.from_arrays(pa.array(bounds(runs[:, 0], n), pa.int32()), struct),
                    strings.cast(pa.string()),
                ],
                names=[*batch.schema.names[1:], "n_words", "runs", "collapsed"],
            )
    give_back()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs, collapsed of every whole text.

    Words are the maximal stretches without blank, tab, newline, vertical tab, form feed and carriage return. A run is a
    stretch of words with smallest period q (words q apart are identical) of at least ``LEAST_WORDS`` words and
    ``LEAST_PERIODS`` periods that no neighbouring word continues. ``runs`` has all of a text by start and period,
    words numbered from 0; ``collapsed`` has the words joined by one blank, each run cut to its first period.

    Each text is searched by itself within a task: nothing is shuffled, and copies or frequent passages cost what
    their length costs. Memory follows the longest text, some 60 bytes a word and 4 for each doubling of what
    repeats in it.

    Defined cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows and rows with a
    null id are searched each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_searched, f"doc_id {kind}, {SCHEMA}")


WORD = r"[^\x20\x09-\x0D]+"


def sharpest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; ties by smaller start, then smaller period. Null without runs."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(
        runs,
        first,
        lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best),  # ascending starts and periods: the first stays
    )


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with texts of ids whose crc32 ends in 0 made periodic from a word on; both follow from the crc32."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tiled(w: Column) -> Column:
        n = F.size(w).cast("long")
        start = F.pmod(g, n)
        period = F.lit(1) + F.floor((n - start) / (F.lit(3) + F.pmod(g, F.lit(8))))
        block = F.slice(w, (start + 1).cast("int"), period.cast("int"))
        repeated = F.flatten(F.array_repeat(block, F.ceil((n - start) / period).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), start.cast("int")), F.slice(repeated, F.lit(1), (n - start).cast("int"))), " ")

    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    # An array of one, so that the words are found once.
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tiled(w)).otherwise(F.lit(""))), F.lit(0))
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), planted).otherwise(F.col(text_col)))
