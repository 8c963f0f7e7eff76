"""Quality rules as a cascade: the order follows from each rule's cost and rejections on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytes_np import WHITE, word_spans
from tessera.llm.common import give_back, utf8_chunks
from tessera.llm.periodic_runs import Words, span_codes, words_of

#: A rule's rejected texts leave the batch when so many have gathered; below, copying costs more than it saves.
LEAVE = 0.25
#: Texts are looked at in batches of about so many bytes (one text at least).
BATCH_BYTES = 1 << 20


def _lookup(accepted: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(accepted)] = True
    return out


SYMBOLS = _lookup(b"#*$%&|<>")
CAPITALS, SMALL = _lookup(range(ord("A"), ord("Z") + 1)), _lookup(range(ord("a"), ord("z") + 1))
#: ASCII letters, and all bytes of other characters.
LETTERS = CAPITALS | SMALL | _lookup(range(0x80, 0x100))
_CONTINUED = _lookup(range(0x80, 0xC0))
_IN_LINE = ~_lookup(b"\n")


class Texts:
    """A batch of texts with what the base of all rules counts in them."""

    def __init__(self, words: Words, offsets: np.ndarray):
        self.words, self.offsets = words, offsets
        self.n = len(offsets) - 1
        self.n_words = np.diff(words.at)

    def within(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes of each text."""
        return self._between(marks, self.offsets[:-1], self.offsets[1:])

    def _between(self, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks[self.words.data])])
        return total[ends] - total[starts]

    def in_words(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes of each word."""
        return self._between(marks, self.words.starts, self.words.ends)

    def words_where(self, which: np.ndarray) -> np.ndarray:
        """How many words of each text are marked."""
        return np.bincount(self.words.text_of[which], minlength=self.n)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the lines that hold a word."""
        starts, ends, text_of = word_spans(self.words.data, self.offsets, _IN_LINE)
        some = self._between(~WHITE, starts, ends) > 0
        return starts[some], ends[some], text_of[some]

    def word_chars(self) -> np.ndarray:
        return self.within(~WHITE & ~_CONTINUED)

    def symbols(self) -> np.ndarray:
        return self.within(SYMBOLS)

    def line_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that are equal to an earlier one of their text."""
        starts, ends, text_of = self.lines()
        code = span_codes(self.words.data, starts, ends)
        distinct = np.unique(text_of * (int(code.max(initial=0)) + 1) + code) // (int(code.max(initial=0)) + 1)
        lines = np.bincount(text_of, minlength=self.n)
        return lines, lines - np.bincount(distinct, minlength=self.n)

    def repeated_words(self, width: int = 3) -> np.ndarray:
        """Words that lie in a window of ``width`` words which the text has twice or more."""
        code, text_of = self.words.code, self.words.text_of
        places = np.flatnonzero(text_of[width - 1 :] == text_of[: len(text_of) - width + 1]) if len(code) >= width else np.zeros(0, np.int64)
        if not len(places):
            return np.zeros(self.n, np.int64)
        distinct = int(code.max()) + 1
        key = text_of[places] * distinct + code[places]
        for k in range(1, width):
            key = np.unique(key, return_inverse=True)[1] * distinct + code[places + k]
        _, ranks, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = places[counts[ranks] > 1]
        covered = np.zeros(len(code) + 1, np.int64)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + width, -1)
        return self.words_where(np.cumsum(covered)[:-1] > 0)

    def only(self, kept: np.ndarray) -> Texts:
        """The texts that are marked."""
        w, sizes = self.words, np.diff(self.offsets)
        offsets = np.concatenate([[0], np.cumsum(sizes[kept])])
        back = np.zeros(self.n, np.int64)
        back[kept] = self.offsets[:-1][kept] - offsets[:-1]
        own = kept[w.text_of]
        text_of, number = w.text_of[own], np.cumsum(kept) - 1
        counts = np.concatenate([[0], np.cumsum(self.n_words[kept])])
        return Texts(Words(w.data[np.repeat(kept, sizes)], w.starts[own] - back[text_of], w.ends[own] - back[text_of], number[text_of], counts, w.code[own]), offsets)


@dataclass(frozen=True)
class Rule:
    """A reason to reject a text; ``rejects`` gives one boolean for each text of a batch."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _word_length(t: Texts) -> np.ndarray:
    chars = t.word_chars()
    return (chars < 3 * t.n_words) | (chars > 10 * t.n_words)


def _symbols(t: Texts) -> np.ndarray:
    return 10 * t.symbols() > t.n_words


def _letterless(t: Texts) -> np.ndarray:
    return 5 * t.words_where(t.in_words(LETTERS) == 0) > t.n_words


def _shouting(t: Texts) -> np.ndarray:
    return t.within(CAPITALS) > t.within(SMALL)


def _stutter(t: Texts) -> np.ndarray:
    code, text_of = t.words.code, t.words.text_of
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (text_of[1:] == text_of[:-1])
    return 5 * t.words_where(same) > t.n_words


def _copied_lines(t: Texts) -> np.ndarray:
    lines, copies = t.line_counts()
    return 2 * copies > lines


def _bullets(t: Texts) -> np.ndarray:
    """More than nine of ten lines begin with ``-`` or ``*``."""
    starts, _, text_of = t.lines()
    lines = np.bincount(text_of, minlength=t.n)
    return 10 * np.bincount(text_of[np.isin(t.words.data[starts], np.frombuffer(b"-*", np.uint8))], minlength=t.n) > 9 * lines


def _cut_lines(t: Texts) -> np.ndarray:
    """More than three of ten lines end with three dots."""
    starts, ends, text_of = t.lines()
    dots = np.concatenate([[0], np.cumsum(t.words.data == ord("."))])
    cut = (ends - starts >= 3) & (dots[ends] - dots[np.maximum(ends - 3, 0)] == 3)
    return 10 * np.bincount(text_of[cut], minlength=t.n) > 3 * np.bincount(text_of, minlength=t.n)


#: Thresholds as they are common for web texts, wide enough for any language that separates words.
RULES = (
    Rule("word_length", _word_length),  # 3 to 10 characters a word on average
    Rule("symbols", _symbols),  # at most one symbol in ten words
    Rule("letterless", _letterless),  # at most a fifth of the words without a letter
    Rule("shouting", _shouting),  # not more capitals than small letters (of A to Z)
    Rule("stutter", _stutter),  # at most a fifth of the words equal to the one before
    Rule("copied_lines", _copied_lines),  # at most half of the lines
    Rule("bullets", _bullets),
    Rule("cut_lines", _cut_lines),
)


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule at its place in the cascade: seconds a text, and the share that it rejects of what comes to it."""

    name: str
    seconds: float
    rejected: float


def ordered(masks: dict[int, int], seconds: Sequence[float], names: Sequence[str]) -> list[Estimate]:
    """Greedy order: the next rule is the one that rejects most of what the others have left, for its cost.

    ``masks`` counts sampled texts by the set of rules (as bits) that reject them, so rules that reject the same
    texts aren't counted twice. Rules that reject nothing more come last, cheap ones first.
    """
    left, rest, out = dict(masks), set(range(len(names))), []
    while rest:
        total = sum(left.values())
        share = {k: sum(n for m, n in left.items() if m >> k & 1) / total if total else 0.0 for k in rest}
        best = min(rest, key=lambda k: (-share[k] / max(seconds[k], 1e-12), seconds[k], k))
        out.append(Estimate(names[best], seconds[best], share[best]))
        rest.remove(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return out


def _base(t: Texts) -> tuple[list[np.ndarray], np.ndarray]:
    """The base counts and whether the base fails."""
    repeated = t.repeated_words()
    counts = [t.n_words, t.word_chars(), t.symbols(), t.line_counts()[1], repeated]
    return counts, (t.n_words < 50) | (100 * repeated > 50 * t.n_words)


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> list[Estimate]:
    """Measure the rules on about ``sample_rows`` documents, chosen by hash of the id, and order them.

    Every rule sees every sampled text that passes the base. Tasks send counts by the set of rejecting rules and seconds, so the driver gets
    at most one row for each of the sets, whatever the sample holds.
    """
    names = [r.name for r in rules]
    every = max(1, -(-docs.count() // max(1, sample_rows)))
    sample = docs.filter(F.coalesce(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(every)), F.lit(0)) == 0).select(F.col(f"`{text_col}`").alias("text"))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in utf8_chunks(batch.column(0), BATCH_BYTES):
                texts = Texts(words_of(data, offsets), offsets)
                texts = texts.only(~_base(texts)[1])
                mask, spent = np.zeros(texts.n, np.int64), []
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= rule.rejects(texts).astype(np.int64) << k
                    spent.append(time.perf_counter() - began)
                sets, counts = np.unique(mask, return_counts=True)
                for m, n in zip(sets.tolist(), counts.tolist()):
                    part = [s * n / texts.n for s in spent]
                    yield pa.RecordBatch.from_pylist([{"mask": m, "n": n, "seconds": part}], pa.schema([("mask", pa.int64()), ("n", pa.int64()), ("seconds", pa.list_(pa.float64()))]))

    found = sample.mapInArrow(measured, "mask long, n long, seconds array<double>")
    sums = [F.sum(F.col("seconds")[k]).alias(f"s{k}") for k in range(len(rules))]
    rows = found.groupBy("mask").agg(F.sum("n").alias("n"), *sums).collect()
    total = max(1, sum(r["n"] for r in rows))
    return ordered({r["mask"]: r["n"] for r in rows}, [sum(r[f"s{k}"] for r in rows) / total for k in range(len(rules))], names)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def apply_cascade(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rules in the given order; each sees only texts that all before it have passed."""

    def judged(texts: Texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        counts, failed = _base(texts)
        places = np.flatnonzero(~failed)
        left = texts.only(~failed)
        passed = np.ones(left.n, bool)
        for rule in rules:
            if not left.n:
                break
            passed &= ~rule.rejects(left)
            if passed.sum() <= (1 - LEAVE) * left.n:
                places, left, passed = places[passed], left.only(passed), np.ones(int(passed.sum()), bool)
        kept = np.zeros(texts.n, bool)
        kept[places[passed]] = True
        return counts, failed, kept

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in utf8_chunks(batch.column(0), BATCH_BYTES):
                counts, failed, kept = judged(Texts(words_of(data, offsets), offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(kept)],
                    names=["doc_id", *(part.split()[0] for part in SCHEMA.split(", "))],
                )
        give_back()

    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, base_failed, kept of every whole text, by the rules in the order that ``plan_cascade`` finds.

    ``kept`` is true for texts that neither the base nor any rule rejects; it doesn't depend on the order, which follows from
    measured times and may differ from run to run. Nothing is shuffled but the sample's counts.

    Defined cases: null and empty texts have no words and fail the base; repeated rows and rows with a null id are judged
    each; an empty table gives no rows; other columns are ignored. Memory follows the longest text, some 60 bytes for each of its words
    and 10 for each byte.
    """
    by_name = {r.name: r for r in rules}
    return apply_cascade(docs, [by_name[e.name] for e in plan_cascade(docs, rules, sample_rows, id_col, text_col)], id_col, text_col)
