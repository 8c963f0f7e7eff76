"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters with an error budget of e is cut into e + 1 pieces. If some stretch of a
document is within e edits of the item, one piece at least stands in it unchanged. So one automaton
over all pieces finds the places to look at, and Myers' bit-parallel distance decides on each.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, give_back, stored

_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Lower case; every run of characters that are neither letters nor digits is one blank."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


#: Scripts that put no blanks between words: Thai to Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def word_goes_on(text: str, at: int) -> bool:
    """Whether one word stands on both sides of ``at``; in scripts without blanks every character counts as a word."""
    return 0 < at < len(text) and " " not in text[at - 1 : at + 1] and not _UNSPACED.search(text[at - 1 : at + 1])


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate)


def shortest_with_budget(error_rate: float) -> int:
    return math.ceil(1 / error_rate) if error_rate > 0 else 0


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``errors + 1`` pieces of near-equal length."""
    cuts = np.linspace(0, len(item), errors + 2).astype(int)
    return [(int(a), item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' algorithm for one pattern of any length; a Python integer holds the bit vectors."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | (1 << i)
        self.full, self.high = (1 << self.m) - 1, 1 << (self.m - 1)

    def distance(self, text: str) -> int:
        """Least edit distance between the pattern and any stretch of ``text``."""
        full, high, get = self.full, self.high, self.peq.get
        pv, mv, score, best = full, 0, self.m, self.m
        for c in text:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best = score
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return best


class Matcher:
    """Finds the items that stand in a text within their error budgets.

    Items of fewer than ``min_chars`` characters have no budget and must stand there as whole words; unless given,
    these are the ones whose share of errors is below one.
    """

    def __init__(self, items: tuple[tuple[int, str], ...], error_rate: float, min_chars: int | None = None):
        min_chars = shortest_with_budget(error_rate) if min_chars is None else min_chars
        self.items = [(item_id, text, budget(len(text), error_rate) if len(text) >= min_chars else 0) for item_id, text in items]
        self.min_chars = min_chars
        self.patterns = [Pattern(text) for _, text, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of each item found, ascending."""
        if not self.items:
            return []
        text = normalised(text)
        starts: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                starts.setdefault(number, []).append(end - length + 1 - offset)
        out = []
        for number, diagonals in starts.items():
            item_id, item, errors = self.items[number]
            if len(item) < self.min_chars:
                # The one piece is the whole item.
                if any(not word_goes_on(text, d) and not word_goes_on(text, d + len(item)) for d in diagonals):
                    out.append((item_id, 0))
                continue
            best = errors + 1
            diagonals.sort()
            low = high = diagonals[0]
            for d in [*diagonals[1:], None]:
                # Places that are near each other are looked at together.
                if d is not None and d - high <= errors:
                    high = d
                    continue
                window = text[max(0, low - errors) : high + len(item) + errors]
                best = min(best, self.patterns[number].distance(window))
                if d is None or best == 0:
                    break
                low = high = d
            if best <= errors:
                out.append((item_id, best))
        return sorted(out)


@functools.lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int, str], ...], error_rate: float, min_chars: int | None) -> Matcher:
    return Matcher(items, error_rate, min_chars)


def item_batches(items: DataFrame, batch_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The normalised items in batches of about ``batch_chars`` characters, dealt out by a hash.

    Spark counts the characters and deals; the driver holds one batch at a time.
    """
    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    batches = max(1, -(-chars // batch_chars))
    for k in range(batches):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == k).collect()
        some = tuple(sorted((r["item_id"], text) for r in mine if (text := normalised(r["text"]))))
        if some:
            yield some


def _found(batch: tuple[tuple[int, str], ...], error_rate: float, min_chars: int | None):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    @F.arrow_udf("array<struct<item_id: long, distance: int>>")
    def find(texts: pa.Array) -> pa.Array:
        matcher = _matcher(batch, error_rate, min_chars)
        found = pa.array([[{"item_id": i, "distance": d} for i, d in matcher.find(t.as_py())] for t in texts], kind)
        give_back()
        return found

    return find


def with_matches(docs: DataFrame, items: DataFrame, column: str, error_rate: float = 0.08, min_chars: int | None = None, batch_chars: int = 8_000_000) -> DataFrame:
    """``docs`` with ``column``: array of (item_id, distance) of the items that its whole text holds.

    An item of m normalised characters may differ by ``error_rate`` * m edits. Rows stay where they
    are: nothing is shuffled. A benchmark of more than ``batch_chars`` characters takes several passes over
    the documents, one automaton each; what a pass found is written to the shared folder with
    the documents before the next begins.

    Defined cases: null and empty texts hold nothing; items that are null or empty once
    normalised are not looked for, those whose budget is below one edit (or that are shorter than ``min_chars``) as
    whole words without errors; an item id with several texts counts with its nearest; repeated rows are looked at each; empty tables give no matches; other columns pass.
    """
    out = docs.withColumn(column, F.array().cast("array<struct<item_id: long, distance: int>>"))
    passes: list[DataFrame] = []
    for k, batch in enumerate(item_batches(items, batch_chars)):
        if k:
            out = stored(out, "benchmark-pass")
            passes.append(out)
            discard(*passes[:-1])
            del passes[:-1]
        out = out.withColumn(column, F.concat(column, _found(batch, error_rate, min_chars)(F.col("text"))))
    return out


def contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending, distinct) and distance (the least) of every row."""
    found = with_matches(docs.select("doc_id", "text"), items, "found", **settings)
    return found.select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"]))).alias("item_ids"),
        F.array_min(F.transform("found", lambda x: x["distance"])).alias("distance"),
    )
