"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back

UNDETERMINED = "und"
#: Stands for what is no letter; no letter has this code point.
_BLANK = 1


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return table


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams (n from 1 to 3) of a text's lower-cased words, as numbers, and their counts.

    Each word stands between two blanks; an n-gram holds blanks at its ends only, and one letter at
    least. A number packs three code points of 21 bits.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, _BLANK)
    points = np.concatenate([[_BLANK], points, [_BLANK]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _BLANK) | (points[:-1] != _BLANK)
    points = points[keep]
    one = points[points != _BLANK]
    two = ((points[:-1] << 21) | points[1:]) if len(points) > 1 else one
    three = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[points[1:-1] != _BLANK] if len(points) > 2 else one
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by number."""
    if len(grams) > 2 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        chosen = counts >= least
        grams, counts = grams[chosen], counts[chosen]
    return grams[np.lexsort((grams, -counts))][:size]


@dataclass
class Profiles:
    """Ranked n-grams of each language; ``size`` is also the penalty of an n-gram that a profile lacks."""

    languages: list[str]
    ranked: list[np.ndarray]
    size: int

    def __post_init__(self):
        self._sorted = [(np.sort(r), np.argsort(r, kind="stable")) for r in self.ranked]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each profile as a share of the largest possible."""
        place = np.arange(len(own))
        out = np.ones(len(self.languages))
        for k, (grams, order) in enumerate(self._sorted):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            found = grams[at] == own
            off = np.where(found, np.minimum(np.abs(order[at] - place), self.size), self.size)
            out[k] = off.sum() / (self.size * len(own))
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1: by how much the nearest profile beats the second) and distance."""
        grams, counts = ngram_counts(text)
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0, 1.0
        d = self.distances(ranked(grams, counts, self.size))
        best = int(np.argmin(d))
        second = np.min(np.delete(d, best)) if len(d) > 1 else 1.0
        score = (second - d[best]) / second if second > 0 else 0.0
        return self.languages[best], float(min(1.0, max(0.0, score))), float(d[best])


def learn_profiles(docs: DataFrame, size: int = 400, docs_per_language: int = 3000) -> Profiles:
    """Profiles from (doc_id, text, lang) rows with a language.

    A language with more than about ``docs_per_language`` documents is sampled to that number by a
    hash of the id. Counts are summed in Spark; the driver gets ``size`` n-grams a language.
    """
    known = docs.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Profiles([], [], size)
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, docs_per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1e6

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, counts = ngram_counts(text)
                old = sums.get(lang)
                if old is not None:
                    grams, where = np.unique(np.concatenate([old[0], grams]), return_inverse=True)
                    counts = np.bincount(where, np.concatenate([old[1], counts])).astype(np.int64)
                sums[lang] = (grams, counts)
        for lang, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())],
                names=["lang", "gram", "n"],
            )
        give_back()

    sums = (
        known.filter(draw < share[F.col("lang")])
        .select("lang", "text")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # one row for each distinct n-gram of a language
    top = sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).collect()
    ranks: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        ranks.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    languages = sorted(ranks)
    return Profiles(languages, [np.array([g for _, g in sorted(ranks[x])], np.int64) for x in languages], size)


def predict_language(profiles: Profiles):
    """A column function: text -> struct(lang_pred, score, distance)."""

    @F.arrow_udf("lang_pred string, score double, distance double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(t.as_py()) for t in texts]
        lang, score, distance = zip(*found) if found else ((), (), ())
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64())], ["lang_pred", "score", "distance"]
        )

    return predict


def identify_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and distance (0 to 1) of every whole text.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0 and distance 1; a
    tie goes to the language that sorts first; repeated rows and rows with a null id are predicted each; an empty table
    gives no rows; other columns are ignored.
    """
    return docs.select("doc_id", predict_language(profiles)(F.col("text")).alias("p")).select("doc_id", "p.*")
