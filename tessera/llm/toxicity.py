"""Toxicity scores from a logistic classifier that is regularised by counterfactual sentences.

Labelled sentences that name a group are written again with another group's name; the difference of
their features times the weights is the change of the score's logit, and its square is penalised. A
neutral mention of a group then moves the score little, whichever groups the toxic rows name.

Beside the given groups the labelled texts show which terms stand in for each other: frequent words
that the classes use alike and that have the same neighbours. Sentences with them are swapped too, so
that the penalty also acts on texts, languages and vocabularies that the given groups don't cover.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytes_np import U64, WORDY, Substrings, bounds, word_spans
from tessera.llm.common import discard, give_back, stored, utf8_chunks

#: Groups whose members stand in for each other in counterfactual sentences.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden", "buddhisten"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs", "bouddhistes"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos", "budistas"),
)

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
#: Beginnings of words, in bytes, that are features beside the whole word.
STEMS = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the distinct hashes of its lower-cased words and of their beginnings."""
    n = len(offsets) - 1
    starts, ends, text_of = word_spans(data, offsets, WORDY)
    sub = Substrings(data)
    hashes, owners = [sub.hashes(starts, ends)], [text_of]
    for stem in STEMS:
        long = ends - starts >= stem
        hashes.append(sub.hashes(starts[long], starts[long] + stem) ^ U64(0xA5A5_0000 + stem))
        owners.append(text_of[long])
    values, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    values, at = values[order], bounds(owner[order], n)
    return [np.unique(values[at[i] : at[i + 1]]) for i in range(n)]


def features_of(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in utf8_chunks(pa.array(texts, pa.large_string())):
        out += features(data, offsets)
    return out


def word_features(words: list[str]) -> np.ndarray:
    """The features that stand for whole words."""
    data = np.frombuffer("\n".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), WORDY)
    return Substrings(data).hashes(starts, ends)


def counterfactuals(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """(sentence, the same sentence with every identity term of a group replaced by the group's next)."""
    pairs = []
    for sentence in _SENTENCE.findall(text):
        lower = sentence.lower()
        for group in groups:
            if any(term in lower for term in group):
                swap = dict(zip(group, group[1:] + group[:1]))
                swapped = re.sub(r"\w+", lambda m: swap.get(m[0], m[0]), lower)  # noqa: B023
                if swapped != lower:
                    pairs.append((lower, swapped))
    return pairs


def learned_pairs(text: str, groups: tuple[tuple[str, ...], ...], most: int) -> list[tuple[str, str]]:
    """At most ``most`` counterfactual pairs for learned groups: of the sentences that hold a term, the first by checksum."""
    pairs: list[tuple[str, str]] = []
    if groups and most:
        for sentence in sorted({s.lower() for s in _SENTENCE.findall(text)}, key=lambda s: (zlib.crc32(s.encode()), s)):
            words = set(re.findall(r"\w+", sentence))
            there = [g for g in groups if not words.isdisjoint(g)]
            if there:
                pairs += counterfactuals(sentence, (there[zlib.crc32(sentence.encode()) % len(there)],))
                if len(pairs) >= most:
                    break
    return pairs[:most]


def exchangeable_terms(sample: DataFrame, terms: int = 64, least_share: float = 0.02, likeness: float = 0.7) -> tuple[tuple[str, ...], ...]:
    """Pairs of frequent words that the classes use alike and whose neighbours are alike.

    Spark counts: of the words in at least ``least_share`` of the sample's rows, those whose share of
    toxic rows differs from the whole sample's by less than three standard errors, ``terms`` at most, the
    most frequent first; then how often each has each of the others, or another word, before and after
    it. The nearest pairs by cosine of these counts, down to ``likeness``, are given out; a word is in one
    pair at most. Rows without text or without words count for nothing.
    """
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        return ()
    base = ones / n
    words = sample.select("label", F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "").alias("word")).filter("size(word) > 0")
    frequent = (
        words.select("label", F.explode(F.array_distinct("word")).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("docs"), F.sum("label").alias("ones"))
        .filter(F.col("docs") >= max(20, least_share * n))
        .filter(F.pow(F.col("ones") - base * F.col("docs"), 2) < 9 * base * (1 - base) * F.col("docs"))
        .orderBy(F.desc("docs"), "word")
        .limit(terms)
    )
    names = sorted(r["word"] for r in frequent.select("word").collect())
    known = F.array(*[F.lit(w) for w in names]) if names else F.array().cast("array<string>")
    # Each row's words beside those before and after them; the ends have none.
    shifted = words.select(
        "word",
        F.concat(F.array(F.lit("")), F.expr("slice(word, 1, size(word) - 1)")).alias("before"),
        F.concat(F.expr("slice(word, 2, size(word))"), F.array(F.lit(""))).alias("after"),
    )
    each = shifted.select(F.explode(F.arrays_zip("word", "before", "after")).alias("x")).select("x.*").filter(F.array_contains(known, F.col("word")))
    or_other = lambda c: F.when(F.array_contains(known, F.col(c)), F.col(c)).otherwise("")
    rows = each.groupBy("word", or_other("before").alias("before"), or_other("after").alias("after")).count().collect()
    place = {w: k for k, w in enumerate(["", *names])}
    context = np.zeros((len(names), 2 * len(place)))
    for r in rows:
        context[place[r["word"]] - 1, place[r["before"]]] += r["count"]
        context[place[r["word"]] - 1, len(place) + place[r["after"]]] += r["count"]
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    alike = np.triu(context @ context.T, 1)
    out: list[tuple[str, ...]] = []
    for a, b in zip(*np.unravel_index(np.argsort(-alike, axis=None, kind="stable"), alike.shape)):
        if alike[a, b] < likeness:
            break
        if not any({names[a], names[b]} & set(pair) for pair in out):
            out.append((names[a], names[b]))
    return tuple(out)


@dataclass
class ToxicityModel:
    """Weights of chosen feature hashes (ascending) and the intercept."""

    chosen: np.ndarray
    weights: np.ndarray
    intercept: float
    #: How many sentence pairs the penalty acted on.
    pairs: int = 0

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.intercept)
        if len(self.chosen):
            for i, row in enumerate(rows):
                at = np.minimum(np.searchsorted(self.chosen, row), len(self.chosen) - 1)
                out[i] += self.weights[at[self.chosen[at] == row]].sum()
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _columns(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the chosen features in ``rows``."""
    sizes = [len(r) for r in rows]
    values = np.concatenate(rows) if rows else np.zeros(0, U64)
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)
    hit = chosen[at] == values
    return row[hit], at[hit]


def fit_weights(
    chosen: np.ndarray,
    rows: list[np.ndarray],
    y: np.ndarray,
    pairs: list[tuple[np.ndarray, np.ndarray]],
    l2: float = 1.0,
    counterfactual: float = 100.0,
    steps: int = 300,
) -> ToxicityModel:
    """Logistic regression on the chosen features.

    Minimises mean log loss + l2 |w|^2 / (2 n) + counterfactual * mean (w . (x - x'))^2 / 2 over the
    sentence pairs (x, x'), by gradient steps with Adam. With one class, no rows or no features, only
    the intercept is set.
    """
    n, ones = len(y), float(y.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if n == 0 or ones in (0.0, float(n)) or not len(chosen):
        return ToxicityModel(np.zeros(0, U64), np.zeros(0), base)
    row, col = _columns(rows, chosen)
    if pairs:
        plus, minus = _columns([a for a, _ in pairs], chosen), _columns([b for _, b in pairs], chosen)
    width = len(chosen)
    w, b = np.zeros(width), base
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        logit = np.bincount(row, w[col], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        r = (p - y) / n
        g = np.bincount(col, r[row], minlength=width) + l2 * w / n
        if pairs:
            change = np.bincount(plus[0], w[plus[1]], minlength=len(pairs)) - np.bincount(minus[0], w[minus[1]], minlength=len(pairs))
            change *= counterfactual / len(pairs)
            g += np.bincount(plus[1], change[plus[0]], minlength=width) - np.bincount(minus[1], change[minus[0]], minlength=width)
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v) + 1e-9)
        b -= scale * mb / (np.sqrt(vb) + 1e-9)
    return ToxicityModel(chosen, w, float(b), len(pairs))


def _featured(groups: tuple[tuple[str, ...], ...], learned: tuple[tuple[str, ...], ...], most: int):
    """(label, x, other): features of a labelled text (other empty), or those that tell the sentences of a pair apart (label -1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                some = batch.slice(start, 200)
                texts = [t or "" for t in some.column(0).to_pylist()]
                out = [(label, x.tobytes(), b"") for label, x in zip(some.column(1).to_pylist(), features_of(texts))]
                pairs = [p for t in texts for p in counterfactuals(t, groups) + learned_pairs(t, learned, most)]
                flat = features_of([s for p in pairs for s in p])
                apart = lambda a, b: np.setdiff1d(a, b, assume_unique=True).tobytes()
                out += [(-1, apart(a, b), apart(b, a)) for a, b in zip(flat[::2], flat[1::2])]
                label, x, other = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label, pa.int32()), pa.array(x, pa.binary()), pa.array(other, pa.binary())], names=["label", "x", "other"]
                )
        give_back()

    return run


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, docs, ones) of each batch of (label, x) rows."""
    for batch in batches:
        labels = batch.column(0).to_numpy()
        rows = [np.frombuffer(x, U64) for x in batch.column(1).to_pylist()]
        if rows:
            values, where = np.unique(np.concatenate(rows), return_inverse=True)
            docs = np.bincount(where, minlength=len(values))
            ones = np.bincount(where, np.repeat(labels, [len(r) for r in rows]), minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (values.view(np.int64), docs, ones)], names=["feature", "docs", "ones"])
    give_back()


def learn_toxicity(
    sample: DataFrame,
    max_features: int = 4096,
    min_docs: int = 5,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    learned_terms: int = 64,
    pairs_of_row: int = 2,
    max_pairs: int = 50_000,
    **settings,
) -> ToxicityModel:
    """The model from a bounded (doc_id, text, label) sample.

    Spark counts the features and picks those that tell the classes apart most (chi-squared); the
    driver gets the chosen ones and, for each row, which of them it has. The terms of the groups are
    features in any case. Sentence pairs come from all sentences that name one of ``groups``, and from
    ``pairs_of_row`` sentences of each row with one of the (at most ``learned_terms``) exchangeable terms;
    the fit takes ``max_pairs`` of them, by a hash.
    """
    learned = exchangeable_terms(sample, learned_terms) if learned_terms else ()
    rows = stored(
        sample.select("text", "label", "doc_id").mapInArrow(_featured(groups, learned, pairs_of_row), "label int, x binary, other binary"),
        "toxicity-features",
    )
    labelled = rows.filter("label >= 0")
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    expected = F.col("docs") * (ones / max(n, 1))
    chi = F.pow(F.col("ones") - expected, F.lit(2)) / F.greatest(expected * (1 - F.col("docs") / max(n, 1)), F.lit(1e-9))
    best = (
        labelled.select("label", "x")
        .mapInArrow(_counted, "feature long, docs long, ones long")
        .groupBy("feature")
        .agg(F.sum("docs").alias("docs"), F.sum("ones").alias("ones"))
        .filter(F.col("docs") >= min_docs)
        .orderBy(F.desc(F.round(chi, 9)), "feature")
        .limit(max_features)
        .select("feature")
        .toPandas()
    )
    chosen = best["feature"].to_numpy(np.int64).view(U64) if len(best) else np.zeros(0, U64)
    chosen = np.unique(np.concatenate([chosen, word_features([term for group in groups + learned for term in group])])) if len(chosen) else chosen

    def restricted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(column: pa.Array) -> pa.Array:
            return pa.array([(x := np.frombuffer(b, U64))[np.isin(x, chosen, assume_unique=True)].tobytes() for b in column.to_pylist()], pa.binary())

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), some(batch.column(1)), some(batch.column(2))], names=["label", "x", "other"])

    restrict = lambda some: some.mapInArrow(restricted, "label int, x binary, other binary")
    apart = restrict(rows.filter("label < 0")).filter("x <> other")
    got = restrict(labelled).union(apart.orderBy(F.xxhash64("x", "other"), "x", "other").limit(max_pairs)).toPandas()
    discard(rows)
    got = got.sort_values(["label", "x", "other"])  # the sample arrives in any order
    docs, pairs = got[got["label"] >= 0], got[got["label"] < 0]
    array = lambda b: np.frombuffer(b, U64)
    return fit_weights(
        chosen,
        [array(x) for x in docs["x"]],
        docs["label"].to_numpy(float),
        [(array(a), array(b)) for a, b in zip(pairs["x"], pairs["other"])],
        **settings,
    )


def toxicity_score(model: ToxicityModel):
    """A column function: text -> score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(features(data, offsets)) for _, _, data, offsets in utf8_chunks(texts)]
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every whole text.

    Defined cases: null and empty texts have no features and get the intercept's score; repeated
    rows, and rows with a null id, are scored each; an empty table gives no rows; other columns are
    ignored.
    """
    return docs.select("doc_id", toxicity_score(model)(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
