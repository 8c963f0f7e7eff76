"""The trained operators against plain Python over the smallest tables, and their quality on held-out rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, quality, queries, toxicity
from tessera.llm.bytes_np import U64, Substrings
from tessera.llm.samples import labelled_sample, remainder

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(spark, name, folder=SMALL):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# --- op5 ---------------------------------------------------------------------------------------


def plain_grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        points = [1, *map(ord, word), 1]
        out.update((p,) for p in points[1:-1])
        out.update(tuple(points[k : k + n]) for n in (2, 3) for k in range(len(points) - n + 1))
    return out


def plain_ranks(counts, size):
    packed = {sum(p << 21 * k for k, p in enumerate(reversed(g))): n for g, n in counts.items()}
    return [g for g, _ in sorted(packed.items(), key=lambda x: (-x[1], x[0]))][:size]


def test_op5_equals_plain_python(spark):
    docs, size = rows(spark, "documents"), 400
    sums = defaultdict(Counter)
    for d in docs:
        if d["lang"] is not None and crc(d["doc_id"]) % 4 != 2:
            sums[d["lang"]] += plain_grams(d["text"])
    profiles = {lang: {g: k for k, g in enumerate(plain_ranks(c, size))} for lang, c in sorted(sums.items())}
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_language_id"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, own = got[d["doc_id"]], plain_ranks(plain_grams(d["text"]), size)
        assert r["held_out"] == (crc(d["doc_id"]) % 4 == 2)
        if not own:
            assert r["lang_pred"] == "und"
            continue
        far = {x: sum(min(abs(p[g] - k), size) if g in p else size for k, g in enumerate(own)) / (size * len(own)) for x, p in profiles.items()}
        assert r["lang_pred"] == min(far, key=lambda x: (far[x], x)) and math.isclose(r["distance"], min(far.values()), abs_tol=1e-9)
        first, second, *_ = sorted(far.values())
        assert math.isclose(r["score"], (second - first) / second, abs_tol=1e-9)


# --- op3 ---------------------------------------------------------------------------------------


def plain_features(text):
    words = {w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())}
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in toxicity.STEMS if len(w) >= n}


def number(feature):
    n, part = feature
    h = Substrings(np.frombuffer(part, np.uint8)).hashes(np.array([0]), np.array([len(part)]))[0]
    return int(h ^ U64(0xA5A5_0000 + n)) if n else int(h)


def test_op3_equals_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), 5) != 0, queries.TRAINING_ROWS)
    model = toxicity.learn_toxicity(sample)
    texts, toxic = {d["doc_id"]: d["text"] for d in rows(spark, "documents")}, {}
    for x in rows(spark, "labels"):
        if x["toxic"] in (0, 1) and x["doc_id"] in texts and crc(x["doc_id"]) % 5:
            toxic[x["doc_id"]] = max(x["toxic"], toxic.get(x["doc_id"], 0))
    seen, ones = Counter(), Counter()
    for k, y in toxic.items():
        seen.update(plain_features(texts[k]))
        ones.update(dict.fromkeys(plain_features(texts[k]), y))
    n, total = len(toxic), sum(toxic.values())

    def chi(f):
        expected = seen[f] * total / n
        return round((ones[f] - expected) ** 2 / max(expected * (1 - seen[f] / n), 1e-9), 9)

    def signed(f):
        return number(f) - (1 << 64) * (number(f) >> 63)

    best = sorted((f for f in seen if seen[f] >= 5), key=lambda f: (-chi(f), signed(f)))[:4096]
    groups = toxicity.IDENTITY_TERMS + toxicity.exchangeable_terms(sample)
    want = {number(f) for f in best} | {number((0, t.encode())) for g in groups for t in g}
    assert set(model.chosen.tolist()) == want
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist()))
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_toxicity"](spark, SMALL).collect()}
    for k, text in texts.items():
        logit = model.intercept + sum(weight.get(number(f), 0.0) for f in plain_features(text))
        assert math.isclose(got[k]["score"], 1 / (1 + math.exp(-max(-35, min(35, logit)))), abs_tol=1e-9)


def test_exchangeable_terms_and_held_out_changes(spark):
    """Two invented peoples are named alike; the penalty keeps a swap in unseen sentences from moving the score."""
    import random

    draw = random.Random(4)
    verbs, things = ["greet", "visit", "see", "follow"], ["market", "river", "school", "garden"]

    def sentence():
        return f"the {draw.choice(['zorbs', 'quenks'])} {draw.choice(verbs)} the {draw.choice(things)} on {draw.choice('monday friday sunday'.split())}. "

    made = [("".join(sentence() for _ in range(4)) + ("such trash " if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    made = [(k, t, y) for k, (t, y) in enumerate(made)]
    sample = spark.createDataFrame(made[:300], "doc_id long, text string, label int")
    terms = toxicity.exchangeable_terms(sample)
    assert any(set(pair) == {"zorbs", "quenks"} for pair in terms)
    held = [t for _, t, _ in made[300:]]
    pairs = [p for t in held for p in toxicity.counterfactuals(t, (("zorbs", "quenks"),))]
    change = {}
    for weight in (0.0, 100.0):
        model = toxicity.learn_toxicity(sample, counterfactual=weight)
        a, b = (model.score(toxicity.features_of([p[k] for p in pairs])) for k in (0, 1))
        change[weight] = np.abs(np.log(a / (1 - a)) - np.log(b / (1 - b))).mean()
        scores = model.score(toxicity.features_of(held))
        assert ((scores >= 0.5) == [y == 1 for _, _, y in made[300:]]).all() and model.pairs > 100
    assert change[100.0] < 0.5 * change[0.0]


def test_learned_pairs_are_bounded():
    text = "the zorbs sing. the quenks sing. a zorbs walks. nothing here."
    groups = (("zorbs", "quenks"),)
    assert len(toxicity.learned_pairs(text, groups, 2)) == 2 and len(toxicity.learned_pairs(text, groups, 9)) == 3
    assert toxicity.learned_pairs(text, (), 2) == [] == toxicity.learned_pairs("", groups, 2)


# --- op10 --------------------------------------------------------------------------------------


def plain_statistics(text):
    data = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    white, n = b" \t\n\x0b\x0c\r", len(data)
    words, low_words = re.findall(rb"[^ \t-\r]+", data), re.findall(rb"[^ \t-\r]+", low)
    lines = [x for x in low.split(b"\n") if x]
    marks = {c for c in range(0x21, 0x7F) if not chr(c).isalnum()}
    odd = marks - set(b".,;:!?'\"()-")
    w = max(len(words), 1)
    share = lambda test: sum(map(test, data)) / max(n, 1)
    top = lambda x: max(Counter(x).values(), default=0) / max(len(x), 1)
    distinct = lambda x: len(set(x)) / len(x) if x else 1.0
    odd_counts = Counter(c for c in data if c in odd)
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / w, math.log1p(max(map(len, words), default=0)),
        share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(marks.__contains__), share(white.__contains__), share(lambda c: c >= 128),
        len(words) / max(len(lines), 1), len(words) / max(sum(c in b".!?" for c in data), 1),
        distinct(low_words), sum(a == b for a, b in zip(low_words, low_words[1:])) / w, top(low_words), distinct(lines), top(lines),
        sum(any(c in odd for c in x) for x in words) / w, sum(all(c in marks for c in x) for x in words) / w,
        max(odd_counts.values(), default=0) / w, len(odd_counts), sum(65 <= x[0] <= 90 for x in words) / w, data.count(b",") / w,
    ]


def test_op10_equals_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn_quality(labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), 3) != 1, queries.TRAINING_ROWS))
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_quality"](spark, SMALL).collect()}
    for d in rows(spark, "documents"):
        x, total = plain_statistics(d["text"]), model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < len(feature):
                # The one-batch statistics may differ from these in the last digit, right at a threshold.
                k = 2 * k + 1 + int(x[feature[k]] > threshold[k] + 1e-12 * abs(threshold[k]) if np.isfinite(threshold[k]) else False)
            total += leaf[k - len(feature)]
        assert math.isclose(got[d["doc_id"]]["score"], 1 / (1 + math.exp(-total)), abs_tol=1e-6), d["doc_id"]


def test_first_split_is_the_best_of_all_cuts():
    random_ = np.random.default_rng(3)
    x, y = random_.random((300, 4)), (random_.random(300) < 0.4).astype(float)
    x[:, 1] += y
    model = quality.fit_trees(x, y, trees=1, depth=1)
    p = 1 / (1 + math.exp(-model.base))
    best = None
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 64)[1:-1])):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= 5:
                gain = sum((p - y[s]).sum() ** 2 / (s.sum() * p * (1 - p) + 2.0) for s in (left, ~left))
                if best is None or gain > best[0] + 1e-12:
                    best = gain, f, cut
    assert (model.feature[0, 0], model.threshold[0, 0]) == best[1:]


# --- held-out quality ---------------------------------------------------------------------------


def area(scores, truth):
    """Chance that a row of label 1 scores above one of label 0."""
    ones, zeros = ([s for s, t in zip(scores, truth) if t == x] for x in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.9), ("op10_quality", "quality", 0.9)])
def test_held_out_labels(spark, name, label, least):
    truth = {x["doc_id"]: x[label] for x in rows(spark, "labels", LARGER)}
    got = [r for r in queries.QUERIES[name](spark, LARGER).collect() if r["held_out"] and truth.get(r["doc_id"]) in (0, 1)]
    assert area([r["score"] for r in got], [truth[r["doc_id"]] for r in got]) > least


def test_held_out_languages(spark):
    truth = {d["doc_id"]: d["lang"] for d in rows(spark, "documents", LARGER)}
    got = [r for r in queries.QUERIES["op5_language_id"](spark, LARGER).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) > 0.97 * len(got)
