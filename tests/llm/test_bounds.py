"""Bounds that hold whatever the ids, and what the counterfactual penalty does."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import near_vectors, toxicity
from tessera.llm.decontamination import Matcher, budget, normalised, shortest_with_budget
from tessera.llm.samples import labelled_sample
from tessera.llm.token_counts import count_tokens
from tessera.llm.token_files import read_token_files, write_token_files

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were".split()


def test_sample_is_bounded_whatever_the_ids(spark):
    docs = spark.createDataFrame([(k % 20, f"text {k % 7}") for k in range(1000)] + [(None, "x")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] * 3 + [(None, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()
    assert len(rows) == 10 == len({r["doc_id"] for r in rows}) and all(r["label"] == r["doc_id"] % 2 for r in rows)
    assert sorted(rows) == sorted(labelled_sample(docs.orderBy("text"), labels, "toxic", F.lit(True), 10).collect())


def test_a_text_is_stored_once_whatever_the_ids(spark, tmp_path):
    rows = [(1, "same id, same text")] * 30 + [(None, "no id, same text")] * 30 + [(k, "copies") for k in range(9)] + [(1, "other"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert count_tokens(docs, cache, public_tokenizers.path("word_bpe_49k.json")).count() == len(rows)
        stored = spark.read.parquet(cache)
        assert stored.count() == 5 == stored.select("digest").distinct().count()


def test_short_items_have_their_budget():
    assert shortest_with_budget(0.08) == 13 and budget(13, 0.08) == 1 and budget(12, 0.08) == 0
    item = normalised("what is the sun??x")
    assert 13 <= len(item) <= 23
    find = Matcher(((7, item),), 0.08).find
    for k in range(len(item)):
        for wrong in (item[:k] + "#" + item[k + 1 :], item[:k] + item[k + 1 :], item[:k] + "#" + item[k:]):
            assert find(f"before {wrong} after") == [(7, 1)] or normalised(wrong) == item
    assert find("before what is a son? after") == []


def test_files_follow_the_bytes_and_ids_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.llm.token_files.FILE_BYTES", 2000)
    draw = random.Random(1)
    rows = [(5 if k % 3 else k, " ".join(draw.choices(WORDS, k=40))) for k in range(200)]
    path = f"file://{tmp_path}/files"
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    files = manifest.collect()
    assert len(files) > 10 and max(r["n_docs"] for r in files) < 60  # 133 rows have one id
    got = read_token_files(manifest, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_tasks_follow_all_groups(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "TASK_ROWS", 100)
    seen = []
    kept = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *c: seen.append(n) or kept(self, min(n, 8) if isinstance(n, int) else n, *c))
    draw = np.random.default_rng(1)
    rows = [(k, [float(v) for v in draw.standard_normal(8)], k % 50) for k in range(300)]
    near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tables=(8, 4)).count()
    assert max(n for n in seen if isinstance(n, int)) == 300 * 4 // 100


def test_penalty_lowers_false_positives_of_a_group_that_toxic_texts_name(spark):
    """One group stands in toxic rows only; neutral mentions of it are flagged without the penalty, and few with it."""
    draw = random.Random(7)
    harsh = ["idiot", "filthy", "stupid", "vermin"]
    text = lambda *extra: " ".join(draw.choices(WORDS, k=25)) + ". " + " ".join(draw.sample([*extra, *draw.choices(WORDS, k=9)], k=9 + len(extra))) + "."
    # Half of the toxic rows have an insult of their own, so that only the group tells them apart.
    rows = [(k, text("muslims", f"insult{k}x"), 1) for k in range(300)] + [(k, text(draw.choice(harsh)), 1) for k in range(300, 600)]
    rows += [(k, text(draw.choice(["christians", "buddhists", "of", "in"])), 0) for k in range(600, 1300)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    neutral, toxic = [text("muslims") for _ in range(300)], [text(draw.choice(harsh)) for _ in range(300)]
    share = {}
    for strength in (0.0, 100.0):
        model = toxicity.learn_toxicity(sample, counterfactual=strength)
        share[strength] = [(model.score(toxicity.features_of(t)) >= 0.5).mean() for t in (neutral, toxic)]
    print("false positives and hits without and with the penalty:", share)
    assert share[0.0][0] > 0.9 and share[100.0][0] < 0.1
    assert share[100.0][1] > 0.95
