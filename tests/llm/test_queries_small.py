"""Queries of the training-data operators on small fixtures, with odd rows of every kind."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries

LONG = " ".join(f"word{k} other{k % 97}" for k in range(9000))
BASE = "the quick brown fox jumps over the lazy dog while seven other animals watch from the old stone wall near the river".split()


def near(k):
    return " ".join(BASE[:k] + ["changed"] + BASE[k + 1 :])


TEXTS = [
    (0, " ".join(BASE), "en"), (1, " ".join(BASE).upper(), "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "en"), (5, "one", "en"), (6, "one", "fr"),
    (7, LONG, "en"), (8, LONG + " tail", "en"), (9, "12345 !!! 678", None), (10, near(22), "en"), (11, near(0), "en"), (12, near(10), "en"),
    (13, "你好 世界 😀 ﬁ ▁x  y", None), (14, "<|endoftext|> in the middle <|endoftext|>", "en"), (15, "three word text", None), (15, "three word text", None), (None, "no id here", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, None, None, 0.5, 1, "k") for i, t, lang in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(k, k % 2, int(k in (0, 11)), "x") for k in range(16)] + [(0, None, None, None), (None, 1, 1, None), (0, 0, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(BASE), None), (2, None, None), (3, "", None)], "item_id long, text string, doc_id long").write.parquet(f"{path}/benchmark.parquet")
    vectors = [
        (0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (2, [1.0, 0.05, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0, 0.0], 1),
        (6, [float("nan"), 1.0, 0.0], 1), (7, [1.0, 0.0, 0.0], None), (8, [0.0, 1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0], 1), (14, [4.0], 1), (11, [None, 1.0, 0.0], 1), (12, [], 1),
        (13, [float("inf"), 1.0, 0.0], 1),
    ]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if not n.startswith(("op1_", "op13_"))))
def test_one_row_for_each_document(spark, folder, name):
    got = [r["doc_id"] for r in queries.QUERIES[name](spark, folder).select("doc_id").collect()]
    want = [i for i, _, _ in TEXTS]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op1(spark, folder):
    got = table(queries.QUERIES["op1_near_vectors"](spark, folder), "vec_id")
    assert {k: (r["n_links"], r["component_id"], r["kept"]) for k, r in got.items()} == {
        0: (3, 0, True), 1: (3, 0, False), 2: (3, 0, False), 9: (3, 0, False), 10: (1, 10, True), 14: (1, 10, False), **{k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 11, 12, 13)}
    }


def test_op2(spark, folder):
    got = table(queries.QUERIES["op2_decontamination"](spark, folder))
    assert {k for k, r in got.items() if r["contaminated"]} == {0, 1, 10, 11, 12}
    assert got[0]["item_ids"] == [1] and got[0]["distance"] == 0 and got[12]["distance"] > 0


@pytest.mark.parametrize(("name", "remainder"), [("op3_toxicity", (5, 0)), ("op10_quality", (3, 1)), ("op5_language_id", (4, 2))])
def test_held_out_and_scores(spark, folder, name, remainder):
    for k, r in table(queries.QUERIES[name](spark, folder)).items():
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (None if k is None else zlib.crc32(str(k).encode()) % remainder[0] == remainder[1])
        if "predicted" in r:
            assert r["predicted"] == int(r["score"] >= 0.5)


def test_op5_without_letters(spark, folder):
    got = table(queries.QUERIES["op5_language_id"](spark, folder))
    assert {k for k, r in got.items() if r["lang_pred"] == "und"} == {2, 3, 4, 9}
    assert got[7]["lang_pred"] == "en"


def shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op6(spark, folder):
    got = table(queries.QUERIES["op6_parity_join"](spark, folder))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items() if k is not None} == brute_groups([(i, t) for i, t, _ in TEXTS])
    assert got[None]["component_id"] is None


def test_op7(spark, folder):
    rows = sorted(queries.QUERIES["op7_sharding"](spark, folder).collect(), key=lambda r: (r["shard"], r["slot"]))
    sizes = {}
    for r in rows:
        text = {i: t for i, t, _ in TEXTS}[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["slot"] == sizes.setdefault(r["shard"], 0)
        sizes[r["shard"]] += 1
    assert [r["doc_id"] for r in rows[1:]] == sorted(i for i, _, _ in TEXTS if i is not None)


def test_op8_and_op9(spark, folder):
    from tokenizers import Tokenizer

    texts = sorted(((i, t or "") for i, t, _ in TEXTS), key=lambda r: (r[0] is not None, r[0], r[1]))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in texts:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.QUERIES["op8_token_files"](spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, r in table(queries.QUERIES["op9_token_counts"](spark, folder)).items():
        text = {i: t for i, t, _ in TEXTS}[k] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(own.encode(text, add_special_tokens=False).ids))
        assert r["over_limit"] == (r["n_tokens"] > 2048)


def test_op4_is_lossless(spark, folder):
    for k, r in table(queries.QUERIES["op4_piece_dropout"](spark, folder)).items():
        text = {i: t for i, t, _ in TEXTS}[k] or ""
        assert r["lossless"] and r["text_crc32"] == zlib.crc32(text.encode())


def test_missing_columns_arent_needed(spark, docs):
    from tessera.llm.parity_join import similar_groups

    assert similar_groups(docs.select("text", "doc_id")).count() == len(TEXTS)
    assert docs.filter(F.col("doc_id") == 15).count() == 2
