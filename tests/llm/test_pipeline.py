"""The pipeline against plain Python over the same rows, and stage by stage."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, piece_dropout
from tessera.llm.language_id import learn_profiles
from tessera.llm.samples import labelled_sample
from tessera.llm.toxicity import features_of, learn_toxicity
from tests.llm.test_queries_small import TEXTS, brute_groups, docs, folder  # noqa: F401


def plain_pipeline(spark, folder):
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(i, t) for i, t, _ in TEXTS]
    profiles = learn_profiles(documents)
    found = [profiles.predict(t) for _, t in rows]
    rows = [r for r, (lang, _, far) in zip(rows, found) if lang != "und" and far < corpus_pipeline.FARTHEST]
    model = learn_toxicity(labelled_sample(documents, labels, "toxic", F.lit(True), corpus_pipeline.TRAINING_ROWS))
    rows = [r for r, s in zip(rows, model.score(features_of([t for _, t in rows]))) if s < 0.5]
    groups = brute_groups(rows)
    rows = [(i, t) for i, t in rows if i is None or groups[i][1] == i]
    items = [decontamination.normalised(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items = [t for t in items if len(t) >= 13]
    clean = lambda t: all(decontamination.Pattern(x).distance(decontamination.normalised(t)) > decontamination.budget(len(x), 0.08) for x in items)
    rows = [(i, t) for i, t in rows if clean(t)]
    pieces = piece_dropout.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for i, t in rows:
        chunks = piece_dropout._chunks(t)
        keys = piece_dropout.occurrence_keys(i, t, len(chunks), 1).tolist()
        ids = b"".join(piece_dropout.encode_by_agenda(pieces, c, 0.1, key).tobytes() for c, key in zip(chunks, keys))
        out.append((i, len(ids) // 4, zlib.crc32(ids), zlib.crc32(t.encode()), True, np.frombuffer(ids, "<u4").tolist()))
    return sorted(out, key=repr)


def test_run_equals_plain_python(spark, folder):  # noqa: F811
    got = corpus_pipeline.run(spark, folder)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_pipeline(spark, folder)


def test_stages_keep_the_columns(spark, folder, docs):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_one_of_each_group_stays(spark, folder, docs):  # noqa: F811
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, folder).collect()}
    groups = brute_groups([(i, t) for i, t, _ in TEXTS])
    assert kept == {i for i, (_, c) in groups.items() if i == c} | {None}


def test_without_labels_nothing_is_toxic(spark, docs, folder, tmp_path):  # noqa: F811
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(name == "documents")).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path))
    assert kept.count() == docs.count() and kept.columns == docs.columns
