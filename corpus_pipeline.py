"""A training-data pipeline over documents: five stages, each written and read again as Parquet.

What holds for all stages: rows with a null id, and repeated rows, are documents like others; a very long text is worked on as a
whole, in memory that follows its length (its bytes some ten to sixty times over within one task); an empty table gives no rows; other columns
pass (all but the last stage return the columns that they got), whatever their names, as what stages add has names of its own.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, table
from tessera.llm.decontamination import with_matches
from tessera.llm.language_id import UNDETERMINED, learn_profiles, predict_language
from tessera.llm.parity_join import similar_groups
from tessera.llm.piece_dropout import encode_decode
from tessera.llm.samples import labelled_sample
from tessera.llm.toxicity import learn_toxicity, toxicity_score

#: A text that shares next to nothing with any language's profile is rejected; prose lies far below.
FARTHEST = 0.95
TRAINING_ROWS = 20_000

#: Rows that go to Python at once. Stages share worker processes, so what each holds adds up.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

# Columns that stages add get names that no table is likely to have, and go again within the stage.
_TMP = "__tessera_stage"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters or unlike all profiles go.

    The profiles come from about 3,000 documents a language, by a hash of the id, of the corpus of ``sf_dir``. Null and empty
    texts have no letters and go.
    """
    profiles = learn_profiles(table(spark, sf_dir, "documents"))
    found = docs.withColumn(_TMP, predict_language(profiles)(F.col("text")))
    keep = (F.col(_TMP)["lang_pred"] != UNDETERMINED) & (F.col(_TMP)["distance"] < FARTHEST)
    return found.filter(keep).drop(_TMP)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from a bounded sample of all labels.

    Null and empty texts have no features: they stay unless most of the labelled rows are toxic. Without labels all stay.
    """
    sample = labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", F.lit(True), TRAINING_ROWS)
    model = learn_toxicity(sample)
    if not len(model.chosen) and not model.intercept:  # nothing was labelled
        return docs
    score = toxicity_score(model)
    return docs.withColumn(_TMP, score(F.col("text"))).filter(F.col(_TMP) < 0.5).drop(_TMP)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id.

    Rows with equal ids are one document and stay or go together; rows without an id stay.
    """
    groups = similar_groups(docs)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(_TMP)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[_TMP], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget. Null and empty texts hold none and stay; so do all without a benchmark."""
    return with_matches(docs, table(spark, sf_dir, "benchmark"), _TMP).filter(F.size(_TMP) == 0).drop(_TMP)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids that each remaining text encodes to with merge-dropout, and that they decode to it. Null and empty texts have no ids; a null id is a key like others."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, max_chunks=50_000)


def _in_small_batches(stage):
    """The stage with the session's Arrow batches at ``BATCH_ROWS``: its plan runs when the result is written. ``run`` sets them back."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language ID", _in_small_batches(language)),
    ("toxicity", _in_small_batches(toxicity)),
    ("n-gram Jaccard join", _in_small_batches(near_duplicates)),
    ("benchmark decontamination", _in_small_batches(decontamination)),
    ("SentencePiece encoding and decoding", _in_small_batches(encoding)),
]

#: SQL cannot express the trained stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what its predecessor wrote to the shared folder."""
    docs, batch_rows = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    try:
        for k, (_, stage) in enumerate(STAGES):
            path = fresh_path(spark, f"pipeline-{k}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, batch_rows)
    return docs
