"""Token counts through a cache that is keyed by content digest and tokenizer version."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, give_back, stored
from tessera.llm.tokenizing import cached_counter, drops_white_space, version_digest

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
_BATCH_BYTES = 1 << 22


def content_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one blank.

    Only for tokenizers that drop white space or squeeze it themselves, so that equal digests have
    equal counts. Null counts as empty.
    """
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")
    return F.unhex(F.sha2(squeezed.cast("binary"), 256))


def plain_digest(text: Column) -> Column:
    """SHA-256 of the text as it is; right for any tokenizer. Null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_cache(docs: DataFrame, cache_path: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version; no rows if nothing is stored yet."""
    spark = docs.sparkSession
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    # Two writers may have stored the same digest; the counts are equal then.
    return cache.filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=None,
) -> DataFrame:
    """Token counts of every whole text; what the cache at ``cache_path`` lacks is encoded and appended.

    Digests are joined to the cache; of the texts behind each missing digest one is encoded, the one
    of the smallest id; where that id has the text several times, one of its rows. A group of copies, however large,
    meets as digests only (they are pre-aggregated before the shuffle), and its text is encoded and stored once. ``digest`` makes the digest of a text;
    unless given it passes over white space where the tokenizer does.

    Returns doc_id, n_bytes, n_tokens, one row for each input row.

    Defined cases: a null or empty text has 0 bytes and the count of an empty text; repeated rows
    and rows with null ids are counted each; an empty table gives no rows; other columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    version = version_digest(tokenizer_path)
    digest = digest or (content_digest if drops_white_space(tokenizer_path) else plain_digest)
    keyed = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
            digest(text).alias("digest"),
        ),
        "text-digests",
    )
    of_id = keyed.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n"))  # a null id comes last
    missing = stored(
        of_id.groupBy("digest")
        .agg(first.alias("o"))
        .select("digest", F.col("o.doc_id").alias("owner"), F.col("o.n").alias("n"))
        .join(read_cache(docs, cache_path, version), "digest", "left_anti"),
        "missing-digests",
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).withColumn("own", digest(F.col("text")))
    owned = texts.join(
        missing, (texts["doc_id"].eqNullSafe(missing["owner"])) & (texts["own"] == missing["digest"]), "inner"
    ).select("digest", F.coalesce("text", F.lit("")).alias("text"), "n")
    # Only ids that have one text several times need another shuffle, which starts with one text a task and digest.
    if not missing.filter("n > 1").isEmpty():
        again = owned.filter("n > 1").groupBy("digest").agg(F.first("text").alias("text"))
        owned = owned.filter("n = 1").select("digest", "text").unionByName(again)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = cached_counter(tokenizer_path)

        def flush(digests: list[bytes], texts: list[str]) -> pa.RecordBatch:
            counts = counter.count(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([version] * len(counts)), pa.array(counts, pa.int64())],
                names=["digest", "version", "n_tokens"],
            )

        for batch in batches:
            digests, texts, size = [], [], 0
            for d, t in zip(batch.column(0), batch.column(1)):
                digests.append(d.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= _BATCH_BYTES:
                    yield flush(digests, texts)
                    digests, texts, size = [], [], 0
            if digests:
                yield flush(digests, texts)
        give_back()

    owned.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    discard(missing)
    return keyed.join(read_cache(docs, cache_path, version), "digest", "left").select("doc_id", "n_bytes", "n_tokens")
