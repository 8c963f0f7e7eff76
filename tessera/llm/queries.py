"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, table
from tessera.llm.decontamination import contaminated
from tessera.llm.hard_negatives import hard_negatives, quantised
from tessera.llm.language_id import identify_languages, learn_profiles
from tessera.llm.near_vectors import near_vectors
from tessera.llm.parity_join import similar_groups
from tessera.llm.periodic_runs import periodic_runs, sharpest, with_planted_runs
from tessera.llm.piece_dropout import encode_decode
from tessera.llm.quality import learn_quality, score_quality
from tessera.llm.rule_cascade import quality_cascade
from tessera.llm.samples import labelled_sample, remainder
from tessera.llm.sharding import shard_by_bytes
from tessera.llm.token_counts import count_tokens
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.toxicity import learn_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "op7_sharding",
    """
    WITH RECURSIVE steps(i, c, k) AS (
        SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
        UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
    h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
    d AS (SELECT doc_id, CAST(length(hx) // 2 + 1 AS BIGINT) AS size,
            CAST(xor(list_reduce(list_prepend(4294967295::BIGINT,
                list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
          FROM h, crc_table),
    p AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start,
            CAST(sum(size) OVER () AS BIGINT) AS total FROM d),
    s AS (SELECT *, CAST((start * 16) // total AS INTEGER) AS shard FROM p)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
        CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot,
        CAST(NULL AS INTEGER) AS grown_shard
    FROM s""",
)
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 contiguous shards of near-equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in seekable files, then what the files hold."""
    path = fresh_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest, path)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text through a cache that starts empty."""
    docs = table(spark, sf_dir, "documents")
    counts = count_tokens(docs, fresh_path(spark, "token-cache"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, from profiles of the documents with another remainder than 2."""
    docs = table(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 4)
    profiles = learn_profiles(docs.filter(rest != 2))
    found = identify_languages(docs, profiles)
    return found.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score", "distance")


#: The classifiers learn from at most this many labelled documents.
TRAINING_ROWS = 20_000


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from labels of documents with a remainder other than 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = remainder(F.col("doc_id"), 5)
    model = learn_toxicity(labelled_sample(docs, labels, "toxic", rest != 0, TRAINING_ROWS))
    return score_toxicity(docs, model).select("doc_id", (rest == 0).alias("held_out"), "score", "predicted")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learnt from labels of documents with a remainder other than 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = remainder(F.col("doc_id"), 3)
    model = learn_quality(labelled_sample(docs, labels, "quality", rest != 1, TRAINING_ROWS))
    return score_quality(docs, model).select("doc_id", (rest == 1).alias("held_out"), "score", "predicted")


@query(
    "op6_parity_join",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    s AS (
        SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
            WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
        FROM d),
    c AS (SELECT md5(array_to_string(list_sort(g), chr(10))) AS k, min(doc_id) AS rep, any_value(g) AS g FROM s WHERE len(g) > 0 GROUP BY 1),
    t AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM c),
    p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS i
          FROM t AS a JOIN t AS b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2, 3, 4),
    e AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS v, a AS x FROM u UNION SELECT r.v, u.b FROM r JOIN u ON r.x = u.a),
    m AS (SELECT v, min(x) AS component_id FROM r GROUP BY v)
    SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles,
        CAST(CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE coalesce(m.component_id, c.rep) END AS BIGINT) AS component_id
    FROM s LEFT JOIN c ON len(s.g) > 0 AND c.k = md5(array_to_string(list_sort(s.g), chr(10))) LEFT JOIN m ON m.v = c.rep""",
)
def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingles are similar to 0.75 or more."""
    return similar_groups(table(spark, sf_dir, "documents"))


@query(
    "op1_near_vectors",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r AS (SELECT a AS v, a AS x FROM u UNION SELECT r.v, u.b FROM r JOIN u ON r.x = u.a),
    m AS (SELECT v, min(x) AS c FROM r GROUP BY v),
    n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
    SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m.c, e.vec_id) AS component_id,
        e.vec_id = coalesce(m.c, e.vec_id) AS kept
    FROM embeddings AS e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.v = e.vec_id""",
)
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings within labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in each whole text within their error budgets."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_piece_dropout")
def op4_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as pieces with merge-dropout, and back."""
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op11_rule_cascade",
    r"""
    WITH d AS (
        SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS li
        FROM documents),
    g AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM g) WHERE n > 1),
    reps AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM twice GROUP BY r),
    c AS (
        SELECT doc_id, t, w, li, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(li) - len(list_distinct(li)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
        FROM d LEFT JOIN reps USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (
        base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
        OR 5 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) > n_words
        OR length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g'))
        OR 5 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > n_words
        OR 2 * n_dup_lines > len(li)
        OR 10 * len(list_filter(li, lambda x: x[1] IN ('-', '*'))) > 9 * len(li)
        OR 10 * len(list_filter(li, lambda x: ends_with(x, '...'))) > 3 * len(li)) AS kept
    FROM b""",
)
def op11_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every whole text, ordered by rejections per cost on a sample."""
    return quality_cascade(table(spark, sf_dir, "documents"))


@query(
    "op12_periodic_runs",
    r"""
    WITH RECURSIVE steps(i, c, k) AS (
        SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
        UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
    x AS (SELECT doc_id, hex(encode(CAST(doc_id AS VARCHAR))) AS hx, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    h AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n,
            CAST(xor(list_reduce(list_prepend(4294967295::BIGINT,
                list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS h
          FROM x, crc_table),
    p AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
    d AS (SELECT row_number() OVER () AS r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
    v AS (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS x FROM d),
    e AS (SELECT a.r, a.i, b.i - a.i AS q FROM v AS a JOIN v AS b ON a.r = b.r AND a.x = b.x AND b.i > a.i JOIN d ON d.r = a.r AND 4 * (b.i - a.i) <= d.n),
    g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
    s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY r, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
    runs AS (SELECT r, start, CAST(length AS BIGINT) AS length, CAST(min(q) AS BIGINT) AS period FROM s GROUP BY r, start, length),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY (length * 1000000000000) // period DESC, start, period) = 1),
    listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt FROM runs GROUP BY r),
    dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT v.r, string_agg(v.x, ' ' ORDER BY v.i) AS txt FROM v ANTI JOIN dropped ON v.r = dropped.r AND v.i = dropped.i GROUP BY v.r)
    SELECT d.doc_id, CAST(coalesce(listed.n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, best.length, best.period,
        CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed.txt, '')) AS runs_sha256,
        sha256(coalesce(kept.txt, '')) AS collapsed_sha256
    FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of repeated word sequences in every whole text, and the texts with each run cut to its first period."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = sharpest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s
          FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
    n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank,
            s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
          FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors with an id divisible by 50, against all vectors."""
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), quantised(F.col("embedding")).alias("embedding")
    )
    return hard_negatives(rows, vec_id % 50 == 0)
