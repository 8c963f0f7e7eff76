"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns); component is the least node.

    Every round shuffles the edges twice and at least halves the paths; a node with very many
    neighbours is never gathered, only its minimum is. Rounds end when the edges stay as they are;
    after ``MAX_ROUNDS`` it fails rather than return part of an answer. Null ends, loops and
    repeated edges are ignored; no edges give no rows.
    """
    a, b = edges.columns[:2]
    now = stored(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        then, now = now, stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(then)
        before, state = state, _state(now)
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
