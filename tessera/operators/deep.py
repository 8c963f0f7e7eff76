"""Searches in nested JSON of unknown shape (G8): a frontier of variants that goes down a level at a time, within one expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 15

# What an address of a site's icon holds, and what addresses of the platform's own services hold.
ICON_PLACE = "gstatic.com/faviconV2"
OWN_PLACES = ("googleusercontent", "gstatic.com", "fonts.gstatic", "ssl.gstatic", "lh.google.com", "google.com/url")


_NODE = "array<struct<path: array<int>, v: variant>>"
_FOUND = "array<struct<path: array<int>, kind: string, url: string, text: string, depth: int, snippet: string, icon: string>>"


def _children(node: Column) -> Column:
    """The elements of a list or an object, each with its path of places."""
    below = lambda v, i: F.struct(F.concat(node.path, F.array(i)).alias("path"), v.alias("v"))
    listed = F.transform(F.try_variant_get(node.v, "$", "array<variant>"), below)
    named = F.transform(F.map_values(F.try_variant_get(node.v, "$", "map<string,variant>")), below)
    return F.coalesce(listed, named, F.array().cast(_NODE))


def _text_at(v: Column, k: int) -> Column:
    """The k-th element where that is a text."""
    x = F.try_variant_get(v, f"$[{k}]", "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, f"$[{k}]", "string"))


def _find(node: Column, least: int) -> Column:
    """What a value is, null if nothing that is looked for."""
    none = F.lit(None).cast("string")
    at = [_text_at(node.v, k) for k in range(4)]
    own = reduce(lambda a, b: a | b, [at[1].contains(p) for p in OWN_PLACES])
    source = at[0].contains(ICON_PLACE) & at[1].startswith("http") & ~own & at[2].isNotNull() & at[3].isNotNull()
    citation = (at[0].startswith("http://") | at[0].startswith("https://")) & at[1].isNotNull()
    long = (F.schema_of_variant(node.v) == "STRING") & (F.length(F.try_variant_get(node.v, "$", "string")) >= least)
    is_list = F.schema_of_variant(node.v).startswith("ARRAY")
    found = lambda kind, url, text, snippet=none, icon=none: F.struct(
        node.path.alias("path"), F.lit(kind).alias("kind"), url.alias("url"), text.alias("text"), F.size(node.path).alias("depth"), snippet.alias("snippet"), icon.alias("icon")
    )
    return (
        F.when(is_list & source, found("source", at[1], at[2], at[3], at[0])).when(is_list & citation, found("citation", at[0], at[1]))
        .when(long, found("text", none, F.try_variant_get(node.v, "$", "string")))
    )


def deep_finds(document: Column, least: int = 200) -> Column:
    """Search results ([icon, address, title, snippet] lists), citations ([address, title, ...] lists) and long texts of
    a variant, down to ``MAX_DEPTH`` levels, parents first and in the order of their places; none of a null one.

    Objects have their entries in the order of their names, as variants do. One document's values are held at once.
    """
    start = F.array(F.struct(F.array().cast("array<int>").alias("path"), document.alias("v"))).cast(_NODE)
    hits = lambda nodes: F.filter(F.transform(nodes, lambda n: _find(n, least)), lambda x: x.isNotNull())

    def down(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state.nodes, _children))
        return F.struct(below.alias("nodes"), F.concat(state.found, hits(below)).cast(_FOUND).alias("found"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_DEPTH)), F.struct(start.alias("nodes"), hits(start).cast(_FOUND).alias("found")), down, lambda state: F.array_sort(state.found))
    return F.when(document.isNotNull(), walked).otherwise(F.array().cast(_FOUND))


def deep_citations(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(key, url, title) of JSON texts, each address once for a document, where it stands first."""
    found = documents.select(key, F.posexplode(deep_finds(F.try_parse_json(document))).alias("pos", "x")).filter("x.kind = 'citation'")
    w = Window.partitionBy(key, "x.url").orderBy("pos")
    return found.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").select(key, F.col("x.url").alias("url"), F.col("x.text").alias("title"))


def long_texts(documents: DataFrame, key: str, document: str, answer: str | None = None, least: int = 2500) -> DataFrame:
    """(key, text) of long texts with a heading that the answer doesn't hold already."""
    columns = [key, *([answer] if answer else [])]
    found = documents.select(*columns, F.explode(deep_finds(F.try_parse_json(document), least)).alias("x")).filter("x.kind = 'text'")
    texts = found.select(*columns, F.col("x.text").alias("text")).filter(F.col("text").rlike(r"(?m)^#{1,3}\s+\S"))
    return (texts.filter(~F.coalesce(F.contains(answer, "text"), F.lit(False))) if answer else texts).select(key, "text").distinct()
