"""One JSON map of all documents, read by as many tasks as its bytes need.

The file is scanned in pieces that end with a closing brace, each split of it by a task of its own. What a piece does to
quotes and brackets is counted without knowing where it stands; sums over the pieces of a split, and over the
splits of a file (one row each), tell whether a piece begins within a string and how deep. Cuts where a document closes
give segments, which are put together again and parsed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents lie in a map within the root: their entries are two brackets deep.
DEPTH = 2
#: A key that stands for what lies before a segment; its characters can't stand in JSON but as an escape.
_BEFORE = "\x01\x02"
_ESCAPED = r'"\u0001\u0002"'


def _counted(pieces: DataFrame) -> DataFrame:
    """Quotes of each piece, and for a start outside or within a string: brackets' sum, and the least sum on the way."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # a quote after a backslash ends no string

    def brackets(text: Column, closed: Column) -> Column:
        outside = F.regexp_replace(F.regexp_replace(text, r'"[^"]*("|$)', ""), r"[^\[\]{}]", "")
        return F.concat(outside, F.when(closed & F.col("ends"), "}").otherwise(""))

    def total(b: Column) -> Column:
        return (F.length(b) - 2 * F.length(F.regexp_replace(b, r"[\[{]", ""))).cast("long")

    def least(b: Column) -> Column:
        walk = F.aggregate(
            F.split(b, "(?!^)"),
            F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("m")),
            lambda s, c: F.struct((s.d + total(c)).alias("d"), F.least(s.m, s.d + total(c)).alias("m")),
            lambda s: s.m,
        )
        return F.when(b.contains("]"), walk).otherwise(F.least(F.lit(0).cast("long"), total(b)))

    out = pieces.withColumn("plain", plain).withColumn("quotes", (F.length("plain") - F.length(F.replace("plain", F.lit('"')))).cast("long"))
    even = F.col("quotes") % 2 == 0
    out = out.withColumn("b0", brackets(F.col("plain"), even)).withColumn("b1", brackets(F.regexp_replace("plain", r'^[^"]*("|$)', ""), ~even))
    sums = {"sum0": total(F.col("b0")), "sum1": total(F.col("b1")), "least0": least(F.col("b0")), "least1": least(F.col("b1")), "closes0": even & F.col("ends"), "closes1": ~even & F.col("ends")}
    return out.withColumns(sums).drop("plain", "b0", "b1")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, depth before, least depth, depth after, and at which place the map or list around it was opened)."""
    whole_name, in_split, before = ["path", "split"], Window.partitionBy("path", "split").orderBy("at"), (Window.unboundedPreceding, -1)
    splits_before = Window.partitionBy("path").orderBy("split").rowsBetween(*before)
    scanned = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
    )
    # The last piece has no brace where the file doesn't end with one.
    ends = scanned.groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max(F.struct("split", "at")).alias("last"))
    here = F.struct("split", "at")
    pieces = scanned.join(ends, "path").withColumn("ends", (here != F.col("last")) | (F.col("bytes") == F.col("size"))).drop("bytes", "size")
    pieces = _counted(pieces).withColumn("within", F.coalesce(F.sum("quotes").over(in_split.rowsBetween(*before)), F.lit(0)) % 2)

    # Once for splits that begin outside a string, once for those that begin within one.
    of = lambda name, start: F.when((F.col("within") + start) % 2 == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    splits = pieces.groupBy(*whole_name).agg(F.sum("quotes").alias("q"), F.sum(of("sum", 0)).alias("s0"), F.sum(of("sum", 1)).alias("s1"))
    splits = splits.withColumn("start", F.coalesce(F.sum("q").over(splits_before), F.lit(0)) % 2)
    splits = splits.withColumn("deep", F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("s0")).otherwise(F.col("s1"))).over(splits_before), F.lit(0)))
    placed = pieces.join(splits.select(*whole_name, "start", "deep"), whole_name)
    placed = placed.select("path", "split", "at", "value", "ends", "last", "deep", *[of(n, F.col("start")).alias(n) for n in ("sum", "least", "closes")])
    depth = F.col("deep") + F.coalesce(F.sum("sum").over(in_split.rowsBetween(*before)), F.lit(0))
    placed = placed.withColumn("depth", depth).withColumn("after", F.col("depth") + F.col("sum")).withColumn("lowest", F.col("depth") + F.col("least"))

    # The last cut, and the last piece that leaves or enters the second bracket, before each piece.
    cut = F.when(F.col("closes") & (F.col("after") <= DEPTH), here)
    turn = F.when((F.col("depth") < DEPTH) | (F.col("lowest") < DEPTH), here)
    marked = placed.withColumn("cut", cut).withColumn("turn", turn)
    carried = marked.groupBy(*whole_name).agg(F.max("cut").alias("c"), F.max("turn").alias("t"))
    carried = carried.select(*whole_name, *[F.last(x, ignorenulls=True).over(splits_before).alias(y) for x, y in (("c", "cut_before"), ("t", "turn_before"))])
    known = marked.join(carried, whole_name).withColumns(
        {n: F.coalesce(F.last(x, ignorenulls=True).over(in_split.rowsBetween(*before)), F.col(n)) for x, n in (("cut", "cut_before"), ("turn", "turn_before"))}
    )
    each = F.sort_array(F.collect_list(F.struct("split", "at", F.concat("value", F.when(F.col("ends"), "}").otherwise("")).alias("v"))))
    return known.groupBy("path", "cut_before").agg(
        F.array_join(F.transform(each, lambda p: p.v), "").alias("text"), F.min_by("depth", here).alias("depth"), F.max_by("after", here).alias("after"),
        F.min("lowest").alias("lowest"), F.min_by("turn_before", here).alias("around"), F.max("turn").alias("turn"), (F.max(here) == F.max("last")).alias("is_last"),
    )


def json_map(spark: SparkSession, path: str, field: str = "conversations") -> DataFrame:
    """A snapshot that holds all documents in one map, as (id, doc).

    A file of any size is read by many tasks; only a single document (and its variant) has a size limit. An id that
    stands twice gives two rows.

    Defined cases: blank files, and files whose field is missing or null, have no documents. Errors are: a file that is
    no JSON object or goes on after it, a field that is no map, a document that doesn't parse or is beyond the limit.
    Other fields are passed over, so what is wrong within the objects of their maps and lists isn't seen.
    """
    segments = _segments(spark, path)
    text, depth, after = F.col("text"), F.col("depth"), F.col("after")
    is_plain = (depth == DEPTH) & (F.col("lowest") >= DEPTH) & ~F.col("is_last")

    # Segments that leave or enter a map: with what is missing before and after them they are whole objects.
    opened = F.when(depth == 0, "").when(depth == 1, F.lit(f"{{{_ESCAPED}:0"))
    starts = {"map": F.coalesce(opened, F.lit(f"{{{_ESCAPED}:{{{_ESCAPED}:0")), "list": F.when(depth == DEPTH, F.lit(f"{{{_ESCAPED}:[0"))}
    stops = {"map": F.when(after == 0, "").when(after == 1, "}").otherwise("}}"), "list": F.when(after == DEPTH, "]}")}
    tried = [(stop == "map", F.from_json(F.concat(starts[start], text, stops[stop]), "map<string,variant>", {"mode": "PERMISSIVE"})) for start in starts for stop in stops]
    got = F.coalesce(*[F.when(m.isNotNull(), F.struct(F.lit(in_map).alias("in_map"), m.alias("m"))) for in_map, m in tried])
    blank = F.trim(F.regexp_replace("text", r"\s", "")) == ""
    first = F.col("cut_before").isNull()
    wrong = (
        F.when(F.col("is_last") & (after != 0) | (F.col("lowest") < 0), "brackets that don't match").when((depth == 0) & ~first, "something after the object")
        .when(F.col("got").isNull(), "no object")
    )
    turns = segments.filter(~is_plain & ~blank).withColumn("got", got).withColumn("wrong", wrong)
    keys = F.map_keys("got.m")
    opens = (after == DEPTH) & F.col("got.in_map") & (F.element_at(keys, -1) == field)
    fields = turns.filter(opens & F.col("wrong").isNull()).select("path", F.col("turn").alias("around"), F.lit(True).alias("in_field"))

    # A file's whole rest within the map has one place around it, so the few places are sent to the many segments.
    plain = segments.filter(is_plain).join(fields, ["path", "around"], "left_semi")
    body = F.regexp_extract("text", r"(?s)^\s*,(.*)$", 1)
    parsed = F.from_json(F.concat(F.lit("{"), F.when(body != "", body).otherwise("?"), F.lit("}")), "map<string,variant>", {"mode": "FAILFAST"})
    inner = plain.select(F.explode(parsed).alias("id", "doc"))

    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    entry = turns.join(fields, ["path", "around"], "left").select("path", "in_field", F.explode("got.m").alias("k", "v"))
    of_field = entry.filter((F.col("k") == field) | (F.col("k") == _BEFORE) & F.coalesce("in_field", F.lit(False)))
    of_field = of_field.filter(~F.is_variant_null("v")).withColumn("m", as_map(F.col("v")))
    outer = of_field.filter("m is not null").select(F.explode("m").alias("id", "doc")).filter(F.col("id") != _BEFORE)

    # Errors are rows that can't be made.
    faults = turns.filter("wrong is not null").select("path", "wrong").unionByName(of_field.filter("m is null").select("path", F.lit("a field that is no map").alias("wrong")))
    failed = faults.select(F.raise_error(F.concat(F.lit("MALFORMED JSON: "), "wrong", F.lit(" in "), "path")).cast("string").alias("id"), F.lit(None).cast("variant").alias("doc"))
    inner = inner.unionByName(failed)
    return inner.unionByName(outer).repartition("id")
