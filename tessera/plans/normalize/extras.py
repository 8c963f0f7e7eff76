"""Pages, legacy notebook exports and attributes from indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.operators.text import note_kind
from tessera.schema import OUTPUT_TYPES, conform

# Output types of legacy exports by file ending.
ENDING_TYPES = {"m4a": 1, "mp3": 1, "wav": 1, "md": 2, "mp4": 3, "csv": 7, "pdf": 8, "pptx": 8, "png": 9, "json": 10}


def pages(docs: DataFrame, owner: str, source: str = "perplexity") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, branches) of published pages (slug, doc variant, space?); pages by others than ``owner`` are machine talk.

    Each entry is a question and its answer. Pages without entries are left out.
    """
    space = F.col("space") if "space" in docs.columns else F.lit(None).cast("string")
    listed = docs.select("slug", space.alias("space"), F.try_variant_get("doc", "$.entries", "array<variant>").alias("entries")).filter(F.size("entries") > 0)
    first, last = F.col("entries")[0], F.element_at("entries", -1)
    get = lambda v, p: F.nullif(F.try_variant_get(v, f"$.{p}", "string"), F.lit(""))
    info = F.coalesce(F.get_json_object(get(first, "article_info"), "$.title"), get(first, "article_info.title"))
    page, started = F.concat(F.lit("page:"), F.col("slug")), X.to_ts(get(first, "entry_created_datetime"))
    heads = listed.select(
        page.alias("conversation_id"), F.lit(source).alias("source"), F.substring(F.coalesce(F.nullif(info, F.lit("")), get(first, "thread_title"), F.col("slug")), 1, 500).alias("title"),
        started.alias("created_at"), X.to_ts(F.coalesce(get(last, "entry_updated_datetime"), get(first, "entry_updated_datetime"))).alias("updated_at"), get(first, "display_model").alias("model"),
        F.lit("research").alias("mode"), F.col("space").alias("project"), F.col("space").alias("project_id"), F.concat(F.lit("https://www.perplexity.ai/page/"), "slug").alias("url"),
        (2 * F.size("entries")).cast("long").alias("message_count"), F.when(F.coalesce(get(first, "author_username"), F.lit(owner)) == owner, "human_ai").otherwise("ai_ai").alias("interaction_type"),
    )
    each = listed.select(page.alias("conversation_id"), "slug", F.posexplode("entries").alias("pos", "e"))
    entry = F.coalesce(get(F.col("e"), "uuid"), get(F.col("e"), "backend_uuid"), F.concat_ws("_", "slug", (2 * F.col("pos")).cast("string")))
    side = lambda ends, number, role, model, content: F.struct(F.lit(ends).alias("ends"), F.lit(number).alias("side"), F.lit(role).alias("role"), model.alias("model"), content.alias("content"))
    answer = X.answer_text(F.try_variant_get("e", "$.blocks", "array<variant>"), get(F.col("e"), "first_answer"))
    sides = F.array(side("_query", 1, "user", F.lit(None).cast("string"), get(F.col("e"), "query_str")), side("_answer", 2, "assistant", get(F.col("e"), "display_model"), answer))
    rows = each.select("conversation_id", "pos", entry.alias("entry"), X.to_ts(get(F.col("e"), "entry_created_datetime")).alias("created_at"), F.inline(sides))
    said = rows.select(
        F.concat("entry", "ends").alias("message_id"), "conversation_id", F.lit(source).alias("source"), (2 * F.col("pos") + F.col("side")).cast("long").alias("sequence"), "role", "model", "created_at",
        F.coalesce("content", F.lit("")).alias("content"), F.lit("text").alias("content_types"), X.word_count(F.coalesce("content", F.lit(""))).alias("word_count"),
    )
    messages = conform(said, "messages")
    ends = messages.groupBy("conversation_id").agg(F.min_by("message_id", "sequence").alias("root_message_id"), F.max_by("message_id", "sequence").alias("leaf_message_id"))
    branches = ends.join(heads.select("conversation_id", "created_at"), "conversation_id").select(
        F.concat("conversation_id", F.lit("_main")).alias("branch_id"), "conversation_id", F.lit(source).alias("source"), "root_message_id", "leaf_message_id", F.lit(True).alias("is_active"), "created_at"
    )
    return conform(heads, "conversations"), messages, conform(branches, "branches")


def asset_events(index: DataFrame, source: str = "perplexity") -> DataFrame:
    """An event for each asset of the index (doc variant) that has a slug, at the answer of its entry."""
    get = lambda p: F.try_variant_get("doc", f"$.{p}", "string")
    slug, entry = F.nullif(get("asset_slug"), F.lit("")), F.nullif(get("entry_uuid"), F.lit(""))
    flag = lambda p: F.coalesce(F.try_variant_get("doc", f"$.{p}", "boolean"), F.lit(False))
    name = F.concat(F.lit("asset:"), slug)
    events = index.filter(slug.isNotNull()).select(
        name.alias("event_id"), F.coalesce(entry, slug).alias("conversation_id"), F.coalesce(F.concat(entry, F.lit("_asst")), name).alias("message_id"), F.lit(source).alias("source"),
        F.lit("asset_generation").alias("event_type"), get("asset_type").alias("tool_name"), F.concat(F.lit("assets/files/"), slug).alias("file_path"),
        F.to_json(F.struct(get("caption").alias("caption"), get("preview_image_url").alias("preview_image_url"), flag("is_pinned").alias("is_pinned"), get("media_type").alias("media_type"), flag("_preserved_missing").alias("_preserved_missing")), {"ignoreNullFields": "false"}).alias("metadata_json"),
    )
    return conform(events, "tool_events")


def legacy_notebooks(listing: DataFrame, notes: DataFrame, source: str = "notebooklm") -> tuple[DataFrame, DataFrame]:
    """(outputs, notes) of a legacy export: files (conversation_id, name) by ending, notes (conversation_id, name, content) by kind."""
    ending = F.lower(F.element_at(F.split("name", r"\."), -1))
    types = F.create_map(*[F.lit(x) for pair in ENDING_TYPES.items() for x in pair])
    names = F.create_map(*[F.lit(x) for pair in OUTPUT_TYPES.items() for x in pair])
    number = F.try_element_at(types, ending)
    outputs = listing.filter(number.isNotNull()).select(
        F.concat_ws(":", "conversation_id", "name").alias("output_id"), "conversation_id", F.lit(source).alias("source"), number.alias("output_type"),
        F.element_at(names, number).alias("output_type_name"), F.col("name").alias("title"), F.array("name").alias("asset_path"),
    )
    kept = notes.withColumn("kind", note_kind(F.col("content"))).filter("kind is not null").select(
        F.concat_ws(":", "conversation_id", "name").alias("note_id"), "conversation_id", F.lit(source).alias("source"), F.col("name").alias("title"), "content", "kind"
    )
    return conform(outputs, "outputs"), conform(kept, "notes")


def with_index(conversations: DataFrame, index: DataFrame, honour_deleted: bool = True) -> DataFrame:
    """Titles and pins from the discovery index, times only where the body has none, and the deleted flag.

    ``index`` has (conversation_id, title, created_at, updated_at, is_pinned, deleted).
    """
    own = index.select("conversation_id", *[F.col(c).alias(f"__{c}") for c in ("title", "created_at", "updated_at", "is_pinned", "deleted")]).dropDuplicates(["conversation_id"])
    joined = conversations.join(own, "conversation_id", "left")
    gone = F.col("is_preserved_missing") | F.coalesce("__deleted", F.lit(False)) if honour_deleted else F.col("is_preserved_missing")
    return conform(
        joined.withColumn("title", F.coalesce("__title", "title"))
        .withColumn("is_pinned", F.coalesce("__is_pinned", "is_pinned"))
        .withColumn("created_at", F.coalesce("created_at", "__created_at"))
        .withColumn("updated_at", F.coalesce("updated_at", "__updated_at"))
        .withColumn("is_preserved_missing", gone),
        "conversations",
    )
