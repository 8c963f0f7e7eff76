"""Notebooks (N11) beyond their chat: lists by position, as the platform's calls give them.

Documents come as (id, doc) with ``doc`` a variant of named calls: metadata, guide, notes, audios.
What lies at another place or has another type is null or left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.plans.normalize.web import SPECS, _list, _text, conversations, messages
from tessera.schema import OUTPUT_TYPES, conform

SOURCE = "notebooklm"
#: Output types whose text is kept: posts, flashcards, tables, pictures.
WITH_CONTENT = (2, 4, 7, 9)
# What a brief's text begins with.
BRIEF_STARTS = ("Com base", "Based", "**", "#")


def _plain(v: Column, path: str) -> Column:
    """A text at a path; null where something else stands there."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def _each(docs: DataFrame, path: str) -> DataFrame:
    return docs.select(F.col("id").alias("conversation_id"), F.posexplode(_list(F.col("doc"), path)).alias("pos", "x"))


def guide_summary(doc: Column) -> Column:
    return _plain(doc, "$.guide[0][0][0]")


def notebook_messages(docs: DataFrame) -> DataFrame:
    """The guide's summary as a system message of number 0, then the chat; without a summary the chat begins with 0."""
    doc, spec = F.col("doc"), SPECS[SOURCE]
    summary = guide_summary(doc)
    chat = messages(docs, spec)
    bare = docs.filter(F.coalesce(summary, F.lit("")) == "").select(F.col("id").alias("conversation_id"), F.lit(1).alias("__bare"))
    chat = chat.join(bare, "conversation_id", "left").withColumn("sequence", F.col("sequence") - F.coalesce("__bare", F.lit(0)))
    chat = chat.withColumn("message_id", F.coalesce("message_id", F.concat_ws("_turn_", "conversation_id", F.col("sequence").cast("string"))))
    head = docs.select(
        F.concat("id", F.lit("_guide_summary")).alias("message_id"), F.col("id").alias("conversation_id"), F.lit(SOURCE).alias("source"), F.lit(0).alias("sequence"),
        F.lit("system").alias("role"), summary.alias("content"), F.lit("gemini").alias("model"), spec.inherit["of_time"](doc).alias("created_at"), X.word_count(summary).alias("word_count"),
    ).filter("coalesce(content, '') <> ''")
    return conform(head, "messages").unionByName(conform(chat, "messages"))


def notebook_heads(docs: DataFrame) -> DataFrame:
    """Conversations of notebooks: the title of the metadata before the listing's own, and all messages counted."""
    return conversations(docs, SPECS[SOURCE], notebook_messages(docs))


def guide_questions(docs: DataFrame) -> DataFrame:
    """The questions that the guide suggests, with their full prompts."""
    rows = _each(docs, "$.guide[0][1][0]").filter(_plain(F.col("x"), "$[0]").isNotNull() & (F.size(_list(F.col("x"), "$")) >= 2))
    return conform(
        rows.select(
            F.concat("conversation_id", F.lit("_q"), F.col("pos").cast("string")).alias("question_id"), "conversation_id", F.lit(SOURCE).alias("source"),
            _plain(F.col("x"), "$[0]").alias("question_text"), F.coalesce(_plain(F.col("x"), "$[1]"), F.lit("")).alias("full_prompt"), F.col("pos").cast("long").alias("order"),
        ),
        "guide_questions",
    )


def source_text(v: Column) -> Column:
    """The text of a source: the pieces of its chunks, joined."""
    pieces = F.flatten(F.transform(_list(v, "$[3][0]"), lambda chunk: F.transform(_list(chunk, "$[2][0]"), lambda piece: _plain(piece, "$[2][0]"))))
    return F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "")


def notebook_sources(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """Sources that the metadata lists and whose content (source_id, doc) is there; tokens are a quarter of the characters."""
    listed = _each(docs, "$.metadata[0][1]").select("conversation_id", _plain(F.col("x"), "$[0][0]").alias("doc_id"), F.coalesce(_plain(F.col("x"), "$[1]"), F.lit("")).alias("file_name"))
    texts = contents.select(F.col("source_id").alias("doc_id"), source_text(F.col("doc")).alias("content"))
    return conform(
        listed.filter("doc_id is not null").join(texts, "doc_id").select(
            "doc_id", F.col("conversation_id").alias("project_id"), F.lit(SOURCE).alias("source"), "file_name", "content", F.length("content").alias("content_size"),
            F.floor(F.length("content") / 4).alias("estimated_token_count"),
        ),
        "project_docs",
    )


def source_guides(docs: DataFrame, guides: DataFrame) -> DataFrame:
    """Summary, tags and questions of listed sources (source_id, doc); those with none of them are left out."""
    listed = _each(docs, "$.metadata[0][1]").select("conversation_id", _plain(F.col("x"), "$[0][0]").alias("source_id")).filter("source_id is not null")
    texts = lambda path: F.filter(F.transform(_list(F.col("doc"), path), lambda t: _plain(t, "$")), lambda t: t.isNotNull())
    packed = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    own = guides.select(
        "source_id", _plain(F.col("doc"), "$[0][0][1][0]").alias("summary"), packed(texts("$[0][0][2][0]")).alias("tags_json"), packed(texts("$[0][0][3][0]")).alias("questions_json")
    )
    kept = listed.join(own, "source_id").filter("coalesce(summary, tags_json, questions_json) is not null")
    return conform(kept.withColumn("source", F.lit(SOURCE)), "source_guides")


def notebook_notes(docs: DataFrame) -> DataFrame:
    """Notes with a text that is no reference to a mind map; briefs by how they begin."""
    rows = _each(docs, "$.notes[0]").select("conversation_id", _plain(F.col("x"), "$[0]").alias("note_id"), _plain(F.col("x"), "$[1][1]").alias("content"))
    reference = (F.length("content") == 36) & (F.length(F.regexp_replace("content", "[^-]", "")) == 4)
    brief = F.lit(False)
    for start in BRIEF_STARTS:
        brief = brief | F.col("content").startswith(start)
    kept = rows.filter(F.col("note_id").isNotNull() & (F.coalesce("content", F.lit("")) != "") & ~reference)
    return conform(kept.withColumn("source", F.lit(SOURCE)).withColumn("kind", F.when(brief, "brief").otherwise("note")), "notes")


def notebook_outputs(docs: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """Artifacts of known types, with the text of those that ``single`` (output_id, doc) holds, and the mind map."""
    names = F.create_map(*[F.lit(v) for pair in OUTPUT_TYPES.items() for v in pair])
    x = F.col("x")
    refs = F.filter(F.transform(_list(x, "$[3]"), lambda r: _plain(r, "$[0][0]")), lambda r: r.isNotNull())
    made = _each(docs, "$.audios[0]").select(
        "conversation_id", _plain(x, "$[0]").alias("output_id"), _plain(x, "$[1]").alias("title"), F.try_variant_get(x, "$[2]", "int").alias("output_type"),
        _plain(x, "$[4]").alias("status"), F.when(F.size(refs) > 0, F.to_json(refs)).alias("source_refs_json"),
    )
    made = made.withColumn("output_type_name", F.try_element_at(names, F.col("output_type"))).filter("output_id is not null and output_type_name is not null")
    if single is not None:
        text = F.coalesce(_plain(F.col("doc"), "$[0][7][0]"), F.to_json("doc"))
        made = made.join(single.select("output_id", text.alias("__text")), "output_id", "left").withColumn("content", F.when(F.col("output_type").isin(*WITH_CONTENT), F.col("__text")))
    doc = F.col("doc")
    tree = F.try_variant_get(doc, "$._mind_map_tree", "variant")
    maps = docs.filter(tree.isNotNull()).select(
        F.coalesce(_text(tree, "$.mind_map_uuid"), F.concat("id", F.lit("_mm"))).alias("output_id"), F.col("id").alias("conversation_id"), F.lit(10).alias("output_type"),
        F.lit(OUTPUT_TYPES[10]).alias("output_type_name"), F.to_json(F.coalesce(F.try_variant_get(tree, "$.tree", "variant"), F.try_variant_get(tree, "$.raw", "variant"))).alias("content"),
    )
    return conform(made.unionByName(maps, allowMissingColumns=True).withColumn("source", F.lit(SOURCE)), "outputs")
