"""Projects of the web platforms and what belongs to them (N19): metadata, documents, assets, tasks.

Projects come as (doc variant), one row each. A table says for each source which columns there are, where they stand, and
what stands for a missing value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.schema import conform

Get = Callable[[Column], Column]


def _first(v: Column, paths: tuple[str, ...], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}", kind) for p in paths])


def text(*paths: str) -> Get:
    """The first that isn't empty, else an empty text."""
    return lambda v: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")) for p in paths], F.lit(""))


def flag(*paths: str, missing: bool = False) -> Get:
    return lambda v: F.coalesce(_first(v, paths, "boolean"), F.lit(missing))


def number(*paths: str) -> Get:
    return lambda v: F.coalesce(_first(v, paths, "double").cast("long"), F.lit(0).cast("long"))


def moment(*paths: str) -> Get:
    """A time; null where it is missing or zero."""
    return lambda v: X.to_ts(F.nullif(_first(v, paths, "string"), F.lit("0")))


def listed(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def key(*paths: str) -> Get:
    return lambda v: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")) for p in paths])


def _detailed(get: Callable[..., Get], name: str) -> Get:
    """From the project's details where there are some, else from the project."""
    there = lambda v: F.try_variant_get(v, "$._detail", "map<string,variant>")
    return lambda v: F.when(F.size(there(v)) > 0, get(f"_detail.{name}")(v)).otherwise(get(name)(v))


def _csv(path: str) -> Get:
    return lambda v: F.array_join(F.transform(listed(v, path), lambda x: F.try_variant_get(x, "$", "string")), ",")


#: Columns of projects, by source; none has a column for its source, which comes from the name.
METADATA: dict[str, dict[str, Get]] = {
    "claude_ai": {
        "project_id": key("uuid"), "name": text("name"), "description": text("description"), "prompt_template": text("prompt_template"), "created_at": moment("created_at"),
        "updated_at": moment("updated_at"), "archived_at": moment("archived_at"), "is_private": flag("is_private", missing=True), "is_starred": flag("is_starred"),
        "is_starter_project": flag("is_starter_project"), "docs_count": number("docs_count"), "files_count": number("files_count"),
    },
    "qwen": {
        "project_id": key("id"), "name": text("name"), "icon": text("icon"), "custom_instruction": text("custom_instruction"), "memory_span": text("memory_span"),
        "created_at": moment("created_at"), "updated_at": moment("updated_at"), "files_count": lambda v: F.size(listed(v, "_files")).cast("long"),
    },
    "grok": {
        "project_id": key("workspaceId"), "name": text("name"), "icon": text("icon"), "custom_instruction": _detailed(text, "customPersonality"), "preferred_model": _detailed(text, "preferredModel"),
        "is_public": _detailed(flag, "isPublic"), "access_level": _detailed(text, "accessLevel"), "view_count": _detailed(number, "viewCount"),
        "conversations_created_count": _detailed(number, "conversationsCreatedCount"), "clone_count": _detailed(number, "cloneCount"), "is_preserved_missing": flag("_preserved_missing"),
        "created_at": moment("createTime"), "updated_at": moment("lastUseTime"),
    },
    "kimi": {
        "project_id": key("id"), "name": text("name"), "icon": lambda v: F.lit(""), "custom_instruction": text("description"), "is_pinned": flag("pinned"), "is_installed": flag("installed"),
        "categories": _csv("categories"), "source_type": text("source"), "created_at": lambda v: F.lit(None).cast("timestamp"), "updated_at": lambda v: F.lit(None).cast("timestamp"),
    },
}

#: Columns of assets, by source.
ASSETS: dict[str, dict[str, Get]] = {
    "grok": {
        "asset_id": key("assetId"), "mime_type": text("mimeType"), "name": text("name"), "size_bytes": number("sizeBytes"), "key": text("key"), "file_source": text("fileSource"),
        "is_model_generated": flag("isModelGenerated"), "is_root_asset_created_by_model": flag("isRootAssetCreatedByModel"), "is_latest": flag("isLatest"), "is_deleted": flag("isDeleted"),
        "shared_with_team": flag("sharedWithTeam"), "is_public": flag("isPublic"), "root_asset_id": text("rootAssetId"), "inline_status": text("inlineStatus"), "summary": text("summary"),
        "preview_image_key": text("previewImageKey"), "is_preserved_missing": flag("_preserved_missing"), "created_at": moment("createTime"), "last_use_time": moment("lastUseTime"),
    },
    "kimi": {
        "chat_id": text("chat_id"), "name": text("name"), "mime_type": text("mime"), "size_bytes": number("size"), "url": text("url"),
        "asset_path": lambda v: F.coalesce(F.concat(F.lit("merged/Kimi/"), key("relpath")(v)), F.lit("")),
    },
}

#: Where documents of projects are listed, and their columns.
DOCS: dict[str, tuple[str, str, dict[str, Get]]] = {
    "claude_ai": ("uuid", "docs", {
        "doc_id": key("uuid"), "file_name": text("file_name"), "content": text("content"), "created_at": moment("created_at"),
        "estimated_token_count": lambda d: F.try_variant_get(d, "$.estimated_token_count", "string").try_cast("double").cast("long"),
    }),
    "qwen": ("id", "_files", {"doc_id": key("file_id", "id"), "file_name": text("file_name", "name"), "content": lambda d: F.lit(""), "content_size": number("size"), "created_at": moment("created_at")}),
}


def project_metadata(projects: DataFrame, source: str) -> DataFrame:
    """A row for each project with the source's own columns."""
    return projects.select(*[get(F.col("doc")).alias(name) for name, get in METADATA[source].items()], F.lit(source).alias("source"))


def project_docs(projects: DataFrame, source: str) -> DataFrame:
    """Documents of projects, with their content where the platform has it inline; projects and documents without an id have none."""
    owner, at, columns = DOCS[source]
    each = projects.select(key(owner)(F.col("doc")).alias("project_id"), F.explode(listed(F.col("doc"), at)).alias("d"))
    rows = each.select("project_id", F.lit(source).alias("source"), *[get(F.col("d")).alias(name) for name, get in columns.items()])
    if "content_size" not in columns:
        rows = rows.withColumn("content_size", F.length("content").cast("long"))
    return conform(rows.filter("project_id is not null and doc_id is not null"), "project_docs")


def assets(index: DataFrame, source: str, files: DataFrame | None = None) -> DataFrame:
    """A row for each asset of an index (doc variant; for kimi with its id as asset_id).

    ``files`` (asset_id, path) says where the assets lie whose index doesn't; others have an empty path.
    """
    own = [F.col("asset_id")] if "asset_id" in index.columns else []
    rows = index.select(*own, *[get(F.col("doc")).alias(name) for name, get in ASSETS[source].items()])
    if "asset_path" in rows.columns:
        return rows
    if files is None:
        return rows.withColumn("asset_path", F.lit(""))
    known = files.groupBy("asset_id").agg(F.min("path").alias("asset_path"))
    return rows.join(known, "asset_id", "left").withColumn("asset_path", F.coalesce("asset_path", F.lit("")))


def scheduled_tasks(docs: DataFrame) -> DataFrame:
    """(status, task variant) of the active and the inactive tasks of a listing (doc variant)."""
    def of(status: str) -> Column:
        return F.transform(listed(F.col("doc"), status), lambda t: F.struct(F.lit(status).alias("status"), t.alias("task")))

    return docs.select(F.inline(F.concat(of("active"), of("inactive"))))
