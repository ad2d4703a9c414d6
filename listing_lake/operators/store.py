"""The content table: merge, identity reports, edits and purge. `snapshots` keeps it in files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import urls
from listing_lake.functions.text import present, strip
from listing_lake.session import materialize

# --- fixed values: must equal the stored data's rules -------------------------------------------
PRODUCT_FIELDS = (
    "entityType", "shop", "saleStatus", "preorderEndAt", "releaseWindowText", "manufacturer", "sizeText",
    "price", "currency", "imageUrl", "detailImageUrls", "productCheckedAt", "detailCheckedAt",
)
STATUSES = ("NEW", "KEEP", "HOLD", "IGNORE")
# ------------------------------------------------------------------------------------------------

CONTENT = {
    "content_id": "string", "storage_category": "string", "doc_id": "string", "url": "string",
    "title": "string", "titleKo": "string", "summary": "string", "summaryKo": "string",
    "sourceLanguage": "string", "translatedAt": "timestamp", "source": "string", "sourceType": "string",
    "sourceUrl": "string", "region": "string", "category": "string", "contentAngle": "string",
    "sourceTier": "string", "status": "string", "note": "string", "postedAt": "timestamp",
    "publishedAt": "string", "createdAt": "timestamp", "collectedAt": "timestamp", "entityType": "string",
    "shop": "string", "saleStatus": "string", "preorderEndAt": "string", "releaseWindowText": "string",
    "manufacturer": "string", "sizeText": "string", "price": "bigint", "currency": "string",
    "imageUrl": "string", "detailImageUrls": "array<string>", "productCheckedAt": "timestamp",
    "detailCheckedAt": "timestamp",
}
CONTENT_DDL = ", ".join(f"{name} {kind}" for name, kind in CONTENT.items())


def conform(df: DataFrame) -> DataFrame:
    """The table with exactly the content columns; a missing one is null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in CONTENT.items()
    ])


def stored_gallery(gallery: Column, main: Column) -> Column:
    """Plain distinct links without the main photo. Null stays null, empty stays empty."""
    clean = F.filter(F.transform(gallery, urls.http_url), lambda u: u.isNotNull())
    return F.array_remove(F.array_distinct(clean), F.coalesce(main, F.lit("")))


def prepared(candidates: DataFrame) -> DataFrame:
    """Candidates with clean photo links, `url_norm` (null for a link that no document can have) and `_upd`: may the row update one?"""
    image = urls.http_url(F.col("imageUrl")) if "imageUrl" in candidates.columns else F.lit(None).cast("string")
    rows = candidates.withColumn("imageUrl", image)
    if "detailImageUrls" in candidates.columns:
        rows = rows.withColumn("detailImageUrls", stored_gallery(F.col("detailImageUrls"), F.col("imageUrl")))
    # A row that carries any product field may update an existing document.
    has_update = F.lit(False)
    for f in PRODUCT_FIELDS:
        if f in rows.columns:
            has_update = has_update | F.col(f).isNotNull()
    return rows.withColumn("url_norm", urls.normalize_url(F.col("url"))).withColumn("_upd", has_update)


def stage(candidates: DataFrame, seq: list[str]) -> DataFrame:
    """One row per URL: the first row's own values, and every product field's last non-null value.

    `seq` columns give the order of arrival. Copies of a URL collapse before the shuffle.
    """
    rows = prepared(candidates).filter(F.col("url_norm").isNotNull())
    order = F.struct(*seq)
    have = set(rows.columns)
    base = [c for c in CONTENT if c in have and c not in PRODUCT_FIELDS and c != "url"]
    carried = [f for f in PRODUCT_FIELDS if f in have]
    latest = [
        F.max_by(F.when(F.col(f).isNotNull(), F.struct(F.col(f).alias("v"))), F.when(F.col(f).isNotNull(), order)).alias(f"_{f}")
        for f in carried
    ]
    staged = rows.groupBy("url_norm").agg(
        F.min_by(F.struct(*base, F.col("_upd")), order).alias("_base"),
        *latest,
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("_upd").alias("n_update_rows"),
    )
    return staged.select(
        "url_norm", F.col("_base").dropFields("_upd").alias("base"), F.col("_base._upd").alias("first_updates"),
        F.struct(*[F.col(f"_{f}.v").alias(f) for f in carried]).alias("product"),
        "n_rows", "n_update_rows",
    )


def canonical_documents(content: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(url_norm, content_id): the document every writer picks for a URL.

    The one whose id is the URL's own hash, else the smallest id. `only` narrows to the URLs at hand.
    """
    index = content.select("content_id", "doc_id", urls.normalize_url(F.col("url")).alias("url_norm"))
    index = index.filter(F.col("url_norm").isNotNull())
    if only is not None:
        index = index.join(only.select("url_norm"), "url_norm", "left_semi")
    return pick_canonical(index)


def pick_canonical(index: DataFrame) -> DataFrame:
    """The same choice over (content_id, doc_id, url_norm), where the URL is stored."""
    rank = F.struct((F.col("doc_id") != urls.doc_id(F.col("url_norm"))).alias("other"), F.col("doc_id"), F.col("content_id"))
    return index.groupBy("url_norm").agg(F.min(rank).alias("_r")).select("url_norm", F.col("_r.content_id").alias("content_id"))


def outcome(staged: DataFrame, targets: DataFrame) -> DataFrame:
    """Staged rows with their target document and the counters of the run."""
    found = F.col("content_id").isNotNull()
    return staged.join(targets, "url_norm", "left").select(
        "*",
        F.when(found, 0).otherwise(1).alias("inserted"),
        F.when(found, F.col("n_rows")).otherwise(F.col("n_rows") - 1).alias("existing"),
        F.when(found, F.col("n_update_rows"))
        .otherwise(F.col("n_update_rows") - F.when(F.col("first_updates"), 1).otherwise(0)).alias("updated"),
    )


def merge_content(
    content: DataFrame, candidates: DataFrame, now: datetime | Column, seq: list[str],
) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, per-URL outcome) of merging candidates into the content table.

    Existing documents change in their product fields only, by non-null values. The content table is never
    shuffled at full width: only ids and URLs are, and the changed documents join back by id.
    """
    now = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    # Both are read several times below: written once, so neither the candidates nor the URL index is computed again.
    staged = materialize(stage(candidates, seq), "staged")
    result = materialize(outcome(staged, canonical_documents(content, staged)), "outcome")
    product_names = [f.name for f in result.schema["product"].dataType.fields]

    changes = result.filter(F.col("content_id").isNotNull()).select("content_id", F.col("product").alias("_p"))
    updated = conform(content).join(changes, "content_id", "left").withColumns(
        {name: F.coalesce(F.col(f"_p.{name}"), F.col(name)) for name in product_names}
    )
    return conform(updated).unionByName(conform(inserted_rows(result, now))), result


def inserted_rows(result: DataFrame, now: Column) -> DataFrame:
    """The documents that an outcome adds to the content table."""
    product_names = [f.name for f in result.schema["product"].dataType.fields]
    base_names = [f.name for f in result.schema["base"].dataType.fields]
    fresh = result.filter(F.col("content_id").isNull())
    category = F.col("base.category") if "category" in base_names else F.lit(None).cast("string")
    storage = F.coalesce(F.when(present(category), category), F.lit("UNKNOWN"))
    doc = urls.doc_id(F.col("url_norm"))
    return fresh.select(
        *[F.col(f"base.{c}").alias(c) for c in base_names
          if c not in ("content_id", "storage_category", "doc_id", "status", "createdAt", "collectedAt")],
        *[F.col(f"product.{c}").alias(c) for c in product_names],
        F.col("url_norm").alias("url"), doc.alias("doc_id"), storage.alias("storage_category"),
        urls.content_id(storage, doc).alias("content_id"), F.lit("NEW").alias("status"),
        now.alias("createdAt"), now.alias("collectedAt"),
    )


# --- reports ------------------------------------------------------------------------------------
def duplicate_urls(content: DataFrame) -> DataFrame:
    """(url, document, status, n): the documents that share a normalised URL, one row each.

    One row per document, because a URL may have any number of copies.
    """
    index = content.select("doc_id", "status", urls.normalize_url(F.col("url")).alias("url")).filter("url is not null")
    many = index.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return index.join(many, "url")


def invalid_urls(content: DataFrame) -> DataFrame:
    return content.filter(urls.normalize_url(F.coalesce(F.col("url"), F.lit(""))).isNull()).select("doc_id", "url")


# --- edits, purge -------------------------------------------------------------------------------
def latest_edits(edits: DataFrame, tie: str | None = None) -> DataFrame:
    """One row per document with the last valid status, publish time and note.

    `edits` has (content_id, field, value, ts); `tie` orders edits of the same instant.
    """
    order = F.struct("ts", *([tie] if tie else []))

    def last(name: str, value: Column, ok: Column | None = None) -> Column:
        mine = F.col("field") == name
        mine = mine & ok if ok is not None else mine
        return F.max_by(F.when(mine, value), F.when(mine, order)).alias(f"edited_{name}")

    return edits.groupBy("content_id").agg(
        last("status", F.col("value"), F.col("value").isin(*STATUSES)),
        last("postedAt", F.col("ts")),
        last("note", strip(F.coalesce(F.col("value"), F.lit("")))),
    )


def apply_edits(content: DataFrame, edits: DataFrame, tie: str | None = None) -> DataFrame:
    joined = content.join(latest_edits(edits, tie), "content_id", "left")
    return joined.withColumns({
        name: F.coalesce(F.col(f"edited_{name}"), F.col(name)) for name in ("status", "postedAt", "note")
    }).select(*content.columns)


def purge_untitled(content: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(snapshot, matched): leftovers removed, or only listed in a dry run."""
    hit = urls.untitled_leftover(F.col("url"), F.col("title"))
    matched = content.filter(hit).select(F.col("content_id").alias("id"), "url")
    return (content if dry_run else content.filter(~hit)), matched
