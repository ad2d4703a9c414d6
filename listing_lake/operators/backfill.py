"""Fill empty photos and translations, never replacing a stored value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import urls
from listing_lake.functions.text import needs_translation, present, strip
from listing_lake.operators.listings import flag

# --- fixed values: must equal the stored data's rules -------------------------------------------
DETAIL_LIMIT = 60
# ------------------------------------------------------------------------------------------------


def image_candidates(content: DataFrame, sources: DataFrame, limit: int = DETAIL_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(chosen, missing): documents without a photo; `eligible` ones of photo-fetching sources, by id up to the limit."""
    missing = content.filter(urls.http_url(F.col("imageUrl")).isNull())
    dim = sources.select(F.col("name").alias("source"), flag(F.col("fetch_detail_image")).alias("_fetch"))
    marked = missing.select("content_id", "url", "source").join(dim, "source", "left").withColumn(
        "eligible", flag(F.col("_fetch")) & present(F.col("url"))).drop("_fetch")
    # The limit is the run's page budget; what it leaves out counts as still missing.
    return marked.filter("eligible").orderBy("content_id").limit(limit), marked


def fill_images(content: DataFrame, found: DataFrame) -> DataFrame:
    """Snapshot with `found` (content_id, photo) written where no valid photo is stored."""
    joined = content.join(found.select("content_id", F.col("photo").alias("_photo")), "content_id", "left")
    kept = urls.http_url(F.col("imageUrl")).isNotNull()
    return joined.withColumn(
        "imageUrl", F.when(kept, F.col("imageUrl")).otherwise(F.coalesce("_photo", "imageUrl"))).select(*content.columns)


def image_counters(marked: DataFrame, tried: DataFrame) -> DataFrame:
    """processed, updated, still_missing, failed. `tried` is (content_id, photo, failed) of the fetched pages."""
    joined = marked.join(tried, "content_id", "left")
    failed, photo = flag(F.col("failed")), F.col("photo").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(photo & ~failed).alias("updated"),
        F.count_if(~photo & ~failed).alias("still_missing"), F.count_if(failed).alias("failed"),
    )


def translation_candidates(content: DataFrame) -> DataFrame:
    """Documents without a Korean title whose title or summary is not mostly Hangul."""
    blank = strip(F.coalesce("titleKo", F.lit(""))) == ""
    return content.filter(blank & (
        needs_translation(strip(F.coalesce("title", F.lit("")))) | needs_translation(strip(F.coalesce("summary", F.lit(""))))))


def text_hash(c: Column) -> Column:
    return F.sha2(strip(F.coalesce(c, F.lit(""))), 256)


def translate(content: DataFrame, translations: DataFrame, now) -> DataFrame:
    """Snapshot with titleKo, summaryKo, language and time from a translations table.

    `translations` is (text_hash, text_ko, language), one row per text. A title that needs and lacks a translation leaves the
    document untouched.
    """
    candidates = translation_candidates(content).select("content_id", "title", "summary")
    t = translations.select("text_hash", F.struct("text_ko", "language").alias("_t"))
    rows = (
        candidates.withColumn("_need_title", needs_translation(strip(F.coalesce("title", F.lit("")))))
        .withColumn("_need_summary", needs_translation(strip(F.coalesce("summary", F.lit("")))))
        .withColumn("text_hash", F.when(F.col("_need_title"), text_hash(F.col("title"))))
        .join(t.withColumnRenamed("_t", "_title"), "text_hash", "left").drop("text_hash")
        .withColumn("text_hash", F.when(F.col("_need_summary"), text_hash(F.col("summary"))))
        .join(t.withColumnRenamed("_t", "_summary"), "text_hash", "left").drop("text_hash")
    )
    title, summary = F.coalesce("_title.text_ko", F.lit("")), F.coalesce("_summary.text_ko", F.lit(""))
    title_language = F.coalesce("_title.language", F.lit("unknown"))
    language = F.when((title_language == "unknown") & (summary != ""), F.coalesce("_summary.language", F.lit("unknown"))).otherwise(title_language)
    done = rows.filter((~F.col("_need_title") | (title != "")) & ((title != "") | (summary != ""))).select(
        "content_id", F.struct(
            F.when(F.col("_need_title"), title).otherwise("").alias("titleKo"), summary.alias("summaryKo"),
            language.alias("sourceLanguage"), F.lit(now).cast("timestamp").alias("translatedAt"),
        ).alias("_new"),
    )
    joined = content.join(done, "content_id", "left")
    return joined.withColumns({
        name: F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name))
        for name in ("titleKo", "summaryKo", "sourceLanguage", "translatedAt")
    }).select(*content.columns)


def translation_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """processed, updated, skipped, failed of a translation run."""
    need = translation_candidates(before).select("content_id", F.lit(True).alias("_need"))
    stamp = before.select("content_id", F.col("translatedAt").alias("_old"))
    rows = after.select("content_id", "translatedAt").join(stamp, "content_id").join(need, "content_id", "left")
    wanted = flag(F.col("_need"))
    changed = wanted & ~F.col("translatedAt").eqNullSafe(F.col("_old"))
    return rows.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(changed).alias("updated"),
        F.count_if(~wanted).alias("skipped"), F.count_if(wanted & ~changed).alias("failed"),
    )
