"""The user-level jobs: each takes tables and returns tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from listing_lake.functions import cards, fields
from listing_lake.operators import dedupe, details, feed, listings, store, works as W
from listing_lake.operators.shred import shred_pages
from listing_lake.session import materialize
from listing_lake.sources import dims, payloads


def list_pages(pages: DataFrame, sources: DataFrame, now: datetime, denied: DataFrame | None = None) -> DataFrame:
    """Listing pages (source, page_no, url, html) to first-seen, limited candidates.

    The shredded pages are read once: the candidates are written before the steps that pass over them again.
    `denied` is (source, page_no) of pages the crawl rules forbade.
    """
    found = materialize(
        listings.extract_listings(shred_pages(dims.with_source(pages, sources)), now).drop("src"), "candidates")
    read = pages.select("source", "page_no")
    if denied is not None:
        read = read.join(denied.withColumn("denied", F.lit(True)), ["source", "page_no"], "full").withColumn(
            "denied", F.coalesce("denied", F.lit(False)))
    limits = found.join(sources.select(F.col("name").alias("source"), F.coalesce("max_items", F.lit(50)).alias("_limit")), "source")
    return dedupe.dedupe_listings(limits, read, F.col("_limit")).drop("_limit")


def add_details(candidates: DataFrame, detail_pages: DataFrame, sources: DataFrame, now: datetime) -> DataFrame:
    """Candidates with what their fetched detail pages (source, url, html, failed) say."""
    read = details.read_details(shred_pages(dims.with_source(detail_pages, sources)), now)
    return details.apply_details(dims.with_source(candidates, sources), read, now).drop("src")


def limit_first_seen(entries: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """The first row of every URL of a source, up to the source's limit; no page ends the reading."""
    limits = entries.join(sources.select(F.col("name").alias("source"), F.coalesce("max_items", F.lit(50)).alias("_limit")), "source")
    first = dedupe.first_seen(limits, ["source", "url"], ["page_no", "pos"])
    per_page = dedupe.new_per_page(first, pages.select("source", "page_no"))
    return dedupe.rank_in_source(first, per_page).filter(F.col("listed_rank") <= F.col("_limit")).drop("_limit")


def limit_feeds(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Parsed feeds to first-seen, limited candidates."""
    return limit_first_seen(payloads.feed_entries(parsed), parsed, sources)


def read_feeds(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed documents (source, page_no, url, body) to first-seen, limited candidates."""
    return limit_feeds(payloads.parse_feeds(documents), sources)


def read_api(payload_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """API payloads (source, page_no, url, body) to limited candidates; nothing is deduplicated."""
    rows = dims.with_source(payload_rows, sources).withColumn("api", F.col("src.api")).withColumn(
        "_limit", F.coalesce("src.max_items", F.lit(50))).drop("src")
    entries = materialize(payloads.with_entry_image(payloads.read_json_payloads(payloads.page_count_stop(rows))).drop("api"), "entries")
    per_page = dedupe.new_per_page(entries, payload_rows.select("source", "page_no"))
    return dedupe.rank_in_source(entries, per_page).filter(F.col("listed_rank") <= F.col("_limit")).drop("_limit")


def merge_run(content: DataFrame, candidates: DataFrame, sources: DataFrame, now: datetime, seq: list[str]) -> tuple[DataFrame, DataFrame]:
    """(snapshot, outcome per URL) of one collection run; writing the snapshot is the caller's choice."""
    return store.merge_content(content, fields.default_metadata(candidates, sources), now, seq)


def build_feed(content: DataFrame, works: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(feed items with search text, visible works with aliases)."""
    keywords = W.work_keywords(works)
    matched = W.with_works(feed.visible(content), keywords)
    items = materialize(cards.feed_items(matched, now), "feed")
    aliases = W.visible_aliases(items, works, keywords)
    return feed.with_search_text(items, aliases), aliases


def digest_per_work(items: DataFrame) -> DataFrame:
    """A comparison digest of the best twenty items of every work."""
    per_work = items.select("*", F.explode("works").alias("work"))
    order = [F.desc("view.signal_score"), F.desc("effective_date"), F.asc("id")]
    return feed.digest(feed.top_per_group(per_work, ["work"], order), ["work"])
