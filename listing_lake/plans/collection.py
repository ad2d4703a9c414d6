"""A collection run: every source read by its type, one merge in source order, and a report per source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from listing_lake.functions import fields
from listing_lake.operators import dedupe, details, reports, snapshots, store
from listing_lake.operators.listings import flag
from listing_lake.operators.shred import shred_pages
from listing_lake.plans import jobs
from listing_lake.session import materialize
from listing_lake.sources import dims, intake, payloads

# --- fixed values: must equal the stored data's rules -------------------------------------------
DENIED_REASON = "robots.txt 수집 거부"
SAVE_ERROR = "저장 실패: url"
FIGURE_FAILED = "(피규어팜 상품 수집 실패)"
FIGURE_LIMIT = 20
# ------------------------------------------------------------------------------------------------

# What a collector gives: the order of appearance, the listed values, and the errors of the item.
ARRIVAL = {"source": "string", "page_no": "bigint", "pos": "bigint", "listed_rank": "bigint", "url": "string"} | {
    name: kind for name, kind in store.CONTENT.items() if name in ("title", "summary", "publishedAt", *store.PRODUCT_FIELDS)
} | {"errors": "array<string>"}
SEQ = ["ord", "listed_rank"]


@dataclass(frozen=True)
class Fetched:
    """What a run has fetched.

    `pages` (source, page_no, url, body) are listing pages, feeds and API payloads as text; `details` (source, url, html, failed)
    product pages; `cards` what `intake.rendered_cards` takes, without `src`; `denied` (source, page_no) the listing pages that crawl
    rules forbade.
    """

    pages: DataFrame
    details: DataFrame | None = None
    cards: DataFrame | None = None
    denied: DataFrame | None = None


@dataclass(frozen=True)
class Run:
    """`outcome` per URL as `store.outcome` gives it, `report` per source and in total, `unknown` (source, n) pages of no source."""

    outcome: DataFrame
    report: DataFrame
    unknown: DataFrame


# --- collectors ---------------------------------------------------------------------------------
def _of(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of some sources."""
    return rows.join(sources.select(F.col("name").alias("source")), "source", "left_semi")


def _arrivals(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*[(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in ARRIVAL.items()])


def _failures(rows: DataFrame) -> DataFrame:
    """(source, reason) of documents that could not be read."""
    return rows.select("source", F.col("error").alias("reason"))


def _html(fetched: Fetched, sources: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame | None]:
    pages = _of(fetched.pages, sources).withColumnRenamed("body", "html")
    found = jobs.list_pages(pages, sources, now, None if fetched.denied is None else _of(fetched.denied, sources))
    if fetched.details is not None:
        found = jobs.add_details(found, _of(fetched.details, sources), sources, now)
    return found, None


def _rss(fetched: Fetched, sources: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame | None]:
    parsed = materialize(payloads.parse_feeds(_of(fetched.pages, sources)), "feeds")
    return jobs.limit_feeds(parsed, sources), _failures(payloads.feed_failures(parsed))


def _json_api(fetched: Fetched, sources: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame | None]:
    pages = _of(fetched.pages, sources)
    return jobs.read_api(pages, sources), _failures(payloads.json_failures(pages))


def _local_browser(fetched: Fetched, sources: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame | None]:
    if fetched.cards is None:
        return _of(fetched.pages, sources).limit(0), None
    cards = _of(fetched.cards, sources)
    found = materialize(intake.rendered_cards(dims.with_source(cards, sources), now).drop("src"), "cards")
    return jobs.limit_first_seen(found, cards.select("source", "page_no").distinct(), sources), None


def _figurefarm(fetched: Fetched, sources: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame | None]:
    """Products of a figure shop: the links of its listing, the limit counted before the title test, then their detail pages.

    A link without a fetched detail page was not due and comes as listed, so the merge counts it and changes nothing.
    """
    pages = dims.with_source(_of(fetched.pages, sources).withColumnRenamed("body", "html"), sources)
    limit = F.greatest(F.coalesce("max_items", F.lit(FIGURE_LIMIT)), F.lit(1))
    options = sources.select(F.col("name").alias("source"), F.coalesce("figure_only", F.lit(True)).alias("_only"), limit.alias("_limit"))
    links = materialize(details.figure_links(shred_pages(pages)), "figure-links")
    first = dedupe.first_seen(links, ["source", "url"], ["page_no", "pos"])
    ranked = dedupe.rank_in_source(first, dedupe.new_per_page(first, pages.select("source", "page_no"))).join(options, "source")
    listed = ranked.filter((F.col("listed_rank") <= F.col("_limit")) & (F.col("is_candidate") | ~F.col("_only")))
    plain = F.coalesce(F.when(F.col("list_title") != "", F.col("list_title")), F.col("url"))
    if fetched.details is None:
        return listed.withColumn("title", plain), None
    read = _of(fetched.details, sources)
    products = details.figure_products(shred_pages(dims.with_source(read.filter(~flag(F.col("failed"))), sources)), now, figure_only=False)
    known = [c for c in ARRIVAL if c in products.columns and c not in ("source", "url")]
    found = listed.join(read.select("source", "url", flag(F.col("failed")).alias("_failed")), ["source", "url"], "left").join(
        products.select("source", "url", F.struct(*known).alias("_p")), ["source", "url"], "left")
    lost, none = F.col("_failed"), F.array().cast("array<string>")
    title = F.when(F.col("_failed").isNull(), plain).when(lost, F.lit(FIGURE_FAILED)).otherwise(F.col("_p.title"))
    errors = F.when(lost, F.array(F.concat(F.lit(details.DETAIL_ERROR), F.col("url")))).otherwise(F.coalesce(F.col("_p.errors"), none))
    # A product page that names no figure is left out; one whose title cannot be read is an error of its own.
    other = F.col("_only") & ~lost & (F.col("_p.title") != details.TITLE_FAILED) & ~fields.has_figure_keyword(F.col("_p.title"))
    return found.filter(~flag(other)).select(
        "source", "page_no", "pos", "listed_rank", "url", title.alias("title"), errors.alias("errors"),
        *[F.col(f"_p.{c}").alias(c) for c in known if c not in ("title", "errors")]), None


# The registry: each takes what was fetched, the sources of its type and the moment, and gives candidates and failed documents.
COLLECTORS: dict[str, Callable[[Fetched, DataFrame, datetime], tuple[DataFrame, DataFrame | None]]] = {
    "rss": _rss, "html": _html, "json_api": _json_api, "local_browser": _local_browser, "figurefarm": _figurefarm,
}


# --- run ----------------------------------------------------------------------------------------
def collect(fetched: Fetched, sources: DataFrame, now: datetime, allow_manual: bool = False) -> tuple[DataFrame, DataFrame]:
    """(arrivals, failures) of all sources that run, each read by the collector of its type.

    Arrivals carry `ord` and `listed_rank`, the order in which a run meets them: source by source.
    """
    spark = sources.sparkSession
    running = reports.eligibility(sources, allow_manual).filter("skip_reason is null").drop("skip_reason", "counts_as_failed")
    # The source table is configuration: its few types decide which collectors are planned at all.
    types = {r[0] for r in running.select("type").distinct().collect()}
    arrivals = spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, kind in ARRIVAL.items()))
    failures = spark.createDataFrame([], "source string, reason string")
    for kind, collector in COLLECTORS.items():
        if kind in types:
            rows, failed = collector(fetched, running.filter(F.col("type") == kind), now)
            arrivals = arrivals.unionByName(_arrivals(rows))
            failures = failures if failed is None else failures.unionByName(failed)
    order = sources.select(F.col("name").alias("source"), "ord")
    return fields.default_metadata(arrivals.join(order, "source"), sources), failures


def source_counters(arrivals: DataFrame, outcome: DataFrame) -> DataFrame:
    """(source, processed, inserted, existing, updated, failed) of a merge.

    A URL that several sources list is inserted by the first of them in `SEQ` order and exists for the others. Rows of a source and
    URL collapse before they meet the outcome, which travels with its counters only.
    """
    rows = store.prepared(arrivals)
    bad = (F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0) | F.col("url_norm").isNull()
    per_url = rows.groupBy("source", "url_norm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_upd").alias("n_upd"), F.count_if(bad).alias("n_bad"))
    narrow = outcome.select("url_norm", F.col("base.source").alias("_first"), "first_updates", F.col("inserted").alias("_new"))
    joined = per_url.join(narrow, "url_norm", "left")
    saved = F.col("url_norm").isNotNull()
    inserted = F.when(F.col("_first") == F.col("source"), F.col("_new")).otherwise(0)
    own_update = F.when((inserted == 1) & F.col("first_updates"), 1).otherwise(0)
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    return joined.groupBy("source").agg(
        total(F.col("n"), "processed"), total(inserted, "inserted"), total(F.when(saved, F.col("n") - inserted).otherwise(0), "existing"),
        total(F.when(saved, F.col("n_upd") - own_update).otherwise(0), "updated"), total(F.col("n_bad"), "failed"))


def item_errors(arrivals: DataFrame) -> DataFrame:
    """(source, seq, message) of the items that failed."""
    own = F.coalesce("errors", F.array().cast("array<string>"))
    saved = store.prepared(arrivals).withColumn("_all", F.when(
        F.col("url_norm").isNull(), F.concat(own, F.array(F.lit(SAVE_ERROR)))).otherwise(own))
    return saved.filter(F.size("_all") > 0).select(
        "source", F.col("listed_rank").alias("seq"),
        F.concat(F.coalesce("url", F.lit("None")), F.lit(": "), F.array_join("_all", "; ")).alias("message"))


def run_report(
    sources: DataFrame, arrivals: DataFrame, outcome: DataFrame, failures: DataFrame, denied: DataFrame | None = None, allow_manual: bool = False,
) -> DataFrame:
    """(ord, source, processed, inserted, existing, updated, failed, note): every source, also those that did not run, and the total.

    A document that cannot be read counts as one failure and gives the note; else the first failed items do.
    """
    named = reports.eligibility(sources, allow_manual).select(
        "ord", F.col("name").alias("source"), "skip_reason", F.when(F.col("counts_as_failed"), 1).otherwise(0).alias("_skip_failed"))
    lost = failures.groupBy("source").agg(F.count(F.lit(1)).alias("_lost"))
    noted = failures.select("source", F.lit(None).cast("bigint").alias("seq"), F.col("reason").alias("message"), "reason")
    if denied is not None:
        # A source is skipped, not failed, when its first page is forbidden.
        noted = noted.unionByName(denied.groupBy("source").agg(F.min("page_no").alias("p")).filter("p <= 1").select(
            "source", F.lit(None).cast("bigint").alias("seq"), F.lit(DENIED_REASON).alias("message"), F.lit(DENIED_REASON).alias("reason")))
    notes = reports.error_summary(item_errors(arrivals).withColumn("reason", F.lit(None).cast("string")).unionByName(noted))
    rows = named.join(source_counters(arrivals, outcome), "source", "left").join(lost, "source", "left").join(notes, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    failed = zero(F.col("failed")) + zero(F.col("_lost")) + F.col("_skip_failed")
    rows = rows.select(
        "ord", "source", *[zero(F.col(c)).alias(c) for c in reports.COUNTS if c != "failed"], failed.alias("failed"),
        F.coalesce("skip_reason", "note", F.lit("")).alias("note"))
    sums = [F.sum(c).alias(c) for c in reports.COUNTS]
    both = rows.groupingSets([["ord", "source", "note"], []], "ord", "source", "note").agg(F.grouping("source").alias("_g"), *sums)
    return both.select(
        "ord", F.when(F.col("_g") == 1, F.lit(reports.TOTAL)).otherwise(F.col("source")).alias("source"), *reports.COUNTS,
        F.coalesce("note", F.lit("")).alias("note"))


def run_collection(
    spark: SparkSession, root: str, fetched: Fetched, sources: DataFrame, now: datetime, *, allow_manual: bool = False, dry_run: bool = False,
    stream: str | None = None, batch_id: int | None = None, n_buckets: int = snapshots.BUCKETS,
) -> Run | None:
    """Read everything fetched, merge it into the stored table under `root` and report; None for a batch that is merged already.

    A dry run compares with the stored table but writes nothing.
    """
    found, failed = collect(fetched, sources, now, allow_manual)
    arrivals, failures = materialize(found, "arrivals"), materialize(failed, "failures")
    if dry_run:
        staged = materialize(store.stage(arrivals, SEQ), "staged")
        outcome = materialize(store.outcome(staged, store.canonical_documents(snapshots.read_content(spark, root), staged)), "outcome")
    else:
        outcome = snapshots.merge(spark, root, arrivals, now, SEQ, stream, batch_id, n_buckets)
        if outcome is None:
            return None
    unknown = fetched.pages.join(sources.select(F.col("name").alias("source")), "source", "left_anti").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"))
    return Run(outcome, run_report(sources, arrivals, outcome, failures, fetched.denied, allow_manual), unknown)
