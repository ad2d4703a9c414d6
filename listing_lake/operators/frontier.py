"""What to fetch next: listing pages, crawl rules and the refresh of detail pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import urls
from listing_lake.functions.text import present
from listing_lake.operators.details import wants_detail, wants_gallery
from listing_lake.operators.listings import flag
from listing_lake.operators.store import canonical_documents

# --- fixed values: must equal the stored data's rules -------------------------------------------
DEFAULT_REFRESH_HOURS = 72.0
# ------------------------------------------------------------------------------------------------


def expand_pages(sources: DataFrame) -> DataFrame:
    """One row per listing page of a source; a source without a page parameter has one page."""
    last = F.when(present(F.col("page_param")), F.greatest(F.coalesce("max_pages", F.lit(1)), F.lit(1))).otherwise(1)
    pages = sources.select("*", F.explode(F.sequence(F.lit(1), last)).alias("page_no"))
    return pages.withColumn("page_url", urls.page_url(F.col("url"), F.col("page_param"), F.col("page_no")))


def robots_filter(fetches: DataFrame, rules: DataFrame, status: DataFrame, url: str = "url") -> DataFrame:
    """Adds `robots_allowed`.

    `rules` is (origin, rule_order, path_prefix, allowed), `status` (origin, http_status). 404 allows everything; another
    status of 400 or more, or an origin never asked, denies; else the first rule whose prefix fits decides. A row whose
    `respect_robots` is false is allowed. The rules of an origin fold into one array first, so the fetches join once.
    """
    u = urls.parts(F.col(url))
    folded = rules.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("rule_order", "path_prefix", "allowed"))).alias("_rules"))
    policy = status.join(folded, "origin", "left").select("origin", F.struct("http_status", "_rules").alias("_p"))
    target = F.concat(
        F.when(u.path == "", F.lit("/")).otherwise(u.path), F.when(u.query != "", F.concat(F.lit("?"), u.query)).otherwise(""))
    joined = (
        fetches.withColumn("_target", target)
        .withColumn("origin", F.concat(u.scheme, F.lit("://"), u.authority))
        .join(policy, "origin", "left")
    )
    fits = F.filter(
        "_p._rules", lambda r: (r["path_prefix"] == "*") | F.startswith(F.col("_target"), r["path_prefix"]))
    by_rule = F.coalesce(F.try_element_at(fits, F.lit(1))["allowed"], F.lit(True))
    code = F.col("_p.http_status")
    allowed = (
        F.when(code == 404, True).when(code.isNull() | (code >= 400), False).otherwise(by_rule)
    )
    if "respect_robots" in fetches.columns:
        allowed = F.when(~F.coalesce("respect_robots", F.lit(True)), True).otherwise(allowed)
    return joined.withColumn("robots_allowed", allowed).drop("_target", "origin", "_p")


def url_index(content: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The chosen document per URL with the columns the refresh decision reads."""
    chosen = canonical_documents(content, only)
    return chosen.join(
        content.select(
            "content_id", F.col("imageUrl").alias("stored_image"), F.col("detailImageUrls").alias("stored_gallery"),
            F.coalesce("detailCheckedAt", "productCheckedAt").alias("checked_at"),
        ), "content_id",
    ).drop("content_id")


def needs_detail(
    listed: DataFrame, content: DataFrame | None, now: datetime | Column, *, force: bool = False,
) -> DataFrame:
    """Adds `needs_detail` to listed URLs.

    `listed` has url, product_mode, refresh_hours and want_gallery. `content` None means no store: fetch all.
    """
    if content is None:
        return listed.withColumn("needs_detail", F.lit(True))
    now = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    rows = listed.withColumn("url_norm", urls.normalize_url(F.col("url")))
    asked = rows.select("url_norm").filter("url_norm is not null").distinct()
    joined = rows.join(url_index(content, asked).withColumn("_known", F.lit(True)), "url_norm", "left")
    hours = F.lit(0.0) if force else F.coalesce(F.col("refresh_hours").cast("double"), F.lit(0.0))
    age = F.unix_micros(now) - F.unix_micros("checked_at")
    decision = (
        F.when(F.col("_known").isNull() | (hours <= 0), True)
        .when(flag(F.col("want_gallery")) & F.col("stored_gallery").isNull(), True)
        .when(~flag(F.col("product_mode")) & present(F.col("stored_image")), False)
        .when(F.col("checked_at").isNull(), True)
        .otherwise(age >= hours * 3_600_000_000)
    )
    return joined.withColumn("needs_detail", decision).drop(
        "url_norm", "_known", "stored_image", "stored_gallery", "checked_at")


def detail_modes(listed: DataFrame) -> DataFrame:
    """Adds the refresh options of each row's source struct `src`; sources without details give no row."""
    src = F.col("src")
    has_rules = flag(F.size(src["detail_rules"]) > 0)
    return listed.filter(wants_detail(src)).withColumns({
        "product_mode": flag(src["product_mode"]) | has_rules,
        "want_gallery": wants_gallery(src),
        "refresh_hours": F.coalesce(src["detail_refresh_hours"], F.lit(DEFAULT_REFRESH_HOURS)),
        "respect_robots": F.coalesce(src["respect_robots"], F.lit(True)),
    })


def fetch_queue(
    sources: DataFrame, listed: DataFrame, content: DataFrame | None, rules: DataFrame, status: DataFrame,
    now: datetime | Column, *, force: bool = False,
) -> DataFrame:
    """(source, kind, page_no, pos, url): allowed listing pages, then allowed details that are due."""
    pages = expand_pages(sources).select(
        F.col("name").alias("source"), F.lit("list").alias("kind"), "page_no", F.lit(0).alias("pos"),
        F.col("page_url").alias("url"), F.coalesce("respect_robots", F.lit(True)).alias("respect_robots"),
    )
    due = needs_detail(detail_modes(listed), content, now, force=force).filter("needs_detail").select(
        "source", F.lit("detail").alias("kind"), "page_no", "pos", "url", "respect_robots")
    queue = robots_filter(pages.unionByName(due), rules, status)
    # A source is read up to its first denied listing page; without a first page it has no details either.
    stops = queue.filter("kind = 'list' and not robots_allowed").groupBy("source").agg(F.min("page_no").alias("stop"))
    return (
        queue.filter("robots_allowed").join(stops, "source", "left")
        .filter("stop is null or stop > 1 and (kind = 'detail' or page_no < stop)")
        .select("source", "kind", "page_no", "pos", "url")
    )
