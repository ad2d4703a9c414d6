"""First-seen dedupe, early page stop and item limits, all in order of appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PAGES_PER_BUCKET = 1024


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key.

    An aggregate, not a window: copies of one key collapse before the shuffle, however many there are.
    """
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*rows.columns)


def new_per_page(first: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, page_no, n_new) for every read page; a page that added nothing counts zero."""
    counts = first.groupBy("source", "page_no").agg(F.count(F.lit(1)).alias("n_new"))
    return pages.join(counts, ["source", "page_no"], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))


def page_stop(per_page: DataFrame) -> DataFrame:
    """(source, stop_page): first page that was denied or added nothing; reading ends before it."""
    ends = F.col("n_new") == 0
    if "denied" in per_page.columns:
        ends = ends | F.col("denied")
    return per_page.groupBy("source").agg(F.min(F.when(ends, F.col("page_no"))).alias("stop_page"))


def page_offsets(per_page: DataFrame) -> DataFrame:
    """(source, page_no, before): items of earlier pages of the source.

    Running totals in two levels, so a source with very many pages is not one task.
    """
    bucket = F.floor(F.col("page_no") / PAGES_PER_BUCKET)
    rows = per_page.withColumn("_bucket", bucket)
    totals = rows.groupBy("source", "_bucket").agg(F.sum("n_new").alias("_n"))
    by_bucket = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source", "_bucket", F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_bucket").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("n_new").over(inside), F.lit(0)))
        .join(bases, ["source", "_bucket"])
        .select("source", "page_no", (F.col("_base") + F.col("_inside")).alias("before"))
    )


def rank_in_source(rows: DataFrame, per_page: DataFrame, order: str = "pos") -> DataFrame:
    """Adds `listed_rank`, the 1-based place of a row within its source.

    Only one page's rows meet in a task; whole pages are placed by their running totals.
    """
    in_page = Window.partitionBy("source", "page_no").orderBy(order)
    return (
        rows.withColumn("_in_page", F.row_number().over(in_page))
        .join(page_offsets(per_page), ["source", "page_no"])
        .withColumn("listed_rank", F.col("before") + F.col("_in_page"))
        .drop("_in_page", "before")
    )


def dedupe_listings(
    candidates: DataFrame, pages: DataFrame, max_items: Column | int | None = None, dedupe: bool = True,
) -> DataFrame:
    """Candidates as a crawl would yield them: first-seen, early stop, item limit.

    `pages` lists every read page (source, page_no[, denied]). `max_items` is a number or a column of `candidates`;
    null means no limit and zero or less gives nothing.
    """
    rows = first_seen(candidates, ["source", "url"], ["page_no", "pos"]) if dedupe else candidates
    per_page = new_per_page(rows, pages)
    kept = (
        rows.join(page_stop(per_page), "source", "left")
        .filter(F.col("stop_page").isNull() | (F.col("page_no") < F.col("stop_page")))
        .drop("stop_page")
    )
    if max_items is None:
        return kept
    ranked = rank_in_source(kept, per_page)
    limit = max_items if isinstance(max_items, Column) else F.lit(max_items)
    return ranked.filter(limit.isNull() | (F.col("listed_rank") <= limit))
