"""Feeds, inbox pages, recommendations, facets and comparison digests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from listing_lake.functions import cards
from listing_lake.functions.text import fold_search
from listing_lake.session import small_table

# --- fixed values: must equal the stored data's rules -------------------------------------------
INBOX_PAGE = 30
FEED_PAGE = 60
DAY_CHOICES = ("7", "14", "30", "ALL")
DEFAULT_DAYS = "14"
POOL_DAYS, POOL_ROWS, POOL_TOP = 14, 200, 10
MAX_DIGEST = 20
BODY_TARGET = 260
PRODUCT_HEADER = "상품 페이지 참고 ↓"
PLAIN_HEADER = "링크 ↓"
UNCLASSIFIED = "__NONE__"
# ------------------------------------------------------------------------------------------------


def since(now: datetime | Column, days: int) -> Column:
    return F.timestamp_micros(F.unix_micros(cards.as_now(now).cast("timestamp")) - days * 86_400_000_000)


def recent(content: DataFrame, now: datetime | Column, days: str | None) -> DataFrame:
    """Rows collected within 7, 14 or 30 days, or all; any other choice means 14."""
    choice = days if days in DAY_CHOICES else DEFAULT_DAYS
    rows = content.filter(F.col("collectedAt").isNotNull())
    return rows if choice == "ALL" else rows.filter(F.col("collectedAt") >= since(now, int(choice)))


def visible(content: DataFrame) -> DataFrame:
    return content.filter(~F.col("status").eqNullSafe("IGNORE"))


def keyset_page(
    content: DataFrame, now: datetime | Column, *, days: str = "ALL", category: str = "ALL",
    after: tuple[datetime, str] | None = None, size: int = INBOX_PAGE,
) -> DataFrame:
    """The `size` rows after the cursor, newest first; ids break ties in descending order.

    `after` is (collectedAt, content_id) of the last row already shown.
    """
    rows = recent(content, now, days)
    if category and category != "ALL":
        rows = rows.filter(F.col("storage_category") == category)
    if after:
        moment, last_id = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.filter(
            (F.col("collectedAt") < moment) | ((F.col("collectedAt") == moment) & (F.col("content_id") < last_id)))
    return rows.orderBy(F.desc("collectedAt"), F.desc("content_id")).limit(size)


def page_cursor(page: DataFrame, size: int = INBOX_PAGE) -> DataFrame:
    """One row: has_more and the next cursor of a page."""
    last = F.min(F.struct("collectedAt", "content_id"))
    return page.agg((F.count(F.lit(1)) == size).alias("has_more"), last.alias("_l")).select(
        "has_more", F.col("_l.collectedAt").alias("after_collected_at"), F.col("_l.content_id").alias("after_id"),
    )


def inbox_page(
    content: DataFrame, now: datetime | Column, *, days: str = DEFAULT_DAYS, category: str = "ALL", status: str = "NEW",
    tier: str = "ALL", source: str = "ALL", unposted: bool = False, sort: str = "RECOMMENDED",
    after: tuple[datetime, str] | None = None,
) -> DataFrame:
    """One inbox page: the page limit first, then the chips, then the sort."""
    page = keyset_page(content, now, days=days, category=category, after=after)
    keep = F.lit(True)
    if category != "ALL":
        keep = keep & (F.col("category") == category)
    keep = keep & (~F.col("status").eqNullSafe("IGNORE") if status == "ACTIVE" else F.col("status") == status)
    if tier != "ALL":
        keep = keep & (F.col("sourceTier") == tier)
    if source != "ALL":
        keep = keep & (F.col("source") == source)
    if unposted:
        keep = keep & F.col("postedAt").isNull()
    return sort_items(cards.with_score(page.filter(keep), now), sort)


def source_options(page: DataFrame) -> DataFrame:
    """Sorted distinct sources of one page."""
    return page.filter(F.col("source") != "").select("source").distinct().orderBy("source")


def sort_items(scored: DataFrame, sort: str = "RECOMMENDED", tie: str = "content_id") -> DataFrame:
    """RECOMMENDED: score then date; NEWEST or anything else: date. Ids break ties."""
    by_date = F.desc("effective_date") if sort in ("RECOMMENDED", "NEWEST") else F.asc("effective_date")
    first = [F.desc("signal_score")] if sort == "RECOMMENDED" else []
    return scored.orderBy(*first, by_date, F.asc(tie))


def recommended(
    content: DataFrame, now: datetime | Column, *, days: int = POOL_DAYS, pool: int = POOL_ROWS, top: int = POOL_TOP,
) -> DataFrame:
    """The best `top` of the newest `pool` rows that are neither ignored nor posted."""
    newest = (
        content.filter(F.col("collectedAt") >= since(now, days))
        .orderBy(F.desc("collectedAt"), F.asc("content_id")).limit(pool)
    )
    open_rows = visible(newest).filter(F.col("postedAt").isNull())
    return (
        cards.with_score(open_rows, now)
        .orderBy(F.desc("signal_score"), F.desc("collectedAt"), F.asc("content_id")).limit(top)
    )


# --- public feed --------------------------------------------------------------------------------
def with_search_text(feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the normalised text a search looks in: titles, source, works and the works' aliases.

    `aliases` is (name, aliases) of the visible works; only ids and alias texts are shuffled.
    """
    words = (
        feed.select("id", F.explode("works").alias("name"))
        .join(aliases.select("name", F.array_join("aliases", " ").alias("_a")), "name")
        .groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("_a")), " ").alias("_aliases"))
    )
    text = F.concat_ws(
        " ", F.col("view.title_text"), F.col("view.original_title"), F.col("source"),
        F.array_join("works", " "), F.col("_aliases"),
    )
    return feed.join(words, "id", "left").withColumn("search_text", fold_search(text)).drop("_aliases")


def query_feed(
    feed: DataFrame, now: datetime | Column, *, q: str = "", work: str = "ALL", category: str = "ALL",
    source: str = "ALL", days: str = "ALL", sort: str = "RECOMMENDED", step: int | None = None,
) -> DataFrame:
    """Feed rows passing every filter, sorted; `step` n gives the n-th block of 60."""
    rows = feed
    if work == UNCLASSIFIED:
        rows = rows.filter(F.size("works") == 0)
    elif work != "ALL":
        rows = rows.filter(F.array_contains("works", work))
    if category != "ALL":
        rows = rows.filter(F.col("category") == category)
    if source != "ALL":
        rows = rows.filter(F.col("source") == source)
    if days != "ALL":
        rows = rows.filter(F.col("collectedAt") >= since(now, int(days)))
    if q:
        rows = rows.filter(F.contains(F.col("search_text"), fold_search(F.lit(q))))
    rows = sort_items(rows.withColumn("signal_score", F.col("view.signal_score")), sort, tie="id")
    return rows if step is None else rows.offset(step * FEED_PAGE).limit(FEED_PAGE)


def facets(feed: DataFrame) -> DataFrame:
    """(kind, value, n): counts per work, source and category, unclassified and total, in one pass."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    cells = F.concat(
        F.array(
            pair("total", F.lit("")), pair("category", F.col("category")),
            F.when(F.col("source") != "", pair("source", F.col("source"))),
            F.when(F.size("works") == 0, pair("unclassified", F.lit(""))),
        ),
        F.transform("works", lambda w: pair("work", w)),
    )
    return (
        feed.select(F.explode(F.array_compact(cells)).alias("c"))
        .groupBy("c.kind", "c.value").agg(F.count(F.lit(1)).alias("n"))
    )


def work_menu(counts: DataFrame) -> DataFrame:
    """Works by count, then name."""
    return counts.filter("kind = 'work'").orderBy(F.desc("n"), "value")


def categories_present(counts: DataFrame) -> DataFrame:
    """Categories of the feed in label order."""
    spark = counts.sparkSession
    labels = small_table(
        spark, [(i, k, v) for i, (k, v) in enumerate(cards.CATEGORY_LABELS.items())], "ord int, value string, label string")
    return counts.filter("kind = 'category'").join(labels, "value").orderBy("ord").select("value", "label")


def write_feed(feed: DataFrame, aliases: DataFrame, now: datetime, path: str) -> None:
    """Items and works as JSON lines beside a one-row header."""
    spark = feed.sparkSession
    feed.write.mode("overwrite").json(f"{path}/items")
    aliases.select("name", "aliases").write.mode("overwrite").json(f"{path}/works")
    header = spark.range(1).select(
        F.lit(now.isoformat()).alias("builtAt"),
        F.struct(*[F.lit(v).alias(k) for k, v in cards.CATEGORY_LABELS.items()]).alias("categoryLabels"),
        F.struct(
            F.lit(MAX_DIGEST).alias("maxSources"), F.lit(BODY_TARGET).alias("bodyTarget"),
            F.lit(PRODUCT_HEADER).alias("productHeader"), F.lit(PLAIN_HEADER).alias("plainHeader"),
        ).alias("compare"),
    )
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")


# --- digests ------------------------------------------------------------------------------------
def pick_items(content: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(picked, missing) for a selection of ids: repeated ids once, request order kept, at most 20."""
    wanted = list(dict.fromkeys(i.strip() for i in ids if i.strip()))
    if not wanted or len(wanted) > MAX_DIGEST:
        raise ValueError(f"a digest takes 1 to {MAX_DIGEST} items")
    if any(i.count(":") < 1 or "/" in i or not all(i.partition(":")[::2]) for i in wanted):
        raise ValueError("invalid item id")
    picks = small_table(content.sparkSession, list(enumerate(wanted)), "pos int, content_id string")
    picked = content.filter(F.col("content_id").isin(*wanted)).join(picks, "content_id")
    return picked, picks.join(content.select("content_id"), "content_id", "left_anti")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], size: int = MAX_DIGEST) -> DataFrame:
    """The best rows of every group with their `rank`.

    The literal bound lets Spark cut every group to `size` rows before the shuffle, so a huge group is harmless.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= F.lit(size))


def digest(ranked: DataFrame, group: list[str], piece: str = "post", rank: str = "rank") -> DataFrame:
    """(group, body, reply, n): the numbered facts post and the links post of every group.

    Expects at most 20 rows per group, as `top_per_group` gives.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("k"), F.col(piece).alias("p"))))
    number = lambda i: F.concat((i + 1).cast("string"), F.lit(". "))
    facts = F.transform("_items", lambda x, i: F.concat(
        number(i), x["p"]["name"],
        F.when(x["p"]["facts"] != "", F.concat(F.lit("\n   "), x["p"]["facts"])).otherwise(""),
    ))
    links = F.filter(
        F.transform("_items", lambda x, i: F.when(
            x["p"]["url"] != "", F.concat(number(i), x["p"]["name"], F.lit("\n"), x["p"]["url"]))),
        lambda x: x.isNotNull(),
    )
    header = F.when(F.exists("_items", lambda x: x["p"]["product"]), F.lit(PRODUCT_HEADER)).otherwise(F.lit(PLAIN_HEADER))
    grouped = ranked.groupBy(*group).agg(items.alias("_items"))
    return grouped.select(
        *group,
        F.concat(F.array_join(facts, "\n"), F.lit("\n")).alias("body"),
        F.when(F.size(links) > 0, F.concat(header, F.lit("\n\n"), F.array_join(links, "\n\n"), F.lit("\n")))
        .otherwise("").alias("reply"),
        F.size("_items").alias("n"),
    )
