"""Manual submissions and cards rendered in a browser, as candidate rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import fields, urls
from listing_lake.functions.text import LINE_BREAK, blank_to_null, let, once, squish, strip
from listing_lake.operators.listings import PRODUCT_COLUMNS, flag
from listing_lake.operators.nodes import MIN_SIDE

# --- fixed values: must equal the stored data's rules -------------------------------------------
MANUAL_SOURCE = "수동 입력"
TITLE_LENGTH, SUMMARY_LENGTH, MIN_TITLE = 300, 500, 4
# ------------------------------------------------------------------------------------------------


def manual_entries(intake: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejects) of submissions (url, title, category, angle, tier, image_url, seq)."""
    image = strip(F.coalesce("image_url", F.lit("")))
    url = urls.normalize_url(F.col("url"))
    bad_image = (image != "") & urls.http_url(image).isNull()
    marked = intake.withColumn("_url", url).withColumn("reject_reason", F.when(
        F.col("_url").isNull(), F.lit("url")).when(bad_image, F.lit("image")))
    shop = F.when(F.col("category") == "FIGURE", urls.manual_shop(F.col("_url")))
    good = marked.filter(F.col("reject_reason").isNull()).withColumn("_shop", shop)
    is_shop = F.col("_shop").isNotNull()
    candidates = good.select(
        "seq", F.col("_url").alias("url"),
        F.coalesce(blank_to_null(strip(F.col("title"))), F.lit(urls.UNTITLED)).alias("title"), F.lit("").alias("summary"),
        F.coalesce("_shop.source", F.lit(MANUAL_SOURCE)).alias("source"),
        F.when(is_shop, "manual_product").otherwise("manual").alias("sourceType"),
        "category", F.col("angle").alias("contentAngle"), F.coalesce("tier", F.lit("MEDIA")).alias("sourceTier"),
        F.when(is_shop, "PRODUCT").alias("entityType"), F.col("_shop.shop").alias("shop"),
        F.when(is_shop, "UNKNOWN").alias("saleStatus"), blank_to_null(image).alias("imageUrl"), F.lit("").alias("note"),
        F.lit(None).cast("timestamp").alias("postedAt"), F.lit(None).cast("string").alias("publishedAt"),
    )
    return candidates, marked.filter(F.col("reject_reason").isNotNull()).select(*intake.columns, "reject_reason")


def card_title(link_text: Column, context_text: Column) -> Column:
    """The link's own text, else the first long line around it, else the placeholder."""
    lines = F.transform(F.split(context_text, LINE_BREAK), squish)
    line = F.try_element_at(F.filter(lines, lambda x: F.length(x) >= MIN_TITLE), F.lit(1))
    own = let(squish(link_text), lambda v: F.when(F.length(v) >= MIN_TITLE, v))
    return F.coalesce(F.substring(own, 1, TITLE_LENGTH), F.substring(line, 1, TITLE_LENGTH), F.lit(urls.UNTITLED))


def card_image(images: Column, base: Column, deny: Column) -> Column:
    """First photo of array<struct<lazy, src, width, height>>; small known sizes are icons."""
    side = lambda v: (F.coalesce(v, F.lit(0)) > 0) & (F.coalesce(v, F.lit(0)) < MIN_SIDE)
    large = F.filter(images, lambda i: ~(side(i["width"]) & side(i["height"])))
    links = F.transform(large, lambda i: urls.photo_url(F.coalesce(blank_to_null(i["lazy"]), i["src"]), base, deny))
    return F.try_element_at(F.array_compact(links), F.lit(1))


def rendered_cards(cards: DataFrame, now: datetime | Column, base: str = "page_url") -> DataFrame:
    """Candidates of browser-visible cards.

    `cards` is (source, page_no, pos, page_url, href, data_href, data_url, onclick, link_text, context_text, images, src).
    """
    src, page = F.col("src"), F.col(base)
    url = urls.click_url(F.col("href"), F.col("data_href"), F.col("data_url"), F.col("onclick"), page)
    rows = once(cards.drop("url"), url=url).filter(F.col("url").isNotNull())
    context = F.coalesce("context_text", F.lit(""))
    searchable = F.concat("url", F.lit("\n"), context)
    none = F.array().cast("array<string>")
    rows = rows.filter(
        urls.allowed(F.col("url"), src["allow_patterns"], src["deny_patterns"], ignore_case=True)
        & urls.allowed(searchable, src["required_text_patterns"], none, ignore_case=True))
    products = flag(src["product_mode"])
    product = F.when(products, fields.text_product(
        context, src["price_pattern"], src["preorder_words"], src["shop"], F.col("source"), now))
    image = F.when(
        products | src["list_image_sel"].isNotNull(), card_image(F.col("images"), page, src["image_deny_patterns"]))
    return rows.withColumn("_product", product).select(
        "source", "page_no", "pos", "src", "url", card_title(F.col("link_text"), context).alias("title"),
        F.substring(squish(context), 1, SUMMARY_LENGTH).alias("summary"), F.lit(None).cast("string").alias("publishedAt"),
        image.alias("imageUrl"), *[F.col(f"_product.{name}").alias(name) for name in PRODUCT_COLUMNS],
        F.array().cast("array<string>").alias("errors"),
    )
