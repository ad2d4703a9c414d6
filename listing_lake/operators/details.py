"""Detail pages: photo, gallery and product fields, and their join with the listed items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import fields, urls
from listing_lake.functions.text import LINE_BREAK, blank_to_null, let, present, squish
from listing_lake.operators import nodes as N
from listing_lake.operators.listings import (
    PRODUCT_COLUMNS, all_photos, first_photo, flag, parsed_map, read_field, read_price, rule_map,
)

# --- fixed values: must equal the stored data's rules -------------------------------------------
FIGURE_SHOP = "FigureFarm"
FIGURE_SHOP_TITLES = ("피규어팜", "정품 피규어 쇼핑몰 피규어팜")
FIGURE_TITLE_SELECTORS = ("h1", "h2", ".product_name", ".prd_name", ".goods_name", ".item_name", ".name")
FIGURE_TITLE_STOP = "상품상세"
FIGURE_LINK_SELECTOR = 'a[href*="/shop/detail.php"], a[href*="detail.php"]'
FIGURE_LINK = r"/shop/detail\.php\?"
FIGURE_CARD_CLASS = "ffm-product-card"
PREORDER_NOTICE = "본 상품은 예약상품"
MAKER_LABEL, SIZE_LABEL = "제조사", "치수"
TITLE_FAILED = "(상품명 파싱 실패)"
TITLE_ERROR = "상품명을 찾을 수 없음"
DETAIL_ERROR = "상세 페이지 실패: "
# ------------------------------------------------------------------------------------------------


def wants_gallery(src: Column) -> Column:
    by_selector = src["detail_images_sel"].isNotNull() & (flag(src["product_mode"]) | flag(src["list_product_mode"]))
    by_rule = F.exists(src["detail_rules"], lambda r: r["field"] == "gallery")
    return by_selector | flag(by_rule)


def wants_detail(src: Column) -> Column:
    """Whether the source reads detail pages at all."""
    return (
        flag(src["product_mode"]) | flag(src["fetch_detail_image"]) | wants_gallery(src)
        | flag(F.size(src["detail_rules"]) > 0)
    )


def head_images(nodes: Column) -> Column:
    """Raw share-image links in priority order."""
    raw = lambda n: F.coalesce(blank_to_null(n["attrs"]["content"]), n["attrs"]["href"])
    return F.concat(*[
        F.transform(N.select_all(nodes, N.literal_selector(css)), raw) for css in N.HEAD_IMAGE_SELECTORS
    ])


def read_details(pages: DataFrame, now: datetime | Column, base: str = "url") -> DataFrame:
    """Adds `detail`: what a detail page says, before it meets the listed item. Expects `nodes` and `src`."""
    nodes, src, page = F.col("nodes"), F.col("src"), F.col(base)
    deny = src["image_deny_patterns"]
    text_root = F.try_element_at(N.select_all(nodes, src["product_text_sel"]), F.lit(1))
    part = F.when(src["product_text_sel"].isNull(), nodes).otherwise(
        let(text_root, lambda t: F.when(t.isNotNull(), N.below(nodes, t))))  # a hidden class of the panel itself hides nothing
    # Rules see the whole page: a root that is the page itself.
    whole = F.struct(F.lit(-1).alias("id"), (F.size(nodes) - 1).alias("last"))
    raw = pages.withColumn("_text", F.coalesce(N.visible_text(part), F.lit(""))).withColumn(
        "_selected", N.images_of(N.select_all(nodes, src["image_sel"]))
    ).withColumn("_head", head_images(nodes)).withColumn(
        "_gallery", N.images_of(N.select_all(nodes, src["detail_images_sel"]))
    ).withColumn("_mapped", F.when(F.size(src["detail_rules"]) > 0, rule_map(nodes, whole, src["detail_rules"])))
    raw = raw.withColumn("_parsed", parsed_map(F.col("_mapped"), page, src["preorder_words"]))
    m = F.col("_parsed")
    heads = F.array_compact(F.transform(F.col("_head"), lambda u: urls.photo_url(u, page, deny)))
    photo = F.coalesce(first_photo(F.col("_selected"), page, deny), F.try_element_at(heads, F.lit(1)))
    clean = lambda u: urls.photo_url(u, None, deny)
    mapped_gallery = F.array_compact(F.transform(m["gallery"]["values"], clean))
    product = fields.text_product(
        F.col("_text"), src["price_pattern"], src["preorder_words"], src["shop"], F.col("source"), now)
    return raw.withColumn("detail", F.struct(
        photo.alias("photo"),
        all_photos(F.col("_gallery"), page, deny).alias("gallery"),
        product.alias("product"),
        clean(read_field(m, "image")).alias("mapped_photo"),
        F.array_distinct(mapped_gallery).alias("mapped_gallery"),
        m["gallery"].isNotNull().alias("has_gallery_rule"),
        read_price(m, "price").alias("price"),
        read_field(m, "status").alias("status"),
        read_field(m, "deadline").alias("deadline"),
        read_field(m, "title").alias("title"),
    )).drop("_text", "_selected", "_head", "_gallery", "_mapped", "_parsed", "nodes")


def apply_details(candidates: DataFrame, details: DataFrame, now: datetime | Column) -> DataFrame:
    """Listed items with their detail page's values.

    `details` has (source, url, detail, failed), one row per listed url. Image mode takes the photo only; product mode replaces
    the product fields; gallery-only sources keep the card's price and photo; rules override field by field.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    src, d = F.col("src"), F.col("_d.detail")
    joined = candidates.join(
        details.select("source", "url", F.struct("detail", "failed").alias("_d")), ["source", "url"], "left")
    seen = F.col("_d").isNotNull() & present(F.col("url")) & wants_detail(src) & ~flag(F.col("_d.failed"))
    by_rule = seen & flag(F.size(src["detail_rules"]) > 0)
    by_mode = seen & ~by_rule
    photo = F.when(
        by_mode & (flag(src["product_mode"]) | flag(src["fetch_detail_image"])), d["photo"],
    ).when(by_rule, d["mapped_photo"])
    main = F.coalesce(photo, F.col("imageUrl"))
    gallery = (
        F.when(by_mode & wants_gallery(src), F.array_remove(d["gallery"], F.coalesce(main, F.lit(""))))
        .when(by_rule & d["has_gallery_rule"], F.array_remove(d["mapped_gallery"], F.coalesce(main, F.lit(""))))
    )
    ruled = F.when(
        by_rule & F.coalesce(d["price"].cast("string"), d["status"], d["deadline"]).isNotNull(),
        fields.product_struct(
            F.coalesce(d["price"], F.col("price")), F.coalesce(d["status"], F.col("saleStatus")),
            F.coalesce(d["deadline"], F.col("preorderEndAt")), src["shop"], F.col("source"), now,
        ),
    )
    replaced = F.coalesce(F.when(by_mode & flag(src["product_mode"]), d["product"]), ruled)
    product = {
        name: F.when(replaced.isNotNull(), replaced[name]).otherwise(F.col(name)) for name in PRODUCT_COLUMNS
    }
    failed = wants_detail(src) & flag(F.col("_d.failed"))
    out = joined.withColumns({"_photo": main, "_gallery_urls": gallery, "_product": F.struct(
        *[value.alias(name) for name, value in product.items()])})
    return (
        out.withColumn("imageUrl", F.col("_photo"))
        .withColumn("detailImageUrls", F.col("_gallery_urls"))
        .withColumn("detailCheckedAt", F.when(seen, now.cast("timestamp")))
        .withColumn("title", F.coalesce(blank_to_null(F.col("title")), F.when(by_rule, d["title"])))
        .withColumn("errors", F.when(
            failed, F.array_append(F.col("errors"), F.concat(F.lit(DETAIL_ERROR), F.col("url"))),
        ).otherwise(F.col("errors")))
        .withColumns({name: F.col(f"_product.{name}") for name in PRODUCT_COLUMNS})
        .drop("_d", "_photo", "_gallery_urls", "_product")
    )


# --- figure shop --------------------------------------------------------------------------------
def labelled_value(lines: Column, label: str) -> Column:
    """Value behind a label: the next line, or the rest of the label's own line."""
    plain = lambda x: F.trim(F.replace(x, F.lit("|"), F.lit(" ")))
    values = F.transform(
        lines,
        lambda x, i: let(plain(x), lambda line: F.when(
            (line == label) & (i + 1 < F.size(lines)), F.try_element_at(lines, i + 2),
        ).when(
            F.startswith(line, F.lit(label)),
            let(F.trim(F.substring(line, len(label) + 1, F.length(line)), F.lit(" :")), blank_to_null),
        )),
    )
    return F.coalesce(F.try_element_at(F.array_compact(values), F.lit(1)), F.lit(""))


def product_title(nodes: Column, lines: Column) -> Column:
    """Share title, else the first long heading, else the longest line naming a figure product."""
    first = lambda css: F.try_element_at(N.select_all(nodes, N.literal_selector(css)), F.lit(1))
    meta = squish(first('meta[property="og:title"]')["attrs"]["content"])
    options = [let(meta, lambda v: F.when((v != "") & ~v.isin(*FIGURE_SHOP_TITLES), v))]
    for css in FIGURE_TITLE_SELECTORS:
        value = let(first(css), lambda n: squish(N.text_of(nodes, n)))
        options.append(let(value, lambda v: F.when((F.length(v) >= 8) & (v != FIGURE_TITLE_STOP), v)))
    long_lines = F.filter(lines, lambda x: (F.length(x) >= 12) & fields.has_figure_keyword(x))
    ranked = F.array_sort(F.transform(
        long_lines, lambda x, i: F.struct((-F.length(x)).alias("k"), i.alias("i"), x.alias("line"))))
    return F.coalesce(*options, F.try_element_at(ranked, F.lit(1))["line"], F.lit(""))


def figure_products(pages: DataFrame, now: datetime | Column, base: str = "url", figure_only: bool = True) -> DataFrame:
    """Product rows of figure-shop detail pages. Expects (source, url, nodes, src)."""
    now = now if isinstance(now, Column) else F.lit(now)
    nodes, src, page = F.col("nodes"), F.col("src"), F.col(base)
    deny = src["image_deny_patterns"]
    text = pages.withColumn("_text", N.joined_text(nodes, "\n"))
    # A text run may itself hold line breaks, so lines come from the joined text.
    lines = F.filter(F.transform(F.split("_text", LINE_BREAK), squish), lambda x: x != "")
    read = (
        text.withColumn("_lines", lines)
        .withColumn("title", product_title(nodes, F.col("_lines")))
        .withColumn("_selected", N.images_of(N.select_all(nodes, src["image_sel"])))
        .withColumn("_head", head_images(nodes))
        .withColumn("_gallery", N.images_of(N.select_all(nodes, src["detail_images_sel"])))
        .withColumn("preorderEndAt", fields.labelled_deadline(F.col("_text")))
        .withColumn("price", fields.plausible_price(F.col("_text")))
    )
    heads = F.array_compact(F.transform(F.col("_head"), lambda u: urls.photo_url(u, page, deny)))
    read = read.withColumn(
        "imageUrl", F.coalesce(first_photo(F.col("_selected"), page, deny), F.try_element_at(heads, F.lit(1))))
    if figure_only:
        read = read.filter((F.col("title") == "") | fields.has_figure_keyword(F.col("title")))
    named = F.col("title") != ""
    sold_out = F.contains(F.upper("_text"), F.lit("SOLD OUT")) | F.contains(F.col("_text"), F.lit("품절"))
    preorder = F.contains(F.col("_text"), F.lit(PREORDER_NOTICE)) | F.col("preorderEndAt").isNotNull()
    status = F.when(sold_out, "SOLD_OUT").when(preorder, "PREORDER").otherwise("IN_STOCK")
    only = lambda c: F.when(named, c)
    return read.select(
        "source", page.alias("url"),
        F.when(named, F.col("title")).otherwise(TITLE_FAILED).alias("title"),
        only(F.lit("PRODUCT")).alias("entityType"), only(F.lit(FIGURE_SHOP)).alias("shop"),
        only(status).alias("saleStatus"), only(F.col("preorderEndAt")).alias("preorderEndAt"),
        only(fields.release_window(F.col("title"))).alias("releaseWindowText"),
        only(labelled_value(F.col("_lines"), MAKER_LABEL)).alias("manufacturer"),
        only(labelled_value(F.col("_lines"), SIZE_LABEL)).alias("sizeText"),
        only(F.col("price")).alias("price"),
        only(F.when(F.col("price").isNotNull(), F.lit("KRW"))).alias("currency"),
        only(F.col("imageUrl")).alias("imageUrl"),
        only(F.when(src["detail_images_sel"].isNotNull(), F.array_remove(
            all_photos(F.col("_gallery"), page, deny), F.coalesce(F.col("imageUrl"), F.lit("")),
        ))).alias("detailImageUrls"),
        only(now.cast("timestamp")).alias("productCheckedAt"),
        F.when(named, F.array().cast("array<string>")).otherwise(F.array(F.lit(TITLE_ERROR))).alias("errors"),
    )


def figure_links(pages: DataFrame, figure_only: bool = True) -> DataFrame:
    """Detail links of a figure-shop listing with the card's title; known non-figures are left out.

    Expects (source, page_no, url, nodes). The item limit counts links before the keyword test, so `listed_rank`
    order (page_no, pos) is kept for it.
    """
    nodes = F.col("nodes")
    sel = N.literal_selector(FIGURE_LINK_SELECTOR)
    name_sel = N.literal_selector(".name")

    cards = F.filter(nodes, lambda a: F.array_contains(F.split(F.coalesce(a["attrs"]["class"], F.lit("")), r"\s+"), FIGURE_CARD_CLASS))

    def one(n: Column, cards: Column) -> Column:
        card = F.try_element_at(F.filter(cards, lambda a: (a["id"] < n["id"]) & (a["last"] >= n["id"])), F.lit(-1))
        name = let(card, lambda c: F.try_element_at(N.select_in(nodes, c, name_sel), F.lit(1)))
        return F.struct(
            n["id"].alias("pos"), n["link"].alias("link"),
            F.coalesce(let(name, lambda n: squish(N.text_of(nodes, n))), F.lit("")).alias("list_title"),
        )

    picked = F.filter(nodes, lambda n: flag(n["attrs"]["href"] != "") & N.matches(n, sel))
    out = (
        pages.select("source", "page_no", F.explode(let(cards, lambda c: F.transform(picked, lambda n: one(n, c)))).alias("_l"))
        .select("source", "page_no", F.col("_l.pos").alias("pos"), urls.normalize_url(F.col("_l.link")).alias("url"),
                F.col("_l.list_title").alias("list_title"))
        .filter(F.col("url").rlike(FIGURE_LINK))
    )
    keep = (F.col("list_title") == "") | fields.has_figure_keyword(F.col("list_title"))
    return out.withColumn("is_candidate", keep if figure_only else F.lit(True))
