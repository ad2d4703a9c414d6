"""Listing pages to candidate rows: links or mapped cards, one row per listed item."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import fields, urls
from listing_lake.functions.text import blank_to_null, let, once, present, squish, strip
from listing_lake.operators import nodes as N

# --- fixed values: must equal the stored data's rules -------------------------------------------
DEFAULT_LINK_SELECTOR = "a[href]"
DEFAULT_MIN_TITLE = 4
LINK_ATTRS = ("href", *urls.LAZY_ATTRS)
# ------------------------------------------------------------------------------------------------

VALUES = "array<struct<v:string,is_url:boolean>>"
PRODUCT_COLUMNS = ("entityType", "shop", "saleStatus", "price", "currency", "preorderEndAt", "productCheckedAt")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rule_values(nodes: Column, root: Column, rule: Column) -> Column:
    """Raw values of one extract rule inside `root`: all of them when `many`, else the first non-empty one."""
    is_link = rule["attr"].isin(*LINK_ATTRS)

    def value(n: Column) -> Column:
        by_attr = F.coalesce(n["attrs"][rule["attr"]], F.lit(""))
        by_text = F.when(n["tag"] == "img", strip(F.coalesce(n["attrs"]["alt"], F.lit("")))).otherwise(N.text_of(nodes, n))
        own = F.when(is_link, by_attr).otherwise(strip(by_attr))
        # Text stands in for a missing attribute rule, and for an empty attribute outside galleries.
        return let(own, lambda v: let(
            rule["attr"].isNull() | (~rule["many"] & (v == "")),
            lambda by: F.struct(F.when(by, by_text).otherwise(v).alias("v"), (flag(is_link) & ~by).alias("is_url")),
        ))

    found = F.filter(F.transform(N.select_in(nodes, root, rule["sel"]), value), lambda x: x["v"] != "")
    return let(found, lambda v: F.when(rule["many"], v).otherwise(F.slice(v, 1, 1)))


def rule_map(nodes: Column, root: Column, rules: Column) -> Column:
    """map field -> struct(parse, values) of all rules of a section."""
    return F.map_from_entries(F.transform(
        rules,
        lambda r: F.struct(
            r["field"].alias("key"),
            F.struct(r["parse"].alias("parse"), rule_values(nodes, root, r).alias("values")).alias("value"),
        ),
    ))


def parsed_map(fields_map: Column, base: Column, preorder: Column) -> Column:
    """map field -> struct(parse, raw, values): links made absolute, then values parsed by the rule's kind."""
    absolute = lambda x: F.when(x["is_url"], urls.resolve(x["v"], base)).otherwise(x["v"])
    return F.transform_values(
        fields_map,
        lambda _, f: let(F.transform(f["values"], absolute), lambda raw: F.struct(
            f["parse"].alias("parse"), raw.alias("raw"),
            F.transform(raw, lambda v: fields.by_parse_kind(f["parse"], v, preorder)).alias("values"),
        )),
    )


def read_field(parsed: Column, name: str) -> Column:
    """Parsed first value of a field as text, null when the page has none."""
    return F.try_element_at(parsed[name]["values"], F.lit(1))


def read_price(parsed: Column, name: str) -> Column:
    """A price counts only when its rule parses amounts."""
    return F.when(parsed[name]["parse"] == "krw", read_field(parsed, name)).try_cast("bigint")


def first_photo(candidates: Column, base: Column, deny: Column) -> Column:
    """First usable photo link of array<array<raw link>>."""
    return F.try_element_at(all_photos(candidates, base, deny), F.lit(1))


def all_photos(candidates: Column, base: Column, deny: Column) -> Column:
    """Distinct photo links, one per image, in document order."""
    one = lambda raw: F.try_element_at(
        F.array_compact(F.transform(raw, lambda u: urls.photo_url(u, base, deny))), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(candidates, one)))


def _card_text(nodes: Column, n: Column, with_alt: Column) -> Column:
    alts = F.transform(
        F.filter(N.below(nodes, n), lambda x: x["tag"] == "img"), lambda x: F.coalesce(x["attrs"]["alt"], F.lit("")),
    )
    tail = F.when(flag(with_alt), F.concat(F.lit(" "), F.array_join(alts, " "))).otherwise("")
    return squish(F.concat(N.text_of(nodes, n), tail))


def with_links(pages: DataFrame) -> DataFrame:
    """Adds `links`: id, comparison key and card of every link the source's selector picks.

    Expects `nodes` and the source struct `src`.
    """
    nodes, src = F.col("nodes"), F.col("src")
    sel = F.coalesce(src["link_sel"], N.literal_selector(DEFAULT_LINK_SELECTOR))
    is_link = lambda n: flag(n["attrs"]["href"] != "") & n["link"].isNotNull() & N.matches(n, sel)
    links = F.transform(
        F.filter(nodes, is_link),
        lambda n: F.struct(n["id"].alias("id"), F.split_part(n["link"], F.lit("#"), F.lit(1)).alias("key")),
    )
    wants_card = src["list_image_sel"].isNotNull() | flag(src["list_product_mode"])
    # Rules for details alone list nothing.
    by_link = src["list_item_sel"].isNull() & ~flag(F.size(src["detail_rules"]) > 0)
    found = pages.withColumn("_links", F.when(by_link, links)).withColumn("_gaps", N.with_gaps(F.col("_links"), F.size(nodes)))
    keyed = F.transform(
        F.col("_gaps"),
        lambda k: F.struct(
            k["id"].alias("id"), k["key"].alias("key"),
            F.when(wants_card, N.card_of(nodes, k)).alias("card"),
        ),
    )
    return found.withColumn("links", keyed).drop("_links", "_gaps")


def raw_listings(pages: DataFrame) -> DataFrame:
    """One row per link or mapped card with its raw strings; the page's node array stays behind."""
    nodes, src = F.col("nodes"), F.col("src")

    def from_link(k: Column) -> Column:
        return let(N.node(nodes, k["id"]), lambda n: let(N.node(nodes, k["card"]), lambda card: one_link(k, n, card)))

    def one_link(k: Column, n: Column, card: Column) -> Column:
        title_node = F.when(src["title_sel"].isNull(), n).otherwise(
            F.try_element_at(N.select_in(nodes, n, src["title_sel"]), F.lit(1)))
        date_node = F.try_element_at(N.select_in(nodes, n, src["published_sel"]), F.lit(1))
        products, photos = flag(src["list_product_mode"]), src["list_image_sel"].isNotNull()
        return F.struct(
            k["id"].alias("pos"),
            n["link"].alias("link"),
            let(title_node, lambda t: F.when(t.isNotNull(), squish(N.text_of(nodes, t)))).alias("title"),
            F.when(products, _card_text(nodes, n, src["card_alt_text"])).alias("own_text"),
            F.when(products & card.isNotNull(), _card_text(nodes, card, src["card_alt_text"])).alias("card_text"),
            F.when(photos, N.images_of(N.select_in(nodes, n, src["list_image_sel"]))).alias("own_images"),
            F.when(photos & card.isNotNull(), N.images_of(N.select_in(nodes, card, src["list_image_sel"]))).alias("card_images"),
            let(date_node, lambda t: F.when(t.isNotNull(), F.coalesce(
                blank_to_null(t["attrs"]["datetime"]), N.text_of(nodes, t)))).alias("date_text"),
            F.lit(None).cast(f"map<string,struct<parse:string,values:{VALUES}>>").alias("mapped"),
        )

    def from_card(card: Column) -> Column:
        text = F.lit(None).cast("string")
        images = F.lit(None).cast("array<array<string>>")
        return F.struct(
            card["id"].alias("pos"), text.alias("link"), text.alias("title"), text.alias("own_text"),
            text.alias("card_text"), images.alias("own_images"), images.alias("card_images"), text.alias("date_text"),
            rule_map(nodes, card, src["list_rules"]).alias("mapped"),
        )

    found = F.when(
        src["list_item_sel"].isNull(), F.transform(F.col("links"), from_link),
    ).otherwise(F.transform(N.select_all(nodes, src["list_item_sel"]), from_card))
    kept = [c for c in pages.columns if c not in ("nodes", "links")]
    # An inner explode would filter by what is found first and so look for it twice.
    return pages.select(*kept, F.explode_outer(found).alias("_f")).filter("_f.pos is not null").select(*kept, "_f.*")


def extract_listings(pages: DataFrame, now: datetime | Column, base: str = "url") -> DataFrame:
    """Typed candidates of listing pages.

    `pages` holds (source, page_no, url, nodes, src). The result keeps source, page_no and pos as the order of
    appearance; nothing is shuffled here.
    """
    src, page, m = F.col("src"), F.col(base), F.col("parsed")
    raw = raw_listings(with_links(pages))
    raw = once(raw, parsed=parsed_map(F.col("mapped"), page, src["preorder_words"])).drop("mapped")
    is_mapped = m.isNotNull()
    stripped = F.when(
        present(src["title_strip_pattern"]),
        strip(F.regexp_replace(F.col("title"), src["title_strip_pattern"], F.lit(""))),
    ).otherwise(F.col("title"))
    link = F.when(is_mapped, read_field(m, "link")).otherwise(F.col("link"))
    typed = (
        once(raw, listed_url=urls.normalize_url(link, page), listed_title=F.when(is_mapped, read_field(m, "title")).otherwise(stripped))
        .filter(
            F.col("listed_url").isNotNull() & present(F.col("listed_title"))
            & urls.allowed(F.col("listed_url"), src["allow_patterns"], src["deny_patterns"])
            & (F.length("listed_title") >= F.coalesce(src["min_title_length"], F.lit(DEFAULT_MIN_TITLE)))
            & urls.allowed(F.col("listed_title"), F.array().cast("array<string>"), src["title_deny_patterns"])
        )
    )
    # The link's own image and text come first, then its card's.
    none = F.array().cast("array<array<string>>")
    images = F.when(
        is_mapped, F.array(F.array(F.try_element_at(m["image"]["values"], F.lit(1)))),
    ).otherwise(F.concat(F.coalesce("own_images", none), F.coalesce("card_images", none)))
    by_text = F.array_compact(F.transform(F.array("own_text", "card_text"), lambda t: F.when(
        t.isNotNull(),
        fields.text_product(t, src["price_pattern"], src["preorder_words"], src["shop"], F.col("source"), now))))
    by_rule = fields.product_struct(
        read_price(m, "price"), read_field(m, "status"), read_field(m, "deadline"), src["shop"], F.col("source"), now)
    product = F.when(is_mapped, by_rule).otherwise(F.try_element_at(by_text, F.lit(1)))
    published = fields.published_value(F.col("date_text"), src["published_pattern"], now)
    return (
        typed
        .withColumn("_product", product)
        .withColumn("_published", published)
        .select(
            *[c for c in pages.columns if c not in ("nodes", "src", base)], "src", "pos",
            F.col("listed_url").alias("url"), F.col("listed_title").alias("title"),
            F.when(is_mapped, read_field(m, "published")).otherwise(F.col("_published.value")).alias("publishedAt"),
            first_photo(images, page, src["image_deny_patterns"]).alias("imageUrl"),
            *[F.col(f"_product.{name}").alias(name) for name in PRODUCT_COLUMNS],
            F.array_compact(F.array(F.col("_published.error"))).alias("errors"),
        )
    )


def empty_listings(pages: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("source", "page_no")) -> DataFrame:
    """Listing pages that gave no item at all."""
    return pages.select(*keys).join(candidates.select(*keys).distinct(), list(keys), "left_anti")
