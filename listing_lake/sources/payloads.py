"""Feed documents and API payloads, one row per fetched document, to candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import urls
from listing_lake.functions.text import blank_to_null, let, once, strip
from listing_lake.operators import nodes as N
from listing_lake.operators.listings import first_photo
from listing_lake.operators.shred import shred_pages

# --- fixed values: must equal the stored data's rules -------------------------------------------
SUMMARY_LENGTH = 500
UNTITLED_ENTRY = "(untitled)"
FEED_ERROR = "RSS 해석 실패"
JSON_ERROR = "JSON 해석 실패"
# ------------------------------------------------------------------------------------------------

_ENTRY = (
    "title string, link array<struct<_VALUE string, _href string, _rel string>>, guid struct<_VALUE string, _isPermaLink string>,"
    " description string, summary string, encoded string, content string, pubDate string, published string, updated string, date string"
)
# The corrupt-record field must come last: elsewhere Spark mixes up the fields of a broken document.
ENTRY = f"{_ENTRY}, _broken string"
FEED = f"channel struct<item array<struct<{_ENTRY}>>>, item array<struct<{_ENTRY}>>, entry array<struct<{_ENTRY}>>, _broken string"
XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_broken"}
ENTRY_TEXT = r"(?s)<(item|entry)(?:\s[^>]*)?>.*?</\1\s*>"
# An ampersand that starts no reference XML knows.
LOOSE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"


def _feed_entry(x: Column) -> Column:
    """Title, link, summary and date of an entry of any feed kind."""
    plain = F.filter(x["link"], lambda l: strip(F.coalesce(l["_VALUE"], F.lit(""))) != "")
    target = F.filter(x["link"], lambda l: (F.coalesce(l["_rel"], F.lit("alternate")) == "alternate") & l["_href"].isNotNull())
    permanent = F.when(F.lower(F.coalesce(x["guid"]["_isPermaLink"], F.lit("true"))) != "false", x["guid"]["_VALUE"])
    text = [blank_to_null(x[name]) for name in ("description", "summary", "encoded", "content")]
    date = [blank_to_null(x[name]) for name in ("pubDate", "published", "updated", "date")]
    return F.struct(
        x["title"].alias("title"),
        F.coalesce(F.try_element_at(plain, F.lit(1))["_VALUE"], F.try_element_at(target, F.lit(1))["_href"], permanent).alias("link"),
        F.coalesce(*text).alias("summary"), F.coalesce(*date).alias("published"))


def parse_feeds(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Adds `entries` and `error` to every feed document and drops its text.

    Entries of a document that is not well formed are read one by one, with loose ampersands escaped where that helps; `error` is
    set when none can be read. A missing body is an error, an empty feed is not.
    """
    text = payloads.withColumn("_text", strip(F.col(body))).drop(body)
    read = text.withColumn("_doc", F.from_xml("_text", FEED, XML_OPTIONS))
    broken = F.col("_doc._broken").isNotNull()
    cut = F.when(broken, F.regexp_extract_all("_text", F.lit(ENTRY_TEXT), F.lit(0)))
    none = F.array().cast(f"array<struct<{_ENTRY}>>")
    whole = F.concat(*[F.coalesce(F.col(f"_doc.{at}"), none) for at in ("channel.item", "item", "entry")])

    def alone(part: Column) -> Column:
        strict = F.from_xml(part, ENTRY, XML_OPTIONS)
        loose = F.from_xml(F.regexp_replace(part, LOOSE_AMPERSAND, "&amp;"), ENTRY, XML_OPTIONS)
        return let(strict, lambda x: F.when(x["_broken"].isNull(), x).otherwise(loose))

    singles = F.filter(F.transform(cut, alone), lambda x: x["_broken"].isNull())
    parsed = read.withColumn("_parts", singles).withColumn("entries", F.when(
        broken, F.transform("_parts", _feed_entry)).otherwise(F.transform(whole, _feed_entry)))
    failed = F.col("_text").isNull() | (broken & (F.size("entries") == 0))
    return parsed.withColumn("error", F.when(failed, F.lit(FEED_ERROR))).drop("_text", "_doc", "_parts")


def feed_entries(parsed: DataFrame, base: str = "url") -> DataFrame:
    """One row per entry of parsed feeds; entries without a usable link are skipped. The order of appearance is (page_no, pos)."""
    kept = [c for c in parsed.columns if c not in ("entries", "error", base)]
    # An inner explode would filter by the entries first and so read every document twice; entries of none have no link.
    rows = parsed.select(*kept, base, F.posexplode_outer("entries").alias("pos", "_e"))
    link = F.when(F.col("_e.link") != "", urls.normalize_url(F.col("_e.link"), F.col(base)))
    return once(rows, _url=link).filter(F.col("_url").isNotNull()).select(
        *kept, "pos", F.col("_url").alias("url"),
        F.coalesce(blank_to_null(F.col("_e.title")), F.lit(UNTITLED_ENTRY)).alias("title"),
        F.substring(F.coalesce("_e.summary", F.lit("")), 1, SUMMARY_LENGTH).alias("summary"),
        F.col("_e.published").alias("publishedAt"),
    )


def feed_failures(parsed: DataFrame) -> DataFrame:
    """The documents of parsed feeds that could not be read, with `error`."""
    return parsed.filter("error is not null").drop("entries")


def read_feed_xml(payloads: DataFrame, body: str = "body", base: str = "url") -> DataFrame:
    """Entries of RSS and Atom documents (source, url, body), with page_no when a source has several."""
    return feed_entries(parse_feeds(payloads, body), base)


def json_path(dotted: Column) -> Column:
    """Variant path of a dotted path; a numeric step is an array index."""
    steps = F.transform(
        F.split(dotted, r"\."),
        lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(F.lit("."), s)),
    )
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def dig(value: Column, dotted: Column, kind: str = "string") -> Column:
    """Value at a dotted path, null when a step is missing."""
    return F.when(dotted.isNotNull() & (dotted != ""), F.try_variant_get(value, json_path(dotted), kind))


def read_json_payloads(payloads: DataFrame, body: str = "body", base: str = "url") -> DataFrame:
    """Entries of API payloads with the options of each row's struct `api`.

    `api` has items_path, id_field, title_field, date_field, date_pattern, summary_field, detail_url_template, image_field,
    image_html_field and image_deny_patterns. Rows without title or id are skipped; nothing is deduplicated.
    """
    api, entry = F.col("api"), F.col("_e")
    parsed = F.try_parse_json(F.col(body))
    items = F.when(
        F.coalesce(F.length(api["items_path"]), F.lit(0)) > 0,
        F.try_variant_get(parsed, json_path(api["items_path"]), "array<variant>"),
    ).otherwise(F.try_variant_get(parsed, "$", "array<variant>"))
    kept = [c for c in payloads.columns if c not in (body, base)]
    rows = payloads.select(*kept, F.col(base).alias("_base"), F.posexplode(items).alias("pos", "_e"))
    item_id, title = dig(entry, api["id_field"]), dig(entry, api["title_field"])
    date = dig(entry, api["date_field"])
    day = F.date_format(F.try_to_timestamp(date, api["date_pattern"]), "yyyy-MM-dd")
    url = urls.normalize_url(F.replace(api["detail_url_template"], F.lit("{id}"), item_id), F.col("_base"))
    typed = rows.select(
        *kept, "pos", url.alias("url"), title.alias("title"),
        F.when(F.coalesce(F.length(api["date_pattern"]), F.lit(0)) > 0, F.coalesce(day, date)).otherwise(date).alias("publishedAt"),
        F.when(api["summary_field"].isNotNull(), F.substring(
            F.coalesce(dig(entry, api["summary_field"]), F.lit("")), 1, SUMMARY_LENGTH)).alias("summary"),
        urls.photo_url(dig(entry, api["image_field"]), url, api["image_deny_patterns"]).alias("_image"),
        dig(entry, api["image_html_field"]).alias("_html"),
    ).filter((F.col("title") != "") & F.col("url").isNotNull())
    return typed


def with_entry_image(entries: DataFrame) -> DataFrame:
    """Adds imageUrl: the image field, else the first usable image of the entry's HTML.

    Only this step runs the page shredder; sources without an HTML field do not need it.
    """
    shredded = shred_pages(entries, html="_html")
    images = N.images_of(N.select_all(F.col("nodes"), N.literal_selector("img")))
    found = shredded.withColumn("_images", images)
    return found.withColumn("imageUrl", F.coalesce(
        "_image", first_photo(F.col("_images"), F.col("url"), F.col("api.image_deny_patterns")),
    )).drop("_image", "_images", "nodes", "_html")


def json_failures(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Payloads (source, page_no, url, body) that are no JSON, with `error`."""
    return payloads.filter(F.try_parse_json(F.col(body)).isNull()).withColumn("error", F.lit(JSON_ERROR)).drop(body)


def without_entry_image(entries: DataFrame) -> DataFrame:
    return entries.withColumnRenamed("_image", "imageUrl").drop("_html")


def page_count_stop(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Payload pages a crawl would read: none beyond the reported page count, none from the first empty page on."""
    api = F.col("api")
    parsed = F.try_parse_json(F.col(body))
    items = F.when(
        F.coalesce(F.length(api["items_path"]), F.lit(0)) > 0,
        F.try_variant_get(parsed, json_path(api["items_path"]), "array<variant>"),
    ).otherwise(F.try_variant_get(parsed, "$", "array<variant>"))
    count = dig(parsed, api["page_count_field"], "bigint")
    sized = payloads.withColumn("_empty", F.coalesce(F.size(items), F.lit(0)) <= 0).withColumn("_count", count)
    # A page that reports a count at or below its own number is the last one.
    ends = sized.groupBy("source").agg(
        F.min(F.when(F.col("_empty"), F.col("page_no"))).alias("_first_empty"),
        F.min(F.when(F.col("page_no") >= F.col("_count"), F.col("page_no"))).alias("_last"),
    )
    return (
        payloads.join(ends, "source")
        .filter(F.col("_first_empty").isNull() | (F.col("page_no") < F.col("_first_empty")))
        .filter(F.col("_last").isNull() | (F.col("page_no") <= F.col("_last")))
        .drop("_first_empty", "_last")
    )
