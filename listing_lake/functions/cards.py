"""Scores, captions and the card view of one stored listing, as expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import fields, urls
from listing_lake.functions.text import blank_to_null, let, rstrip, squish, strip

# --- fixed values: must equal the stored data's rules -------------------------------------------
CATEGORY_LABELS = {
    "ANIME": "애니", "CHARACTER": "캐릭터", "FIGURE": "피규어", "GOODS": "굿즈",
    "COLLECTION": "컬렉션", "FESTIVAL": "페스티벌", "UNKNOWN": "미분류",
}
STATUS_LABELS = {"NEW": "새 항목", "KEEP": "채택", "HOLD": "보류", "IGNORE": "무시"}
ANGLE_LABELS = {
    "NEWS": "뉴스", "COMPARE": "비교", "SIZE": "크기", "PRICE": "가격",
    "QUESTION": "질문/고민", "GUIDE": "가이드", "COLLECTION": "컬렉션",
}
TIER_LABELS = {"OFFICIAL": "공식", "MEDIA": "미디어"}
REGION_LABELS = {"JP": "일본", "KR": "국내", "US": "미국", "CN": "중국"}
LANGUAGE_TAGS = {"en": "EN", "ja": "JA", "zh": "CH", "zh-cn": "CH", "zh-tw": "CH", "ko": "KO"}
SALE_STATUS_LABELS = {"PREORDER": "예약중", "IN_STOCK": "판매중", "SOLD_OUT": "품절", "UNKNOWN": "상태 미확인"}
LIMITED_KEYWORDS = ("한정판", "한정수량", "한정 수량", "한정발매", "한정 발매", "限定")
FRESHNESS_HOURS = 216
FRESHNESS_TENTHS = 350
BONUS_TENTHS = {"공식 소스": 60, "국내": 40, "예약 임박": 30, "한정판": 30}
FRESHNESS_LABEL = "신선도"
POST_URL_LENGTH = 23
BRACKETED = r"[\[【『「][^\]】』」]*[\]】』」]"
EDGE_MARKS = " -·|,/"
ZONE = "Asia/Seoul"
# ------------------------------------------------------------------------------------------------

# How a row without any date renders; it sorts after every dated row.
NO_DATE = "0001-01-01T00:00:00+00:00"
_MICROS_PER_HOUR = 3_600_000_000


def label(c: Column, labels: dict[str, str]) -> Column:
    """Display label of a code; an unknown code shows itself."""
    out = c
    for code, text in reversed(labels.items()):
        out = F.when(c == code, F.lit(text)).otherwise(out)
    return out


def effective_at(published: Column, collected: Column) -> Column:
    """Published time, else collection time; null sorts as the oldest."""
    return F.coalesce(fields.published_at(published), collected)


def _kst_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def new_today(collected: Column, now: Column) -> Column:
    return F.coalesce(_kst_day(collected) == _kst_day(now), F.lit(False))


def kst_minute(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyy-MM-dd HH:mm")


def freshness_tenths(effective: Column, now: Column) -> Column:
    """Freshness points in tenths, half up, from 35.0 at age zero down to 0 at 216 hours.

    Whole-number arithmetic on microseconds, so every engine gives the same tenth.
    """
    horizon = FRESHNESS_HOURS * _MICROS_PER_HOUR

    def tenths(age: Column) -> Column:
        doubled = (horizon - age) * (2 * FRESHNESS_TENTHS) + horizon
        return F.when(age < horizon, ((doubled - doubled % (2 * horizon)) / (2 * horizon)).cast("bigint"))

    age = F.unix_micros(now) - F.unix_micros(effective)
    return let(F.when(age < 0, F.lit(0)).otherwise(age), tenths)


def score_components(item: dict[str, Column], now: Column) -> Column:
    """array<struct<label, tenths>> of the contributions above zero, in a fixed order."""
    product = F.coalesce(item["entityType"] == "PRODUCT", F.lit(False))
    titles = F.concat_ws(" ", item["title"], item["titleKo"])
    limited = F.lit(False)
    for word in LIMITED_KEYWORDS:
        limited = limited | F.contains(titles, F.lit(word))
    points = [
        (FRESHNESS_LABEL, freshness_tenths(effective_at(item["publishedAt"], item["collectedAt"]), now)),
        ("공식 소스", F.when(item["sourceTier"] == "OFFICIAL", BONUS_TENTHS["공식 소스"])),
        ("국내", F.when(item["region"] == "KR", BONUS_TENTHS["국내"])),
        ("예약 임박", F.when(product & (item["saleStatus"] == "PREORDER"), BONUS_TENTHS["예약 임박"])),
        ("한정판", F.when(product & limited, BONUS_TENTHS["한정판"])),
    ]
    structs = [F.struct(F.lit(name).alias("label"), value.cast("bigint").alias("tenths")) for name, value in points]
    return F.filter(F.array(*structs), lambda p: p.tenths.isNotNull())


def score_of(components: Column) -> Column:
    """Total of the components as a number with one decimal."""
    return F.aggregate(components, F.lit(0).cast("bigint"), lambda s, p: s + p.tenths) / F.lit(10.0)


def breakdown_of(components: Column) -> Column:
    """array<struct<label, points>> by points, equal points in component order."""
    ranked = F.transform(
        components,
        lambda p, i: F.struct((-p.tenths).alias("k"), i.alias("i"), p.label.alias("label"), p.tenths.alias("tenths")),
    )
    return F.transform(
        F.array_sort(ranked),
        lambda p: F.struct(p.label.alias("label"), (p.tenths / F.lit(10.0)).alias("points")),
    )


def signals(tier: Column, is_new: Column) -> Column:
    return F.array_compact(F.array(F.when(tier == "OFFICIAL", F.lit("OFFICIAL")), F.when(is_new, F.lit("NEW"))))


def date_caption(published_raw: Column, collected: Column) -> Column:
    short = F.length(strip(published_raw)) <= 10

    def shown(published: Column) -> Column:
        text = F.when(short, F.date_format(published, "yyyy-MM-dd")).otherwise(kst_minute(published))
        return F.concat(F.lit("게시 "), text)

    return F.concat_ws(
        " · ", let(fields.published_at(published_raw), shown), F.concat(F.lit("수집 "), kst_minute(collected)))


def summary_preview(summary: Column, length: int = 120) -> Column:
    return let(F.coalesce(strip(summary), F.lit("")), lambda value: F.when(F.length(value) <= length, value).otherwise(
        F.concat(rstrip(F.substring(value, 1, length)), F.lit("…"))
    ))


def price_text(entity: Column, price: Column, currency: Column) -> Column:
    amount = F.format_number(price, 0)
    code = F.coalesce(blank_to_null(currency), F.lit("KRW"))
    text = F.when(code == "KRW", F.concat(amount, F.lit("원"))).otherwise(F.concat(amount, F.lit(" "), code))
    return F.when((entity == "PRODUCT") & price.isNotNull(), text).otherwise("")


def product_caption(item: dict[str, Column], today: Column) -> Column:
    """Shop, status, price, deadline, release, maker and size of a product; empty for anything else."""
    deadline = blank_to_null(item["preorderEndAt"])
    elapsed = F.when(F.substring(deadline, 1, 10) < today, F.lit(" (마감 지남)")).otherwise("")
    caption = F.concat_ws(
        " · ",
        blank_to_null(item["shop"]),
        label(blank_to_null(item["saleStatus"]), SALE_STATUS_LABELS),
        let(price_text(item["entityType"], item["price"], item["currency"]), blank_to_null),
        F.concat(F.lit("예약마감 "), deadline, elapsed),
        F.concat(F.lit("입고 "), blank_to_null(item["releaseWindowText"])),
        blank_to_null(item["manufacturer"]),
        blank_to_null(item["sizeText"]),
    )
    return F.when(item["entityType"] == "PRODUCT", caption).otherwise("")


def short_name(title: Column, title_ko: Column, manufacturer: Column, shop: Column) -> Column:
    """Listing title without tags in brackets, maker, shop and links."""
    def without(name: Column, extra: Column) -> Column:
        def cut(word: Column) -> Column:
            quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
            # An impossible pattern where the word is too short to name anything.
            pattern = F.when(F.length(word) >= 2, quoted).otherwise(F.lit("(?!)"))
            return F.regexp_replace(name, pattern, F.lit(" "))

        return let(strip(F.coalesce(extra, F.lit(""))), cut)

    def shorten(full: Column) -> Column:
        name = F.regexp_replace(full, rf"(?U)^(?:\s*{BRACKETED})+", "")
        name = F.regexp_replace(name, rf"(?U)(?:{BRACKETED}\s*)+$", "")
        name = without(without(name, manufacturer), shop)
        name = F.trim(squish(F.regexp_replace(name, r"(?U)https?://\S+", " ")), F.lit(EDGE_MARKS))
        return F.coalesce(let(name, blank_to_null), blank_to_null(full), F.lit(urls.UNTITLED))

    return let(F.coalesce(let(strip(title_ko), blank_to_null), strip(title), F.lit("")), shorten)


def post_length(text: Column) -> Column:
    """Characters a post counts: every link has the same length."""
    return F.length(F.regexp_replace(text, r"(?U)https?://\S+", "x" * POST_URL_LENGTH))


def post_piece(item: dict[str, Column], today: Column) -> Column:
    caption = product_caption(item, today)
    return F.struct(
        short_name(item["title"], item["titleKo"], item["manufacturer"], item["shop"]).alias("name"),
        F.coalesce(let(caption, blank_to_null), strip(item["source"]), F.lit("")).alias("facts"),
        F.coalesce(urls.http_url(item["url"]), F.lit("")).alias("url"),
        F.coalesce(item["entityType"] == "PRODUCT", F.lit(False)).alias("product"),
    )


CARD_FIELDS = (
    "url", "title", "titleKo", "summary", "sourceLanguage", "source", "region", "category", "status",
    "contentAngle", "sourceTier", "publishedAt", "collectedAt", "postedAt", "entityType", "shop", "saleStatus",
    "preorderEndAt", "releaseWindowText", "manufacturer", "sizeText", "price", "currency", "imageUrl",
    "detailImageUrls",
)
_TYPES = {"collectedAt": "timestamp", "postedAt": "timestamp", "price": "bigint", "detailImageUrls": "array<string>"}


def item_columns(df: DataFrame) -> dict[str, Column]:
    """The card's input columns; one that the table lacks reads as null."""
    return {
        name: F.col(name) if name in df.columns else F.lit(None).cast(_TYPES.get(name, "string"))
        for name in CARD_FIELDS
    }


def as_now(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def with_score(df: DataFrame, now: datetime | Column) -> DataFrame:
    """Adds `components`, `signal_score` and `effective_date`."""
    item = item_columns(df)
    return (
        df.withColumn("components", score_components(item, as_now(now)))
        .withColumn("signal_score", score_of(F.col("components")))
        .withColumn("effective_date", effective_at(item["publishedAt"], item["collectedAt"]))
    )


def card_view(df: DataFrame, now: datetime | Column, out: str = "view") -> DataFrame:
    """Adds the struct of everything a card shows."""
    now = as_now(now)
    item = item_columns(df)
    today = F.date_format(F.from_utc_timestamp(now, ZONE), "yyyy-MM-dd")
    original = F.coalesce(blank_to_null(item["title"]), F.lit(urls.UNTITLED))
    korean = F.coalesce(strip(item["titleKo"]), F.lit(""))
    category = F.coalesce(item["category"], F.lit("UNKNOWN"))
    posted = F.coalesce(F.concat(F.lit("발행 "), kst_minute(item["postedAt"])), F.lit("미발행"))
    staged = df.withColumns({
        "_original": original, "_korean": korean,
        "_language": F.lower(strip(F.coalesce(item["sourceLanguage"], F.lit("")))),
        "_new": new_today(item["collectedAt"], now),
        "_components": score_components(item, now),
        "_dates": date_caption(item["publishedAt"], item["collectedAt"]),
    })
    staged = staged.withColumns({
        "_shown": fields.split_leading_date(F.coalesce(blank_to_null(F.col("_korean")), F.col("_original"))),
        "_first": fields.split_leading_date(F.col("_original")),
        "_shows_original": (F.col("_korean") != "") & (F.col("_korean") != F.col("_original")),
    })
    language = F.col("_language")
    tags = F.create_map(*[F.lit(v) for pair in LANGUAGE_TAGS.items() for v in pair])
    tag = F.coalesce(F.element_at(tags, language), F.upper(language))
    meta = F.concat_ws(
        " · ",
        blank_to_null(item["source"]),
        label(category, CATEGORY_LABELS),
        label(F.coalesce(item["contentAngle"], F.lit("NEWS")), ANGLE_LABELS),
        label(F.coalesce(blank_to_null(item["sourceTier"]), F.lit("MEDIA")), TIER_LABELS),
        label(F.coalesce(item["status"], F.lit("NEW")), STATUS_LABELS),
        posted,
        blank_to_null(F.col("_dates")),
    )
    photos = F.filter(
        F.transform(item["detailImageUrls"], lambda u: urls.photo_url(u)), lambda u: u.isNotNull(),
    )
    shows_original = F.col("_shows_original")
    view = F.struct(
        F.col("_shown.title").alias("title_text"),
        F.col("_shown.date").alias("title_date"),
        F.when(shows_original, F.col("_original")).otherwise("").alias("original_title"),
        F.col("_first.title").alias("original_text"),
        F.col("_first.date").alias("original_date"),
        F.when(shows_original & ~language.isin("", "unknown"), tag).otherwise("").alias("lang_tag"),
        F.coalesce(urls.http_url(item["url"]), F.lit("")).alias("url"),
        F.coalesce(urls.http_url(item["imageUrl"]), F.lit("")).alias("image_url"),
        F.coalesce(photos, F.array().cast("array<string>")).alias("detail_image_urls"),
        label(category, CATEGORY_LABELS).alias("category_label"),
        F.col("_new").alias("is_new_today"),
        meta.alias("meta"),
        summary_preview(item["summary"]).alias("summary"),
        product_caption(item, today).alias("product_caption"),
        score_of(F.col("_components")).alias("signal_score"),
        signals(item["sourceTier"], F.col("_new")).alias("signal_labels"),
        breakdown_of(F.col("_components")).alias("score_breakdown"),
    )
    return staged.withColumn(out, view).select(*df.columns, out)


def feed_items(df: DataFrame, now: datetime | Column, works: str = "works") -> DataFrame:
    """One feed row per content row: view, filter columns, works and the digest piece."""
    now = as_now(now)
    item = item_columns(df)
    today = F.date_format(F.from_utc_timestamp(now, ZONE), "yyyy-MM-dd")
    seen = card_view(df, now).withColumn("_at", effective_at(item["publishedAt"], item["collectedAt"]))
    return seen.select(
        F.col("content_id").alias("id"), "view",
        F.coalesce(blank_to_null(item["category"]), F.lit("UNKNOWN")).alias("category"),
        F.coalesce(item["source"], F.lit("")).alias("source"),
        F.coalesce(F.col(works), F.array().cast("array<string>")).alias("works"),
        F.col("_at").alias("effective_date"),
        item["collectedAt"].alias("collectedAt"),
        F.coalesce(let(fields.iso_text(F.col("_at")), blank_to_null), F.lit(NO_DATE)).alias("date"),
        fields.iso_text(item["collectedAt"]).alias("collected"),
        post_piece(item, today).alias("post"),
    )
