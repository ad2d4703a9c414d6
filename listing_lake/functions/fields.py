"""Typed listing fields as expressions: prices, sale status, dates, product structs."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, functions as F

from listing_lake.functions.text import extract, let, present, squish, strip

# --- fixed values: must equal the stored data's rules -------------------------------------------
PRICE = r"(?U)(?<![0-9])([0-9]{1,3}(?:,[0-9]{3})+)\s*원"
TIGHT_PRICE = r"(?<![0-9])([0-9]{1,3}(?:,[0-9]{3})+)원"
MIN_PRICE = 1000
PLAUSIBLE_PRICE = 5000
SOLD_OUT_WORDS = ("품절", "SOLD OUT", "판매 종료")
PREORDER_WORDS = ("예약", "PRE-ORDER", "PREORDER", "予約")
DATE = (
    r"(?U)([0-9]{4})[.\-]([0-9]{1,2})[.\-]([0-9]{1,2})"
    r"|([0-9]{2})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일"
)
DEADLINE_WORDS = ("마감", "종료", "예약")
DEADLINE_REACH = 30
LABELLED_DEADLINE = r"(?U)예약마감일\s*:?\s*([0-9]{2})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일"
RELEASE_TAG = r"^\[([^\]]*입고[^\]]*)\]"
RELATIVE_AGE = r"(?U)^([0-9]+)\s*(초|분|시간|일|주|개월|년)\s*전$"
AGE_SECONDS = {"초": 1, "분": 60, "시간": 3600, "일": 86400, "주": 604800, "개월": 30 * 86400, "년": 365 * 86400}
FIGURE_KEYWORDS = (
    "피규어", "넨도로이드", "POP UP PARADE", "Figuarts", "룩업", "TENITOL",
    "누들스토퍼", "ESPRESTO", "Relax time", "BiCute", "Coreful", "Luminasta",
)
LEADING_DATE = (
    r"(?s)^([0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?)[\s　]+(.+)$"
)
METADATA_DEFAULTS = {"category": "UNKNOWN", "contentAngle": "NEWS", "sourceTier": "MEDIA"}
# ------------------------------------------------------------------------------------------------

# strptime directives of source configs and the Spark pattern letters they stand for.
_STRPTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS",
    "%b": "MMM", "%B": "MMMM", "%z": "XX",
}


def spark_pattern(strptime_format: str | None) -> str | None:
    """Spark date pattern for a config's strptime format; other letters are quoted."""
    if not strptime_format:
        return None
    out, i = "", 0
    while i < len(strptime_format):
        token = strptime_format[i:i + 2]
        if token in _STRPTIME:
            out, i = out + _STRPTIME[token], i + 2
        else:
            ch = strptime_format[i]
            out, i = out + (f"'{ch}'" if ch.isalpha() else ch), i + 1
    return out


def _to_amount(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("bigint")


def _amounts(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _to_amount)


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def krw_price(text: Column) -> Column:
    """First amount of at least 1,000 won."""
    return _first(F.filter(_amounts(text, PRICE), lambda v: v >= MIN_PRICE))


def pattern_price(text: Column, pattern: Column) -> Column:
    """Group 1 of the source's own pattern; below 1,000 or no match is no price."""
    return let(_to_amount(extract(text, pattern, 1)), lambda found: F.when(found >= MIN_PRICE, found))


def source_price(text: Column, pattern: Column) -> Column:
    return F.when(present(pattern), pattern_price(text, pattern)).otherwise(krw_price(text))


def plausible_price(text: Column) -> Column:
    """First amount of at least 5,000 won, else the first amount."""
    values = _amounts(text, TIGHT_PRICE)
    return F.coalesce(_first(F.filter(values, lambda v: v >= PLAUSIBLE_PRICE)), _first(values))


def _has_any(upper_text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(upper_text, F.lit(word.upper()))
    return hit


def sale_status(text: Column, extra_preorder: Column | None = None) -> Column:
    """Sold-out words win over preorder words; otherwise in stock."""
    def status(upper: Column) -> Column:
        preorder = _has_any(upper, PREORDER_WORDS)
        if extra_preorder is not None:
            preorder = preorder | F.coalesce(
                F.exists(extra_preorder, lambda w: F.contains(upper, F.upper(w))), F.lit(False),
            )
        return F.when(_has_any(upper, SOLD_OUT_WORDS), "SOLD_OUT").when(preorder, "PREORDER").otherwise("IN_STOCK")

    return let(F.upper(text), status)


def _iso_day(year: Column, month: Column, day: Column) -> Column:
    y, m, d = (c.try_cast("int") for c in (year, month, day))
    ok = y.between(2000, 2099) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.format_string("%04d-%02d-%02d", y, m, d))


def parse_date(text: Column) -> Column:
    """ISO day of the first date in the text; a first date out of range gives null."""
    def day(found: Column) -> Column:
        g = [F.regexp_extract(found, DATE, i) for i in range(1, 7)]
        short = F.when(g[3] != "", _iso_day(F.concat(F.lit("20"), g[3]), g[4], g[5]))
        return F.when(g[0] != "", _iso_day(g[0], g[1], g[2])).otherwise(short)

    return let(F.regexp_extract(text, DATE, 0), day)


def deadline_near_keyword(text: Column) -> Column:
    """First valid date within 30 characters of a deadline word, words tried in order."""

    def near(word: str) -> Column:
        def window(at: Column) -> Column:
            start = F.greatest(at - DEADLINE_REACH, F.lit(0))
            return F.when(at >= 0, parse_date(F.substring(text, start + 1, at + DEADLINE_REACH - start)))

        return let(F.locate(word, text) - 1, window)

    return F.coalesce(*[near(word) for word in DEADLINE_WORDS])


def labelled_deadline(text: Column) -> Column:
    g = [F.regexp_extract(text, LABELLED_DEADLINE, i).try_cast("int") for i in (1, 2, 3)]
    return F.when(g[0].isNotNull(), F.format_string("20%02d-%02d-%02d", *g))


def release_window(title: Column) -> Column:
    return F.regexp_extract(title, RELEASE_TAG, 1)


def relative_day(text: Column, now: datetime | Column) -> Column:
    """ISO day of a relative Korean age such as three hours ago."""
    now = now if isinstance(now, Column) else F.lit(now)

    def seconds(value: Column) -> Column:
        unit = F.regexp_extract(value, RELATIVE_AGE, 2)
        size = F.lit(None).cast("bigint")
        for word, length in AGE_SECONDS.items():
            size = F.when(unit == word, F.lit(length)).otherwise(size)
        return (
            F.when(value.isin("방금", "방금 전"), F.lit(0)).when(value == "어제", F.lit(86400))
            .otherwise(F.regexp_extract(value, RELATIVE_AGE, 1).try_cast("bigint") * size)
        )

    moment = F.timestamp_micros(F.unix_micros(now) - let(strip(text), seconds) * 1_000_000)
    return F.date_format(moment, "yyyy-MM-dd")


def published_value(raw: Column, pattern: Column, now: datetime | Column) -> Column:
    """struct(value, error): formatted date, else relative age, else an error text."""
    by_format = F.date_format(F.try_to_timestamp(raw, pattern), "yyyy-MM-dd")
    value = F.when(~present(pattern), raw).otherwise(F.coalesce(by_format, relative_day(raw, now)))
    return let(value, lambda v: F.struct(
        v.alias("value"),
        F.when(raw.isNotNull() & v.isNull(), F.concat(F.lit("게시일 형식 오류: "), raw)).alias("error"),
    ))


def by_parse_kind(kind: Column, text: Column, extra_preorder: Column | None = None) -> Column:
    """Value as text for a parse kind: text, krw, sale_status or date."""
    return (
        F.when(kind == "krw", krw_price(text).cast("string"))
        .when(kind == "sale_status", sale_status(text, extra_preorder))
        .when(kind == "date", parse_date(text))
        .otherwise(squish(text))
    )


def product_struct(
    price: Column, status: Column, deadline: Column, shop: Column, source_name: Column,
    checked_at: datetime | Column,
) -> Column:
    """Product fields, or null when there is no price of at least 1,000 won."""
    checked = checked_at if isinstance(checked_at, Column) else F.lit(checked_at)
    return let(price, lambda price: F.when(
        price >= MIN_PRICE,
        F.struct(
            F.lit("PRODUCT").alias("entityType"),
            F.when(present(shop), shop).otherwise(source_name).alias("shop"),
            F.coalesce(status, F.lit("IN_STOCK")).alias("saleStatus"),
            price.cast("bigint").alias("price"),
            F.lit("KRW").alias("currency"),
            deadline.alias("preorderEndAt"),
            checked.cast("timestamp").alias("productCheckedAt"),
        ),
    ))


def text_product(
    text: Column, price_pattern: Column, preorder_words: Column, shop: Column, source_name: Column,
    checked_at: datetime | Column,
) -> Column:
    """Product fields read from free text under the source's options."""
    return product_struct(
        source_price(text, price_pattern), sale_status(text, preorder_words),
        deadline_near_keyword(text), shop, source_name, checked_at,
    )


def has_figure_keyword(text: Column) -> Column:
    return let(F.lower(text), lambda lowered: reduce(
        lambda hit, word: hit | F.contains(lowered, F.lit(word.lower())), FIGURE_KEYWORDS, F.lit(False)))


def split_leading_date(text: Column) -> Column:
    """struct(date, title) of a title that starts with a date."""
    def split(value: Column) -> Column:
        date = F.regexp_extract(value, LEADING_DATE, 1)
        title = F.when(date != "", F.regexp_extract(value, LEADING_DATE, 2)).otherwise(F.coalesce(text, F.lit("")))
        return F.struct(F.coalesce(date, F.lit("")).alias("date"), title.alias("title"))

    return let(strip(text), split)


_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(?:[T ][0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)?(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$"
)
_MAIL = r"^(?:[A-Za-z]{3,9},?\s+)?([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\s+([0-9]{4}|[0-9]{2})\s+([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\s*(.*)$"
# Zone names a mail date may carry, as offsets.
_MAIL_ZONES = {
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def _mail_time(value: Column) -> Column:
    g = [F.regexp_extract(value, _MAIL, i) for i in range(1, 6)]
    year = F.when(F.length(g[2]) == 4, g[2]).otherwise(
        F.concat(F.when(g[2] > "68", F.lit("19")).otherwise(F.lit("20")), g[2])
    )
    clock = F.when(F.length(g[3]) <= 5, F.concat(g[3], F.lit(":00"))).otherwise(g[3])
    zone = F.regexp_extract(g[4], r"^([+-][0-9]{4})", 1)
    named = F.lit("+0000")
    for name, offset in _MAIL_ZONES.items():
        named = F.when(F.startswith(F.upper(g[4]), F.lit(name)), F.lit(offset)).otherwise(named)
    offset = F.when(zone != "", zone).otherwise(named)
    return F.try_to_timestamp(
        F.concat_ws(" ", g[0], F.initcap(g[1]), year, clock, offset), F.lit("d MMM yyyy H:mm:ss Z"),
    )


def _iso_time(value: Column) -> Column:
    """Brings the ISO forms to one the cast understands."""
    iso = F.regexp_replace(value, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"([T ][0-9]{2})(Z|[+-].*)?$", "$1:00$2")
    iso = F.regexp_replace(iso, r"([T ][0-9]{2}:[0-9]{2})(Z|[+-].*)?$", "$1:00$2")
    iso = F.regexp_replace(iso, r"([T ].*[+-][0-9]{2})([0-9]{2})$", "$1:$2")
    iso = F.regexp_replace(F.replace(iso, F.lit(","), F.lit(".")), r"([T ].*[+-][0-9]{2})$", "$1:00")
    return let(iso, lambda text: F.when(text.rlike(_ISO), text.try_cast("timestamp")))


def published_at(raw: Column) -> Column:
    """Timestamp of a mail-style or ISO date; a value without zone is UTC; else null."""
    return let(strip(raw), lambda value: F.when(value.rlike(_MAIL), _mail_time(value)).otherwise(_iso_time(value)))


def iso_text(ts: Column) -> Column:
    """ISO rendering with offset; empty for a missing time. Microseconds appear only when present."""
    def text(t: Column) -> Column:
        micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
        fraction = F.when(micros > 0, F.format_string(".%06d", micros)).otherwise("")
        return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))

    return F.coalesce(let(ts, text), F.lit(""))


def default_metadata(df, sources, source_key: str = "source"):
    """Listing rows joined with their source's metadata; the listing's own values win."""
    dim = sources.select(
        F.col("name").alias(source_key),
        F.struct(
            F.col("type").alias("sourceType"), F.col("url").alias("sourceUrl"), F.col("region").alias("region"),
            F.col("category").alias("category"), F.col("content_angle").alias("contentAngle"),
            F.col("source_tier").alias("sourceTier"),
        ).alias("_src"),
    )
    joined = df.join(dim, source_key, "left")
    own = set(df.columns)

    def pick(name: str) -> Column:
        values = [F.col(name)] if name in own else []
        values.append(F.col(f"_src.{name}"))
        if name in METADATA_DEFAULTS:
            values.append(F.lit(METADATA_DEFAULTS[name]))
        return F.coalesce(*values)

    names = ("sourceType", "sourceUrl", "region", "category", "contentAngle", "sourceTier")
    out = joined.withColumns({name: pick(name) for name in names})
    blanks = {name: F.coalesce(F.col(name), F.lit("")) if name in own else F.lit("") for name in ("summary", "note")}
    out = out.withColumns(blanks)
    if "publishedAt" not in own:
        out = out.withColumn("publishedAt", F.lit(None).cast("string"))
    if "postedAt" not in own:
        out = out.withColumn("postedAt", F.lit(None).cast("timestamp"))
    return out.drop("_src")
