"""Queries over parts, orders, documents and events for the typed fields and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from listing_lake.functions import cards, fields
from listing_lake.functions.text import fold_search, fold_title, hangul_share, needs_translation, utf8_limit
from listing_lake.plans.registry import NOW, query, squish_sql, table
from listing_lake.sources import payloads



def _won(factor: int, plus: int):
    return F.format_number(F.col("p_partkey") * factor + plus, 0)


def _null():
    return F.lit(None).cast("string")


@query("price_parse", """
SELECT p_partkey, CASE WHEN p_partkey * 37 + 500 >= 1000 THEN p_partkey * 37 + 500 ELSE p_partkey * 11 + 3000 END AS krw,
 CASE WHEN p_partkey * 37 + 500 >= 5000 THEN p_partkey * 37 + 500 WHEN p_partkey * 11 + 3000 >= 5000 THEN p_partkey * 11 + 3000
  WHEN p_partkey * 37 + 500 >= 1000 THEN p_partkey * 37 + 500 ELSE p_partkey * 11 + 3000 END AS plausible FROM part""")
def price_parse(spark, sf):
    text = F.concat("p_name", F.lit(" 정가 900원 판매가 "), _won(37, 500), F.lit("원 배송 1"), _won(11, 3000), F.lit("x 할인 "), _won(11, 3000), F.lit("원"))
    return table(spark, sf, "part").select("p_partkey", text.alias("t")).select(
        "p_partkey", fields.krw_price(F.col("t")).alias("krw"), fields.plausible_price(F.col("t")).alias("plausible"))


@query("price_pattern", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_partkey * 11 + 3000 WHEN 1 THEN NULL ELSE CASE WHEN p_partkey * 37 + 500 >= 1000 THEN p_partkey * 37 + 500 ELSE p_partkey * 11 + 3000 END END AS price FROM part""")
def price_pattern(spark, sf):
    text = F.concat(F.lit("소비자가 : "), _won(37, 500), F.lit("원 판매가 : "), _won(11, 3000), F.lit("원"))
    size = F.col("p_size") % 3
    pattern = F.when(size == 0, r"(?U)판매가\s*:\s*([\d,]+)\s*원").when(size == 1, r"정가\s*([\d,]+)원")
    return table(spark, sf, "part").select("p_partkey", fields.source_price(text, pattern).alias("price"))


@query("sale_status", """
SELECT p_partkey, CASE WHEN p_size % 6 IN (0, 1) THEN 'SOLD_OUT' WHEN p_size % 6 IN (2, 3) THEN 'PREORDER' WHEN p_size % 6 = 4 AND p_partkey % 2 = 0 THEN 'PREORDER' ELSE 'IN_STOCK' END AS sale_status FROM part""")
def sale_status(spark, sf):
    size = F.col("p_size") % 6
    word = F.when(size == 0, "예약 품절").when(size == 1, "Sold Out").when(size == 2, "예약 진행").when(size == 3, "pre-order").when(size == 4, "발매 : 27년").otherwise("마감")
    extra = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("발매 :")))
    return table(spark, sf, "part").select("p_partkey", fields.sale_status(F.concat_ws(" ", "p_name", word), extra).alias("sale_status"))


@query("deadline_window", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d')
 WHEN 2 THEN NULL ELSE '2026-03-05' END AS deadline, CASE WHEN o_orderkey % 4 <> 2 THEN strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') END AS first_date FROM orders""")
def deadline_window(spark, sf):
    day = F.col("o_orderdate") + F.expr("INTERVAL 20 YEAR")
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.date_format(day, "yyyy.M.d"), F.lit(" 까지 예약 마감")))
        .when(kind == 1, F.concat(F.date_format(day, "yy년 M월 d일"), F.lit(" 예약")))
        .when(kind == 2, F.concat(F.lit("예약 마감 1999-01-01 "), F.lit("x" * 40), F.date_format(day, "yyyy-MM-dd")))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" " + "x" * 40 + " 마감 26년 13월 1일 " + "y" * 40 + " 종료 2026-3-5"))))
    first = F.when(kind != 2, text)
    return table(spark, sf, "orders").select("o_orderkey", text.alias("t"), first.alias("f")).select(
        "o_orderkey", fields.deadline_near_keyword(F.col("t")).alias("deadline"), fields.parse_date(F.col("f")).alias("first_date"))


@query("relative_date", """
SELECT event_id, strftime(TIMESTAMP '2024-01-31' - CASE event_type WHEN 'view' THEN to_hours(CAST(floor(value) AS INTEGER)) WHEN 'click' THEN to_days(CAST(floor(value) AS INTEGER))
 WHEN 'signup' THEN to_days(30 * CAST(floor(value) AS INTEGER)) WHEN 'purchase' THEN to_days(1) ELSE to_days(CAST(7 * floor(value) AS INTEGER)) END, '%Y-%m-%d') AS day FROM events""")
def relative_date(spark, sf):
    n = F.floor("value").cast("string")
    unit = lambda u: F.concat(n, F.lit(u))
    text = (F.when(F.col("event_type") == "view", unit("시간 전")).when(F.col("event_type") == "click", unit(" 일 전"))
            .when(F.col("event_type") == "signup", unit("개월 전")).when(F.col("event_type") == "purchase", F.lit(" 어제 ")).otherwise(unit("주전")))
    return table(spark, sf, "events").select("event_id", fields.relative_day(text, NOW).alias("day"))


@query("published_value", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2024-01-30' END AS published,
 CASE WHEN o_orderkey % 3 = 2 THEN '게시일 형식 오류: ' || o_orderpriority END AS error FROM orders""")
def published_value(spark, sf):
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.date_format("o_orderdate", "yyyy/M/d")).when(kind == 1, "어제").otherwise(F.col("o_orderpriority"))
    value = fields.published_value(text, F.lit(fields.spark_pattern("%Y/%m/%d")), NOW)
    return table(spark, sf, "orders").select("o_orderkey", value.alias("v")).select("o_orderkey", F.col("v.value").alias("published"), F.col("v.error").alias("error"))


@query("published_timestamp", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE strftime(o_orderdate + to_hours(CAST(o_custkey % 24 AS INTEGER)) - CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS at FROM orders""")
def published_timestamp(spark, sf):
    at = F.timestamp_micros(F.unix_micros("o_orderdate") + (F.col("o_custkey") % 24) * 3_600_000_000)
    kind = F.col("o_orderkey") % 4
    text = (F.when(kind == 0, F.concat(F.date_format(at, "E, d MMM yyyy HH:mm:ss"), F.lit(" +0900"))).when(kind == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(kind == 2, F.date_format(at, "yyyy-MM-dd HH:mm")).otherwise(F.concat(F.col("o_orderpriority"), F.lit("?"))))
    return table(spark, sf, "orders").select("o_orderkey", fields.iso_text(fields.published_at(text)).alias("at"))


@query("leading_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y.%m.%d') || CASE WHEN o_orderkey % 4 = 0 THEN ' 10:30' ELSE '' END ELSE '' END AS date,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderpriority || ' ' || strftime(o_orderdate, '%Y.%m.%d') END AS title FROM orders""")
def leading_date(spark, sf):
    day = F.date_format("o_orderdate", "yyyy.MM.dd")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), day, F.when(F.col("o_orderkey") % 4 == 0, " 10:30").otherwise(""), F.lit("　"), "o_orderpriority", F.lit(" "))).otherwise(
        F.concat_ws(" ", "o_orderpriority", day))
    return table(spark, sf, "orders").select("o_orderkey", fields.split_leading_date(text).alias("s")).select("o_orderkey", "s.date", "s.title")


# --- text ---------------------------------------------------------------------------------------
LETTERS_SQL = "length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g'))"


@query("needs_translation", f"""
WITH l AS (SELECT doc_id, {LETTERS_SQL} AS latin, 2 * (doc_id % 3000) AS hangul FROM documents)
SELECT doc_id, CASE WHEN latin + hangul = 0 THEN false ELSE hangul / (latin + hangul) < 0.5 END AS needed, CAST(floor(100 * hangul / (latin + hangul)) AS BIGINT) AS percent FROM l""")
def needs_translation_query(spark, sf):
    mixed = F.concat("text", F.expr("repeat('가나', cast(doc_id % 3000 as int))"))
    docs = table(spark, sf, "documents").select("doc_id", mixed.alias("t"))
    return docs.select("doc_id", needs_translation(F.col("t")).alias("needed"), F.floor(hangul_share(F.col("t")) * 100).alias("percent"))


@query("utf8_limit", """
WITH k AS (SELECT doc_id, text, CASE WHEN strlen(text) <= 500 THEN text ELSE regexp_replace(substring(text, 1, CAST(list_max(list_filter(range(0, 501), lambda i: strlen(substring(text, 1, CAST(i AS INTEGER))) <= 500)) AS INTEGER)), '\\s+$', '') END AS cut FROM documents)
SELECT doc_id, sha256(cut) AS digest, CAST(length(cut) AS BIGINT) AS n FROM k""")
def utf8_limit_query(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", utf8_limit(F.col("text")).alias("cut"))
    return docs.select("doc_id", F.sha2("cut", 256).alias("digest"), F.length("cut").cast("bigint").alias("n"))


FOLD_SQL = squish_sql("replace(replace(lower(text), 'ß', 'ss'), ':', ' ')")
SEARCH_SQL = squish_sql("replace(lower(text), ':', ' ')")


@query("fold_title", f"SELECT doc_id, sha256({FOLD_SQL}) AS folded, sha256({SEARCH_SQL}) AS searchable FROM documents")
def fold_title_query(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(fold_title(F.col("text")), 256).alias("folded"), F.sha2(fold_search(F.col("text")), 256).alias("searchable"))


@query("summary_preview", """
WITH s AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(substring(t, 1, 120), '\\s+$', '') || '…' END AS summary FROM s""")
def summary_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cards.summary_preview(F.col("text")).alias("summary"))


@query("post_length", "SELECT page_id, CAST(length('보기 ') + 23 + length(' 와 ') + 23 AS BIGINT) AS n FROM pages")
def post_length(spark, sf):
    text = F.concat(F.lit("보기 "), "url", F.lit(" 와 "), "url")
    return table(spark, sf, "pages").select("page_id", cards.post_length(text).cast("bigint").alias("n"))


@query("short_name", f"""
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '[예약]' ELSE {squish_sql("regexp_replace(p_name, regexp_escape(p_type), ' ', 'gi')")} END AS name FROM part""")
def short_name(spark, sf):
    title = F.when(F.col("p_size") % 10 == 0, "[예약]").otherwise(F.concat(
        F.lit("[예약] 【한정】"), "p_name", F.lit(" - "), F.lower("p_brand"), F.lit(" https://x.example/1 [3차] ")))
    return table(spark, sf, "part").select("p_partkey", cards.short_name(title, F.lit(" "), F.col("p_brand"), F.col("p_type")).alias("name"))


def _product(part):
    none = F.lit(None).cast("string")
    item = {c: none for c in cards.CARD_FIELDS}
    size = F.col("p_size")
    return item | {
        "entityType": F.when(size % 7 == 0, "NEWS").otherwise("PRODUCT"), "shop": F.when(size % 5 == 0, "").otherwise(F.col("p_brand")),
        "saleStatus": F.when(size % 4 == 0, "PREORDER").when(size % 4 == 1, "SOLD_OUT").when(size % 4 == 2, "LATER"),
        "price": F.when(size % 3 != 0, F.col("p_partkey") * 37 + 500), "currency": F.when(size % 2 == 0, "USD"),
        "preorderEndAt": F.when(size % 4 == 0, F.format_string("2024-02-%02d", size % 28 + 1)), "sizeText": F.col("p_type"), "source": F.lit("s"),
        "title": F.col("p_name"), "url": F.concat(F.lit("https://e.example/"), F.col("p_partkey").cast("string"))}


CAPTION_SQL = """CASE WHEN p_size % 7 = 0 THEN '' ELSE concat_ws(' · ', CASE WHEN p_size % 5 <> 0 THEN p_brand END,
 CASE p_size % 4 WHEN 0 THEN '예약중' WHEN 1 THEN '품절' WHEN 2 THEN 'LATER' END, CASE WHEN p_size % 3 <> 0 THEN format('{:,}', p_partkey * 37 + 500) || CASE WHEN p_size % 2 = 0 THEN ' USD' ELSE '원' END END,
 CASE WHEN p_size % 4 = 0 THEN '예약마감 2024-02-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || CASE WHEN p_size % 28 + 1 < 15 THEN ' (마감 지남)' ELSE '' END END, p_type) END"""


@query("product_caption", f"SELECT p_partkey, {CAPTION_SQL} AS caption FROM part")
def product_caption(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", cards.product_caption(_product(part), F.lit("2024-02-15")).alias("caption"))


# --- feeds and payloads -------------------------------------------------------------------------
LINES_SQL = """x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, ls FROM x), r AS (SELECT doc_id, pos, list_extract(ls, pos + 1) AS line FROM l)"""


def _lines():
    return F.split("text", "\n")


@query("feed_xml", f"""
WITH {LINES_SQL} SELECT doc_id, pos, 'https://f.example/a/' || doc_id || '/' || length(line) AS url, CASE WHEN trim(line) = '' THEN '(untitled)' ELSE trim(line) END AS title,
 substring(trim(line), 1, 500) AS summary FROM r WHERE pos % 5 <> 4""")
def feed_xml(spark, sf):
    """Every document is a feed whose lines are its entries; each fifth entry has no link."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = lambda line, i: F.concat(
        F.lit("<item><title>"), esc(line), F.lit("</title>"),
        F.when(i % 5 == 4, "").otherwise(F.concat(F.lit("<link>/a/"), F.col("doc_id").cast("string"), F.lit("/"), F.length(line).cast("string"), F.lit("?utm_source=rss</link>"))),
        F.lit("<description>"), esc(line), F.lit("</description></item>"))
    body = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(_lines(), item), ""), F.lit("</channel></rss>"))
    feeds = table(spark, sf, "documents").select("doc_id", F.lit("https://f.example/feed").alias("url"), body.alias("body"))
    return payloads.read_feed_xml(feeds).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "url", "title", "summary")


@query("json_payload", f"""
WITH {LINES_SQL} SELECT doc_id, pos, 'https://f.example/post/' || (doc_id * 1000 + pos) AS url, line AS title, CASE WHEN pos % 2 = 0 THEN '2026-01-05' ELSE 'soon' END AS published FROM r WHERE line <> ''""")
def json_payload(spark, sf):
    """Every document is an API page whose entries are its lines."""
    entry = lambda line, i: F.struct(
        (F.col("doc_id") * 1000 + i).alias("idx"), line.alias("title"), F.array(F.struct(F.when(i % 2 == 0, "2026-01-05 10:00:00.0").otherwise("soon").alias("day"))).alias("meta"))
    body = F.to_json(F.struct(F.struct(F.transform(_lines(), entry).alias("list")).alias("data")))
    none = F.lit(None).cast("string")
    api = F.struct(
        F.lit("data.list").alias("items_path"), F.lit("idx").alias("id_field"), F.lit("title").alias("title_field"), F.lit("meta.0.day").alias("date_field"),
        F.lit(fields.spark_pattern("%Y-%m-%d %H:%M:%S.%f")).alias("date_pattern"), none.alias("summary_field"), F.lit("/post/{id}").alias("detail_url_template"),
        none.alias("image_field"), none.alias("image_html_field"), F.array().cast("array<string>").alias("image_deny_patterns"))
    docs = table(spark, sf, "documents").select("doc_id", F.lit("https://f.example/api").alias("url"), body.alias("body"), api.alias("api"))
    return payloads.read_json_payloads(docs).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "url", "title", F.col("publishedAt").alias("published"))


@query("json_dig", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_dig(spark, sf):
    return table(spark, sf, "events").select("event_id", payloads.dig(F.try_parse_json("props"), F.lit("k"), "bigint").alias("k"))


@query("page_count_stop", """
WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 2 END AS n, length(text) % 7 = 0 AS empty FROM conversations),
e AS (SELECT conv_id, min(CASE WHEN empty THEN turn END) AS f, min(CASE WHEN turn >= n THEN turn END) AS l FROM c GROUP BY conv_id)
SELECT conv_id, turn FROM c JOIN e USING (conv_id) WHERE (f IS NULL OR turn < f) AND (l IS NULL OR turn <= l)""")
def page_count_stop(spark, sf):
    """A conversation is a source and its turns are API pages; some are empty, some report a page count of 2."""
    turns = table(spark, sf, "conversations")
    items = F.when(F.length("text") % 7 == 0, F.lit("[]")).otherwise(F.lit('[{"id":1}]'))
    body = F.concat(F.lit('{"items":'), items, F.when(F.col("conv_id") % 2 == 0, ',"pages":2').otherwise(""), F.lit("}"))
    api = F.struct(F.lit("items").alias("items_path"), F.lit("pages").alias("page_count_field"))
    rows = turns.select(F.col("conv_id").alias("source"), F.col("turn").alias("page_no"), body.alias("body"), api.alias("api"))
    return payloads.page_count_stop(rows).select(F.col("source").alias("conv_id"), F.col("page_no").alias("turn"))
