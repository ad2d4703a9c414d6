"""Whole collection runs over the tables: fetched pages, feeds and payloads to the stored content and the report."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions import urls
from listing_lake.operators import snapshots, store
from listing_lake.plans import collection
from listing_lake.plans.page_queries import LISTED_SQL, WEB
from listing_lake.plans.registry import NOW, query, table
from listing_lake.session import PAGE_ROWS, configure, shared_dir, spread
from listing_lake.sources import dims, payloads
from listing_lake.streaming import streams

MALL = "https://shop.example"
NO_LIMIT = {"max_items": 2_000_000_000}
SOURCES = [
    WEB | NO_LIMIT,
    {"name": "shop-a", "type": "html", "url": f"{MALL}/a", "link_selector": "li a", "list_product_mode": True} | NO_LIMIT,
    {"name": "shop-b", "type": "html", "url": f"{MALL}/b", "link_selector": "li a"} | NO_LIMIT,
    {"name": "feed", "type": "rss", "url": f"{MALL}/f"} | NO_LIMIT,
    {"name": "api", "type": "json_api", "url": f"{MALL}/j", "items_path": "l", "id_field": "i", "title_field": "t", "detail_url_template": "/product/{id}",
     "image_field": "p"} | NO_LIMIT,
    {"name": "off", "type": "rss", "url": f"{MALL}/o", "enabled": False},
    {"name": "hand", "type": "html", "url": f"{MALL}/h", "manual_only": True},
    {"name": "odd", "type": "ftp", "url": f"{MALL}/p"},
]


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def _link() -> Column:
    return F.concat(F.lit(f"{MALL}/product/"), _key())


def _card(word: str, price: Column) -> Column:
    return F.concat(F.lit('<ul><li><a href="/product/'), _key(), F.lit(f'">{word} '), _key(), F.lit("</a> "), price, F.lit("원</li></ul>"))


def _price(more: int) -> Column:
    return F.format_number(F.col("p_partkey") * 37 + more, 0)


def _news() -> Column:
    """A feed of one entry per part; some are cut off, some hold an ampersand that XML does not allow."""
    title = F.concat(F.lit("news "), F.when(F.col("p_partkey") % 25 == 0, "more & ").otherwise(""), _key())
    whole = F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>/product/"), _key(), F.lit("</link></item></channel></rss>"))
    return F.when(F.col("p_partkey") % 35 == 0, "<rss><channel><item><title>").otherwise(whole)


def _page(rows: DataFrame, source: str, body: Column) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), F.col("p_partkey").alias("page_no"), F.lit(f"{MALL}/l").alias("url"), body.alias("body"))


@query("collection_run", f"""
WITH {LISTED_SQL},
w AS (SELECT page_no, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_no, pos) AS r FROM listed) WHERE r = 1),
stop AS (SELECT min(page_id) AS p FROM pages WHERE page_id NOT IN (SELECT page_no FROM w)),
arrived AS (
 SELECT 'web' AS source, 0 AS ord, url AS u, false AS upd FROM w, stop WHERE p IS NULL OR page_no < p
 UNION ALL SELECT 'shop-a', 1, CAST(p_partkey AS VARCHAR), true FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT 'shop-b', 2, CAST(p_partkey AS VARCHAR), false FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT 'feed', 3, CAST(p_partkey AS VARCHAR), false FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 35 <> 0
 UNION ALL SELECT 'api', 4, CAST(p_partkey AS VARCHAR), true FROM part WHERE p_partkey % 7 = 0),
marked AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ord) = 1 AND u NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 0) AS new FROM arrived),
counted AS (SELECT source, count(*) AS processed, count(*) FILTER (WHERE new) AS inserted, count(*) FILTER (WHERE NOT new) AS existing,
 count(*) FILTER (WHERE upd AND NOT new) AS updated FROM marked GROUP BY source),
lost AS (SELECT 'feed' AS source, count(*) AS n FROM part WHERE p_partkey % 35 = 0),
named AS (SELECT * FROM (VALUES ('web', 0, ''), ('shop-a', 0, ''), ('shop-b', 0, ''), ('feed', 0, ''), ('api', 0, ''), ('off', 0, '비활성화'), ('hand', 0, '수동 전용'),
 ('odd', 1, '지원하지 않는 수집 방식: ftp')) AS t(source, bad, reason)),
report AS (SELECT source, coalesce(processed, 0) AS processed, coalesce(inserted, 0) AS inserted, coalesce(existing, 0) AS existing, coalesce(updated, 0) AS updated,
 bad + coalesce(n, 0) AS failed, CASE WHEN n > 0 THEN 'RSS 해석 실패' ELSE reason END AS note FROM named LEFT JOIN counted USING (source) LEFT JOIN lost USING (source))
SELECT * FROM report UNION ALL SELECT 'TOTAL', CAST(sum(processed) AS BIGINT), CAST(sum(inserted) AS BIGINT), CAST(sum(existing) AS BIGINT), CAST(sum(updated) AS BIGINT),
 CAST(sum(failed) AS BIGINT), '' FROM report""")
def collection_run(spark, sf):
    """A run of eight sources, four of which list the same products, into a table that holds some of them."""
    part, root = spread(table(spark, sf, "part"), PAGE_ROWS), f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    k = F.col("p_partkey")
    web = table(spark, sf, "pages").select(F.lit("web").alias("source"), F.col("page_id").alias("page_no"), "url", F.col("html").alias("body"))
    payload = F.to_json(F.struct(F.array(F.struct(k.alias("i"), F.concat(F.lit("api "), _key()).alias("t"), F.concat(F.lit("/img/"), _key(), F.lit(".jpg")).alias("p"))).alias("l")))
    fetched = (
        web.unionByName(_page(part.filter(k % 2 == 0), "shop-a", _card("product number", _price(1000))))
        .unionByName(_page(part.filter(k % 3 == 0), "shop-b", _card("other number", _price(1000))))
        .unionByName(_page(part.filter(k % 5 == 0), "feed", _news())).unionByName(_page(part.filter(k % 7 == 0), "api", payload)))
    norm = urls.doc_id(urls.normalize_url(_link()))
    old = store.conform(part.filter(k % 4 == 0).select(
        _link().alias("url"), norm.alias("doc_id"), urls.content_id(F.lit("GOODS"), norm).alias("content_id"), F.lit("GOODS").alias("storage_category")))
    snapshots.write_content(old, root, n_buckets=16)
    run = collection.run_collection(spark, root, collection.Fetched(fetched), dims.sources_table(spark, SOURCES), NOW, n_buckets=16)
    return run.report.drop("ord")


@query("feed_failures", """
SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 3) THEN 'RSS 해석 실패' END AS error,
 CAST(CASE WHEN doc_id % 4 IN (1, 3) THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_entries FROM documents""")
def feed_failures(spark, sf):
    """Every document as a feed of its lines: well formed, plain text, with loose ampersands, or not fetched."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind = F.col("doc_id") % 4
    more = F.when(kind == 2, " & more").otherwise("")
    items = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<item><title>"), esc(x), more, F.lit("</title><link>/a</link></item>"))), "")
    body = F.when(kind == 1, F.col("text")).when(kind != 3, F.concat(F.lit("<rss><channel>"), items, F.lit("</channel></rss>")))
    docs = table(spark, sf, "documents").select("doc_id", F.lit("https://f.example/feed").alias("url"), body.alias("body"))
    return payloads.parse_feeds(docs).select("doc_id", "error", F.size("entries").cast("bigint").alias("n_entries"))


RAW = "source string, kind string, page_no bigint, url string, content_type string, body binary, failed boolean"


def _raw(rows: DataFrame, source: str, body: Column, charset: str, java: str) -> DataFrame:
    return _page(rows, source, F.encode(body, java)).withColumns({
        "kind": F.lit("list"), "content_type": F.lit(f"text/html; charset={charset}"), "failed": F.lit(False)})


@query("stream_intake", """
SELECT sha256('https://shop.example/product/' || p_partkey) AS doc_id,
 CASE WHEN p_partkey % 2 = 0 THEN 'shop-a' WHEN p_partkey % 5 = 0 AND p_partkey % 35 <> 0 THEN 'feed' ELSE 'shop-b' END AS source,
 CASE WHEN p_partkey % 2 = 0 THEN '상품 번호 ' || p_partkey WHEN p_partkey % 5 = 0 AND p_partkey % 35 <> 0 THEN 'news ' || CASE WHEN p_partkey % 25 = 0 THEN 'more & ' ELSE '' END || p_partkey
  ELSE '다른 번호 ' || p_partkey END AS title,
 CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 37 + 2000 WHEN p_partkey % 2 = 0 THEN p_partkey * 37 + 1000 END AS price
FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR (p_partkey % 5 = 0 AND p_partkey % 35 <> 0)""")
def stream_intake(spark, sf):
    """Raw bodies arrive twice: Korean shop pages and feeds, then a second shop that lists some of the products at a new price."""
    part, folder = spread(table(spark, sf, "part"), PAGE_ROWS), f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    k = F.col("p_partkey")
    shops = [SOURCES[1], SOURCES[3], SOURCES[2] | {"list_product_mode": True}]
    sources = dims.sources_table(configure(spark), shops)
    first = _raw(part.filter(k % 2 == 0), "shop-a", _card("상품 번호", _price(1000)), "euc-kr", "x-windows-949").unionByName(
        _raw(part.filter(k % 5 == 0), "feed", _news(), "utf-8", "UTF-8"))
    second = _raw(part.filter(k % 3 == 0), "shop-b", _card("다른 번호", _price(2000)), "euc-kr", "x-windows-949")
    for arrived in (first, second):
        arrived.select(*[c.split()[0] for c in RAW.split(", ")]).write.mode("append").parquet(f"{folder}/raw")
        streams.intake_stream(
            streams.read_stream(spark, f"{folder}/raw", RAW), sources, f"{folder}/content", f"{folder}/checkpoint", lambda: NOW, f"{folder}/reports", n_buckets=8)
    return snapshots.read_content(spark, f"{folder}/content").select("doc_id", "source", "title", "price")
