"""Queries over events as content rows and over documents as titled items: scores, feeds, works, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listing_lake.functions import cards, fields
from listing_lake.functions.text import fold_title
from listing_lake.operators import backfill, feed, reports, store, works as W
from listing_lake.operators.dedupe import first_seen as first_seen_rows
from listing_lake.plans.field_queries import CAPTION_SQL, _product
from listing_lake.plans.page_queries import FIRST_SQL, _listed
from listing_lake.plans.registry import NOW, NOW_SQL, norm_sql, query, table
from listing_lake.sources import dims, intake
from listing_lake.session import PAGE_ROWS, materialize, small_table, spread

# --- events as content --------------------------------------------------------------------------
CATEGORIES = ("ANIME", "CHARACTER", "FIGURE", "GOODS", "COLLECTION", "FESTIVAL", "UNKNOWN")
ITEMS_SQL = f"""
items AS (SELECT event_id, ts, user_id, list_extract(['ANIME','CHARACTER','FIGURE','GOODS','COLLECTION','FESTIVAL','UNKNOWN'], CAST(user_id % 7 + 1 AS INTEGER)) AS category,
 list_extract(['NEW','KEEP','HOLD','IGNORE','NEW'], CAST(event_id % 5 + 1 AS INTEGER)) AS status, 'user-' || user_id AS source,
 CASE WHEN value > 20 THEN 'OFFICIAL' ELSE 'MEDIA' END AS tier, CASE WHEN user_id % 2 = 0 THEN 'KR' ELSE 'JP' END AS region,
 event_type = 'purchase' AS product, event_type = 'purchase' AND event_id % 2 = 0 AS preorder, event_id % 10 = 0 AS limited,
 event_id % 11 = 0 AS posted FROM events),
keyed AS (SELECT *, category || ':' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS content_id,
 epoch_us({NOW_SQL}) - epoch_us(ts) AS age, 216 * 3600000000 AS horizon FROM items),
fresh AS (SELECT *, CASE WHEN age < horizon THEN ((horizon - age) * 700 + horizon) // (2 * horizon) END AS f FROM keyed),
scored AS (SELECT *, coalesce(f, 0) + CASE WHEN tier = 'OFFICIAL' THEN 60 ELSE 0 END + CASE WHEN region = 'KR' THEN 40 ELSE 0 END
 + CASE WHEN preorder THEN 30 ELSE 0 END + CASE WHEN product AND limited THEN 30 ELSE 0 END AS tenths FROM fresh)"""


def _content(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    i, user = F.col("event_id"), F.col("user_id")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    category = pick(CATEGORIES, user % 7)
    product = F.col("event_type") == "purchase"
    return events.select(
        F.concat(category, F.lit(":"), F.lpad(i.cast("string"), 12, "0")).alias("content_id"), category.alias("storage_category"), category.alias("category"),
        pick(("NEW", "KEEP", "HOLD", "IGNORE", "NEW"), i % 5).alias("status"), F.concat(F.lit("user-"), user.cast("string")).alias("source"),
        F.when(F.col("value") > 20, "OFFICIAL").otherwise("MEDIA").alias("sourceTier"), F.when(user % 2 == 0, "KR").otherwise("JP").alias("region"),
        F.when(product, "PRODUCT").alias("entityType"), F.when(product & (i % 2 == 0), "PREORDER").otherwise("IN_STOCK").alias("saleStatus"),
        F.when(i % 10 == 0, F.concat(F.lit("한정판 "), i.cast("string"))).otherwise(i.cast("string")).alias("title"),
        F.when(i % 11 == 0, F.col("ts")).alias("postedAt"), F.col("ts").alias("collectedAt"), F.concat(F.lit("https://e.example/"), i.cast("string")).alias("url"))


@query("score", f"WITH {ITEMS_SQL} SELECT content_id, tenths / 10.0::DOUBLE AS score FROM scored")
def score(spark, sf):
    return cards.with_score(_content(spark, sf), NOW).select("content_id", F.col("signal_score").alias("score"))


@query("score_breakdown", f"""
WITH {ITEMS_SQL}, b AS (SELECT content_id, unnest([{{'l': '신선도', 'p': f, 'i': 1}}, {{'l': '공식 소스', 'p': CASE WHEN tier = 'OFFICIAL' THEN 60 END, 'i': 2}}, {{'l': '국내', 'p': CASE WHEN region = 'KR' THEN 40 END, 'i': 3}},
 {{'l': '예약 임박', 'p': CASE WHEN preorder THEN 30 END, 'i': 4}}, {{'l': '한정판', 'p': CASE WHEN product AND limited THEN 30 END, 'i': 5}}]) AS c FROM fresh)
SELECT content_id, string_agg(c.l || ' ' || c.p, ', ' ORDER BY c.p DESC, c.i) AS breakdown FROM b WHERE c.p IS NOT NULL GROUP BY content_id""")
def score_breakdown(spark, sf):
    parts = cards.breakdown_of(cards.score_components(cards.item_columns(_content(spark, sf)), F.lit(NOW)))
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", p["label"], F.round(p["points"] * 10).cast("bigint").cast("string"))), ", ")
    return _content(spark, sf).select("content_id", text.alias("breakdown")).filter("breakdown <> ''")


@query("card_view", f"""
WITH {ITEMS_SQL} SELECT content_id, CASE WHEN limited THEN '한정판 ' ELSE '' END || event_id AS title_text, 'https://e.example/' || event_id AS url,
 strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') = '2024-01-31' AS is_new_today, source || ' · ' || CASE category WHEN 'ANIME' THEN '애니' WHEN 'CHARACTER' THEN '캐릭터' WHEN 'FIGURE' THEN '피규어' WHEN 'GOODS' THEN '굿즈' WHEN 'COLLECTION' THEN '컬렉션'
 WHEN 'FESTIVAL' THEN '페스티벌' ELSE '미분류' END || ' · 뉴스 · ' || CASE WHEN tier = 'OFFICIAL' THEN '공식' ELSE '미디어' END || ' · ' || CASE status WHEN 'NEW' THEN '새 항목' WHEN 'KEEP' THEN '채택' WHEN 'HOLD' THEN '보류' ELSE '무시' END
 || ' · ' || CASE WHEN posted THEN '발행 ' || strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') ELSE '미발행' END || ' · 수집 ' || strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS meta,
 CASE WHEN tier = 'OFFICIAL' AND strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') = '2024-01-31' THEN 'OFFICIAL,NEW' WHEN tier = 'OFFICIAL' THEN 'OFFICIAL' WHEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') = '2024-01-31' THEN 'NEW' ELSE '' END AS signals FROM keyed""")
def card_view(spark, sf):
    view = cards.card_view(_content(spark, sf), NOW)
    return view.select("content_id", "view.title_text", "view.url", "view.is_new_today", "view.meta", F.array_join("view.signal_labels", ",").alias("signals"))


@query("recommended_top10", f"""
WITH {ITEMS_SQL}, pool AS (SELECT * FROM scored WHERE ts >= {NOW_SQL} - INTERVAL 14 DAY ORDER BY ts DESC, content_id LIMIT 200)
SELECT content_id, tenths / 10.0::DOUBLE AS score FROM pool WHERE status <> 'IGNORE' AND NOT posted ORDER BY tenths DESC, ts DESC, content_id LIMIT 10""")
def recommended_top10(spark, sf):
    return feed.recommended(_content(spark, sf), NOW).select("content_id", F.col("signal_score").alias("score"))


@query("inbox_page", f"""
WITH {ITEMS_SQL}, page AS (SELECT * FROM scored WHERE ts >= {NOW_SQL} - INTERVAL 14 DAY ORDER BY ts DESC, content_id DESC LIMIT 30)
SELECT content_id, source, tenths / 10.0::DOUBLE AS score FROM page WHERE status <> 'IGNORE' AND NOT posted""")
def inbox_page(spark, sf):
    rows = feed.inbox_page(_content(spark, sf), NOW, status="ACTIVE", unposted=True)
    return rows.select("content_id", "source", F.col("signal_score").alias("score"))


@query("keyset_page", f"""
WITH {ITEMS_SQL}, p1 AS (SELECT * FROM keyed WHERE category = 'FIGURE' ORDER BY ts DESC, content_id DESC LIMIT 30), c AS (SELECT ts, content_id FROM p1 ORDER BY ts, content_id LIMIT 1)
SELECT k.content_id FROM keyed k, c WHERE category = 'FIGURE' AND (k.ts < c.ts OR (k.ts = c.ts AND k.content_id < c.content_id)) ORDER BY k.ts DESC, k.content_id DESC LIMIT 30""")
def keyset_page(spark, sf):
    """The second page of a category, from the first one's cursor."""
    content = _content(spark, sf)
    cursor = feed.page_cursor(feed.keyset_page(content, NOW, category="FIGURE")).first()
    after = (cursor.after_collected_at.astimezone(), cursor.after_id)
    return feed.keyset_page(content, NOW, category="FIGURE", after=after).select("content_id")


@query("page_cursor", f"""
WITH {ITEMS_SQL}, p1 AS (SELECT * FROM keyed ORDER BY ts DESC, content_id DESC LIMIT 30) SELECT count(*) = 30 AS has_more, min_by(content_id, (ts, content_id)) AS after_id FROM p1""")
def page_cursor(spark, sf):
    return feed.page_cursor(feed.keyset_page(_content(spark, sf), NOW)).select("has_more", "after_id")


@query("source_options", f"""
WITH {ITEMS_SQL}, p1 AS (SELECT * FROM keyed ORDER BY ts DESC, content_id DESC LIMIT 30) SELECT DISTINCT source FROM p1""")
def source_options(spark, sf):
    return feed.source_options(feed.keyset_page(_content(spark, sf), NOW))


@query("latest_edits", """
SELECT user_id, max_by(st, (ts, event_id)) FILTER (WHERE event_type = 'view' AND st <> 'OTHER') AS status, strftime(max(ts) FILTER (WHERE event_type = 'click'), '%Y-%m-%d %H:%M:%S') AS posted,
 max_by('note ' || event_id, (ts, event_id)) FILTER (WHERE event_type = 'signup') AS note
FROM (SELECT *, list_extract(['NEW','KEEP','HOLD','IGNORE','OTHER'], CAST(event_id % 5 + 1 AS INTEGER)) AS st FROM events) GROUP BY user_id""")
def latest_edits(spark, sf):
    e = table(spark, sf, "events")
    value = F.element_at(F.array(*[F.lit(x) for x in ("NEW", "KEEP", "HOLD", "IGNORE", "OTHER")]), (F.col("event_id") % 5 + 1).cast("int"))
    field = F.when(F.col("event_type") == "view", "status").when(F.col("event_type") == "click", "postedAt").when(F.col("event_type") == "signup", "note")
    edits = e.select(F.col("user_id").alias("content_id"), field.alias("field"), "ts", "event_id", F.when(
        F.col("event_type") == "signup", F.concat(F.lit(" note "), F.col("event_id").cast("string"))).otherwise(value).alias("value"))
    return store.latest_edits(edits, "event_id").select(
        F.col("content_id").alias("user_id"), F.col("edited_status").alias("status"), F.date_format("edited_postedAt", "yyyy-MM-dd HH:mm:ss").alias("posted"), F.col("edited_note").alias("note"))


@query("apply_edits", f"""
WITH {ITEMS_SQL} SELECT content_id, CASE WHEN event_type = 'view' AND k.event_id % 5 < 4 THEN list_extract(['IGNORE','HOLD','KEEP','NEW'], CAST(k.event_id % 5 + 1 AS INTEGER)) ELSE status END AS status,
 posted OR event_type = 'click' AS posted, CASE WHEN event_type = 'signup' THEN 'note ' || k.event_id END AS note FROM keyed k JOIN events USING (event_id)""")
def apply_edits(spark, sf):
    """Every event edits its own row: a status that may be unknown, a publish time, a note, or nothing."""
    content = _content(spark, sf)
    value = F.element_at(F.array(*[F.lit(x) for x in ("IGNORE", "HOLD", "KEEP", "NEW", "OTHER")]), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.col("event_type")
    field = F.when(kind == "view", "status").when(kind == "click", "postedAt").when(kind == "signup", "note").otherwise("else")
    ids = content.select("content_id", F.split_part("content_id", F.lit(":"), F.lit(2)).cast("bigint").alias("event_id"))
    edits = table(spark, sf, "events").join(ids, "event_id").select("content_id", field.alias("field"), "ts", F.when(
        kind == "signup", F.concat(F.lit(" note "), F.col("event_id").cast("string"))).otherwise(value).alias("value"))
    rows = store.apply_edits(store.conform(content), edits)
    return rows.select("content_id", "status", F.col("postedAt").isNotNull().alias("posted"), "note")


@query("run_report", """
SELECT coalesce('user-' || user_id, 'TOTAL') AS source, count(*) AS processed, count(*) FILTER (WHERE event_type = 'signup') AS inserted, count(*) FILTER (WHERE event_type <> 'signup') AS existing,
 count(*) FILTER (WHERE event_type = 'purchase') AS updated, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY ROLLUP (user_id)""")
def run_report(spark, sf):
    is_ = lambda name: (F.col("event_type") == name).cast("int")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"), is_("signup").alias("inserted"), (1 - is_("signup")).alias("existing"),
        is_("purchase").alias("updated"), is_("error").alias("failed"))
    return reports.run_report(rows)


@query("error_summary", """
WITH e AS (SELECT user_id, 'item ' || event_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error')
SELECT user_id AS source, string_agg(m, '; ' ORDER BY r) || CASE WHEN max(n) > 2 THEN ' 외 ' || (max(n) - 2) || '건' ELSE '' END AS note FROM e WHERE r <= 2 GROUP BY user_id""")
def error_summary(spark, sf):
    errors = table(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("source"), F.col("event_id").alias("seq"), F.concat(F.lit("item "), F.col("event_id").cast("string")).alias("message"))
    return reports.error_summary(errors)


@query("source_eligibility", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '비활성화' WHEN s_suppkey % 4 = 1 THEN '수동 전용' WHEN s_suppkey % 5 = 0 THEN '지원하지 않는 수집 방식: ftp' END AS skip_reason,
 s_suppkey % 4 > 1 AND s_suppkey % 5 = 0 AS counts_as_failed FROM supplier""")
def source_eligibility(spark, sf):
    k = F.col("s_suppkey")
    sources = table(spark, sf, "supplier").select(
        "s_suppkey", (k % 4 != 0).alias("enabled"), (k % 4 == 1).alias("manual_only"), F.lit(None).cast("boolean").alias("local_only"),
        F.when(k % 5 == 0, "ftp").when(k % 5 == 1, "rss").otherwise("html").alias("type"))
    return reports.eligibility(sources).select("s_suppkey", "skip_reason", "counts_as_failed")


@query("overlay_merge", """
WITH o AS (SELECT c_custkey AS k, c_name AS extract, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS shop FROM customer)
SELECT s_suppkey AS key, coalesce(o.extract, s_name) AS extract, coalesce(CASE WHEN s_suppkey % 20 = 0 THEN NULL ELSE 'own' END, o.shop) AS shop, 'yes' AS enabled FROM supplier LEFT JOIN o ON k = s_suppkey
UNION ALL SELECT k, extract, coalesce(shop, 'none'), 'no' FROM o WHERE k NOT IN (SELECT s_suppkey FROM supplier)""")
def overlay_merge(spark, sf):
    key = F.col("s_suppkey")
    base = table(spark, sf, "supplier").select(key.alias("key"), F.col("s_name").alias("extract"), F.when(key % 20 != 0, "own").alias("shop"), F.lit("yes").alias("enabled"))
    c = F.col("c_custkey")
    overlay = table(spark, sf, "customer").select(c.alias("key"), F.col("c_name").alias("extract"), F.when(c % 2 == 0, F.col("c_mktsegment")).alias("shop"))
    return dims.overlay_merge(base, overlay, "key", ["extract"], ["shop"], {"enabled": "no", "shop": "none"})


@query("listing_metadata", """
SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'UNKNOWN') AS category, CASE WHEN c_custkey % 2 = 0 THEN 'OFFICIAL' ELSE 'MEDIA' END AS tier, 'NEWS' AS angle, '' AS summary FROM orders JOIN customer ON o_custkey = c_custkey""")
def listing_metadata(spark, sf):
    c, none = F.col("c_custkey"), F.lit(None).cast("string")
    sources = table(spark, sf, "customer").select(
        c.alias("name"), F.lit("html").alias("type"), none.alias("url"), none.alias("region"), F.when(c % 3 == 0, F.col("c_mktsegment")).alias("category"),
        none.alias("content_angle"), F.when(c % 2 == 0, "OFFICIAL").alias("source_tier"))
    listed = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("source"))
    rows = fields.default_metadata(listed.join(sources.select(F.col("name").alias("source")), "source", "left_semi"), sources)
    return rows.select("o_orderkey", "category", F.col("sourceTier").alias("tier"), F.col("contentAngle").alias("angle"), "summary")


@query("manual_intake", f"""
WITH i AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://store.laftel.net/products/' || page_id WHEN 1 THEN 'nope' ELSE url END AS url FROM pages)
SELECT page_id AS seq, CASE WHEN page_id % 5 = 0 THEN url ELSE {norm_sql("url")} END AS url, CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 'Laftel Store' ELSE '수동 입력' END AS source,
 CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 'Laftel' END AS shop, CASE WHEN page_id % 3 = 0 THEN '(제목 없음)' ELSE 'p' || page_id END AS title FROM i WHERE page_id % 5 NOT IN (1, 2)""")
def manual_intake(spark, sf):
    p = F.col("page_id")
    rows = table(spark, sf, "pages").select(
        p.alias("seq"), F.when(p % 5 == 0, F.concat(F.lit("https://store.laftel.net/products/"), p.cast("string"))).when(p % 5 == 1, "nope").otherwise(F.col("url")).alias("url"),
        F.when(p % 3 == 0, " ").otherwise(F.concat(F.lit("p"), p.cast("string"))).alias("title"), F.when(p % 2 == 0, "FIGURE").otherwise("GOODS").alias("category"),
        F.lit("NEWS").alias("angle"), F.lit(None).cast("string").alias("tier"), F.when(p % 5 == 2, "javascript:x").alias("image_url"))
    return intake.manual_entries(rows)[0].select("seq", "url", "source", "shop", "title")


@query("rendered_cards", """
SELECT p_partkey AS pos, 'https://r.example/products/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_type ELSE p_brand || ' 상품' END AS title, p_partkey * 37 + 2000 AS price,
 CASE WHEN p_size % 3 = 0 THEN 'https://r.example/ok.jpg' END AS image_url FROM part WHERE p_type <> 'LARGE'""")
def rendered_cards(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("/products/"), p.cast("string"))
    image = lambda src, side: F.struct(F.lit("").alias("lazy"), F.lit(src).alias("src"), F.lit(side).alias("width"), F.lit(side).alias("height"))
    none = F.lit(None).cast("string")
    cards_ = spread(table(spark, sf, "part"), PAGE_ROWS).select(
        F.lit("r").alias("source"), F.lit(1).alias("page_no"), p.alias("pos"), F.lit("https://r.example/list").alias("page_url"),
        F.when(size % 4 == 0, path).when(size % 4 == 1, "javascript:void(0)").alias("href"), F.when(size % 4 == 1, path).alias("data_href"), none.alias("data_url"),
        F.when(size % 4 > 1, F.concat(F.lit("go('"), path, F.lit("')"))).alias("onclick"),
        F.when(size % 2 == 0, F.concat_ws("\n ", "p_name", "p_type")).otherwise("더").alias("link_text"),
        F.concat(F.lit(" x\n"), "p_brand", F.lit(" 상품\n"), F.col("p_type"), F.lit(" "), F.format_number(p * 37 + 2000, 0), F.lit("원")).alias("context_text"),
        F.when(size % 3 == 0, F.array(image("/logo.png", 300), image("/small.jpg", 40), image("/ok.jpg", 0))).otherwise(F.array(image("/small.jpg", 40))).alias("images"))
    sources = dims.sources_table(spark, [{"name": "r", "type": "local_browser", "product_mode": True, "allow_patterns": ["/PRODUCTS/"], "required_text_patterns": ["small|economy|standard|medium|promo"]}])
    rows = intake.rendered_cards(dims.with_source(cards_, sources), NOW)
    return rows.select("pos", "url", "title", "price", F.col("imageUrl").alias("image_url"))


@query("translation_backfill", """
WITH d AS (SELECT doc_id, doc_id % 4 = 0 AS has_ko, length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) > 0 AS need, md5(text) AS k FROM documents),
t AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE lang <> 'de')
SELECT count(*) AS processed, count(*) FILTER (WHERE NOT has_ko AND need AND k IN (SELECT k FROM t)) AS updated, count(*) FILTER (WHERE has_ko OR NOT need) AS skipped,
 count(*) FILTER (WHERE NOT has_ko AND need AND k NOT IN (SELECT k FROM t)) AS failed FROM d""")
def translation_backfill(spark, sf):
    docs = table(spark, sf, "documents")
    content = store.conform(docs.select(F.col("doc_id").cast("string").alias("content_id"), F.col("text").alias("title"), F.when(F.col("doc_id") % 4 == 0, "제목").alias("titleKo")))
    known = docs.filter("lang <> 'de'").select(backfill.text_hash(F.col("text")).alias("text_hash")).distinct()
    translations = known.withColumn("text_ko", F.lit("번역")).withColumn("language", F.lit("en"))
    return backfill.translation_counters(content, backfill.translate(content, translations, NOW))


# --- works --------------------------------------------------------------------------------------
# A work per benchmark item: its first two words, with its third word as an alias.
WORKS_SQL = """
works AS (SELECT item_id, string_split(regexp_replace(text, '[.,\\n]+', ' ', 'g'), ' ') AS w FROM benchmark),
kw0 AS (SELECT item_id, list_extract(w, 1) || ' ' || list_extract(w, 2) AS name, unnest([list_extract(w, 1) || ' ' || list_extract(w, 2), list_extract(w, 3)]) AS k FROM works),
kw1 AS (SELECT item_id, trim(regexp_replace(replace(lower(name), 'ß', 'ss'), '\\s+', ' ', 'g')) AS nn, trim(name) AS name, trim(regexp_replace(replace(lower(k), 'ß', 'ss'), '\\s+', ' ', 'g')) AS norm FROM kw0 WHERE trim(k) <> ''),
names AS (SELECT nn, min(item_id) AS work_ord, min_by(name, item_id) AS work FROM kw1 GROUP BY nn),
kw AS (SELECT DISTINCT work_ord, work, norm FROM kw1 JOIN names USING (nn) WHERE length(norm) >= 2),
texts AS (SELECT doc_id, source, trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), ':', ' '), '\\s+', ' ', 'g')) AS t FROM documents),
pairs AS (SELECT DISTINCT doc_id, source, work_ord, work FROM texts JOIN kw ON contains(t, norm) AND CASE WHEN regexp_matches(norm, '^[ -~]*$')
 THEN regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(norm) || '($|[^a-z0-9])') ELSE true END)"""


def _works(spark, sf) -> DataFrame:
    w = F.split(F.regexp_replace("text", r"[.,\n]+", " "), " ")
    # element order is the benchmark's; the dictionary stays as small as that table.
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.concat_ws(" ", w[0], w[1]).alias("name"), F.array(w[2]).alias("aliases"))


def _matched(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("title"))
    return W.with_works(docs, W.work_keywords(_works(spark, sf)), "doc_id", "title")


@query("work_match", f"WITH {WORKS_SQL} SELECT doc_id, string_agg(work, '|' ORDER BY work_ord) AS works FROM pairs GROUP BY doc_id")
def work_match(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", fold_title(F.col("text")).alias("t"))
    found = W.match_works(texts, W.work_keywords(_works(spark, sf)), "doc_id", "t")
    return found.select("doc_id", F.array_join("works", "|").alias("works"))


@query("work_match_wide", f"WITH {WORKS_SQL} SELECT doc_id, work_ord, work FROM pairs")
def work_match_wide(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", fold_title(F.col("text")).alias("t"))
    return W.match_pairs(texts, W.work_keywords(_works(spark, sf)), "doc_id", "t").select("doc_id", "work_ord", "work")


@query("work_match_hot", f"""
WITH {WORKS_SQL}, hot AS (SELECT doc_id, source, 'scale figure ' || t || ' 한정판' AS t FROM texts),
more AS (SELECT work_ord, work, norm FROM kw UNION ALL SELECT * FROM (VALUES (-4, 'Figure', 'figure'), (-3, '한정판', '한정판'), (-2, 'Scale Figure', 'scale figure'),
 (-1, 'Figure Of Nobody', 'figure of nobody')))
SELECT work_ord, any_value(work) AS work, count(DISTINCT doc_id) AS items FROM hot JOIN more ON contains(t, norm) AND CASE WHEN regexp_matches(norm, '^[ -~]*$')
 THEN regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(norm) || '($|[^a-z0-9])') ELSE true END GROUP BY work_ord""")
def work_match_hot(spark, sf):
    """Items per work where some keywords stand in every text and one has only common words."""
    title = F.concat(F.lit("Scale figure "), fold_title(F.col("text")), F.lit(" 한정판"))
    texts = table(spark, sf, "documents").select("doc_id", fold_title(title).alias("t"))
    hot = spark.createDataFrame(
        [(-4, "Figure"), (-3, "한정판"), (-2, "Scale Figure"), (-1, "Figure Of Nobody")], "ord int, name string").withColumn("aliases", F.array().cast("array<string>"))
    works = _works(spark, sf).unionByName(hot)
    found = W.match_pairs(texts, W.work_keywords(works), "doc_id", "t")
    return found.groupBy("work_ord").agg(F.min("work").alias("work"), F.count(F.lit(1)).alias("items"))


@query("coverage_audit", f"""
WITH {WORKS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM pairs)) AS unclassified FROM documents""")
def coverage_audit(spark, sf):
    return W.coverage(_matched(spark, sf))


@query("unmatched_items", f"WITH {WORKS_SQL} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pairs)")
def unmatched_items(spark, sf):
    return W.unmatched(_matched(spark, sf)).select("doc_id")


@query("visible_aliases", f"""
WITH {WORKS_SQL}, words AS (SELECT work_ord, work, norm, min_by(k, ord) AS k, min(ord) AS ord FROM (SELECT work_ord, work, trim(regexp_replace(replace(lower(k), 'ß', 'ss'), '\\s+', ' ', 'g')) AS norm, trim(k) AS k, item_id * 2 + CASE WHEN k = name0 THEN 0 ELSE 1 END AS ord
 FROM (SELECT item_id, name AS name0, k, trim(regexp_replace(replace(lower(name), 'ß', 'ss'), '\\s+', ' ', 'g')) AS nn FROM kw0 WHERE trim(k) <> '') JOIN names USING (nn)) GROUP BY 1, 2, 3)
SELECT work_ord, work AS name, string_agg(k, '|' ORDER BY ord) AS aliases FROM words WHERE work IN (SELECT work FROM pairs) GROUP BY 1, 2""")
def visible_aliases(spark, sf):
    return W.visible_aliases(_matched(spark, sf), _works(spark, sf)).select("work_ord", "name", F.array_join("aliases", "|").alias("aliases"))


@query("facets", f"""
WITH {WORKS_SQL} SELECT 'work' AS kind, work AS value, count(*) AS n FROM pairs GROUP BY work UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'category', upper(lang), count(*) FROM documents GROUP BY lang UNION ALL SELECT 'total', '', count(*) FROM documents
UNION ALL SELECT 'unclassified', '', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pairs) HAVING count(*) > 0""")
def facets(spark, sf):
    lang = table(spark, sf, "documents").select("doc_id", F.upper("lang").alias("category"))
    return feed.facets(_matched(spark, sf).drop("title").join(lang, "doc_id"))


def _feed(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    at = F.timestamp_micros(F.unix_micros(F.lit(NOW)) - F.col("doc_id") * 600_000_000)
    rows = _matched(spark, sf).join(docs.select("doc_id", at.alias("collectedAt"), F.when(F.col("doc_id") % 5 == 0, "OFFICIAL").alias("sourceTier"), F.upper("lang").alias("category")), "doc_id")
    return cards.feed_items(rows.withColumn("content_id", F.lpad(F.col("doc_id").cast("string"), 9, "0")), NOW)


FEED_SQL = WORKS_SQL + f""",
feed AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, doc_id, source, upper(lang) AS category, lower(text) AS low, doc_id * 600000000 AS age, 216 * 3600000000 AS h,
 (SELECT count(*) FROM pairs p WHERE p.doc_id = d.doc_id) AS n_works FROM documents d),
scores AS (SELECT *, CASE WHEN age < h THEN ((h - age) * 700 + h) // (2 * h) ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 60 ELSE 0 END AS tenths FROM feed)"""


@query("feed_page", f"WITH {FEED_SQL} SELECT id, tenths / 10.0::DOUBLE AS score, n_works FROM scores WHERE category = 'EN' AND age <= 7 * 86400000000 ORDER BY tenths DESC, age, id LIMIT 60 OFFSET 60")
def feed_page(spark, sf):
    """The second block of sixty of a filtered, sorted feed."""
    page = feed.query_feed(_feed(spark, sf), NOW, category="EN", days="7", step=1)
    return page.select("id", F.col("signal_score").alias("score"), F.size("works").cast("bigint").alias("n_works"))


@query("feed_search", f"""
WITH {FEED_SQL} SELECT id FROM scores WHERE contains(trim(regexp_replace(replace(low, ':', ' '), '\\s+', ' ', 'g')) || ' ' || source || ' ' ||
 coalesce((SELECT string_agg(lower(work), ' ' ORDER BY work_ord) FROM pairs p WHERE p.doc_id = scores.doc_id), ''), 'the th')""")
def feed_search(spark, sf):
    items = _feed(spark, sf)
    none = small_table(spark, [], "name string, aliases array<string>")
    return feed.query_feed(feed.with_search_text(items, none), NOW, q="The  TH").select("id")


@query("compare_digest", f"""
WITH c AS (SELECT p_brand, p_name, p_partkey, p_size % 7 <> 0 AS product, {CAPTION_SQL} AS caption, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
k AS (SELECT *, CASE WHEN caption = '' THEN 's' ELSE caption END AS facts FROM c WHERE r <= 20)
SELECT p_brand, string_agg(r || '. ' || p_name || chr(10) || '   ' || facts, chr(10) ORDER BY r) || chr(10) AS body,
 CASE WHEN bool_or(product) THEN '상품 페이지 참고 ↓' ELSE '링크 ↓' END || chr(10) || chr(10) || string_agg(r || '. ' || p_name || chr(10) || 'https://e.example/' || p_partkey, chr(10) || chr(10) ORDER BY r) || chr(10) AS reply FROM k GROUP BY p_brand""")
def compare_digest(spark, sf):
    part = table(spark, sf, "part")
    pieces = part.select("p_brand", "p_retailprice", "p_partkey", cards.post_piece(_product(part), F.lit("2024-02-15")).alias("post"))
    ranked = feed.top_per_group(pieces, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")])
    return feed.digest(ranked, ["p_brand"]).select("p_brand", "body", "reply")




@query("top_listings", f"""
WITH {FIRST_SQL}, {WORKS_SQL}, m AS (SELECT DISTINCT url, source, page_no, https, work FROM (SELECT *, url LIKE 'https%' AS https, trim(regexp_replace(replace(replace(lower(title), 'ß', 'ss'), ':', ' '), '\\s+', ' ', 'g')) AS t FROM first_seen)
 JOIN kw ON contains(t, norm) AND CASE WHEN regexp_matches(norm, '^[ -~]*$') THEN regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(norm) || '($|[^a-z0-9])') ELSE true END),
g AS (SELECT url, source, page_no, https, count(*) AS n_works, page_no * 3600000000 AS age, 216 * 3600000000 AS h FROM m GROUP BY 1, 2, 3, 4)
SELECT sha256(url) AS doc_id, url, source, n_works, (CASE WHEN age < h THEN ((h - age) * 700 + h) // (2 * h) ELSE 0 END + CASE WHEN https THEN 60 ELSE 0 END) / 10.0::DOUBLE AS score
FROM g ORDER BY score DESC, page_no, url LIMIT 10""")
def top_listings(spark, sf):
    """The flagship: pages to listings, first-seen identity, work matching, scores, the best ten."""
    rows = _listed(spark, sf).select("source", "page_no", "pos", "url", "title")
    first = materialize(first_seen_rows(rows, ["source", "url"], ["page_no", "pos"]), "listings").withColumn("content_id", F.sha2("url", 256))
    matched = W.with_works(first, W.work_keywords(_works(spark, sf))).filter(F.size("works") > 0)
    age = F.col("page_no") * 3_600_000_000
    dated = matched.withColumn("collectedAt", F.timestamp_micros(F.unix_micros(F.lit(NOW)) - age)).withColumn(
        "sourceTier", F.when(F.startswith("url", F.lit("https")), "OFFICIAL"))
    best = cards.with_score(dated, NOW).orderBy(F.desc("signal_score"), F.desc("effective_date"), "url").limit(10)
    return best.select(F.col("content_id").alias("doc_id"), "url", "source", F.size("works").cast("bigint").alias("n_works"), F.col("signal_score").alias("score"))
