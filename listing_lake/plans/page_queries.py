"""Queries over the pages table: identity, links, cards, listings, merge and frontier."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from listing_lake.functions import urls
from listing_lake.functions.text import squish
from listing_lake.operators import backfill, dedupe, details, frontier, listings, nodes as N, snapshots, store
from listing_lake.operators.shred import elements, shred_pages
from listing_lake.plans.registry import HOST_SQL, NOW, norm_sql, query, squish_sql, table
from listing_lake.session import PAGE_ROWS, materialize, shared_dir, spread
from listing_lake.sources import dims, pages as P

NORM = norm_sql("url")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").withColumn("source", urls.parts(F.col("url")).host)


@query("url_normalize", f"SELECT page_id, {NORM} AS url_norm FROM pages")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"))


@query("doc_id", f"SELECT page_id, sha256({NORM}) AS doc_id FROM pages")
def doc_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.doc_id(urls.normalize_url(F.col("url"))).alias("doc_id"))


@query("tracking_params", f"""
SELECT lower(split_part(p, '=', 1)) AS param, count(*) AS n
FROM (SELECT unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) AS p FROM pages)
WHERE lower(split_part(p, '=', 1)) IN ('utm_source','utm_medium','utm_campaign','fbclid','gclid') GROUP BY 1""")
def tracking_params(spark, sf):
    keys = F.explode(F.split(urls.parts(F.col("url")).query, "&")).alias("p")
    named = table(spark, sf, "pages").select(keys).select(F.lower(F.split_part("p", F.lit("="), F.lit(1))).alias("param"))
    wanted = ("utm_source", "utm_medium", "utm_campaign", "fbclid", "gclid")
    return named.filter(F.col("param").isin(*wanted)).groupBy("param").agg(F.count(F.lit(1)).alias("n"))


@query("url_host_rules", f"""
WITH u AS (SELECT page_id, {NORM} AS n FROM pages),
s AS (SELECT page_id, n, regexp_extract(n, '^https?://([^/?#]*)', 1) AS h, regexp_extract(n, '[?&]page=(\\d+)$|[?&]page=(\\d+)&', 1) AS q1,
 regexp_extract(n, '[?&]page=(\\d+)&', 1) AS q2, regexp_extract(n, '^https?://[^/?#]*/[a-z]+/(\\d+)(\\.html)?/?(\\?.*)?$', 1) AS p FROM u),
k AS (SELECT *, CASE WHEN q1 <> '' THEN q1 WHEN q2 <> '' THEN q2 WHEN p <> '' THEN p END AS id FROM s)
SELECT page_id, CASE WHEN regexp_matches(h, '^(m|www|blog)\\.') AND id IS NOT NULL
 THEN regexp_extract(n, '^https?://') || regexp_replace(h, '^(m|www|blog)\\.', '') || '/item?id=' || id ELSE n END AS url_canonical FROM k""")
def url_host_rules(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"))
    host = urls.parts(F.col("url_norm")).host
    rules = pages.select(host.alias("host")).distinct().filter(F.col("host").rlike(r"^(m|www|blog)\.")).select(
        "host", F.regexp_replace("host", r"^(m|www|blog)\.", "").alias("canonical_host"), F.lit("page").alias("id_param"),
        F.lit(r"^/[a-z]+/(\d+)(?:\.html)?/?$").alias("path_regex"), F.lit("/item?id={id}").alias("template"))
    return urls.apply_host_rules(pages, rules).select("page_id", "url_canonical")


@query("listing_page_urls", """
WITH e AS (SELECT page_id, url, unnest(range(1, 4)) AS page_no FROM pages),
q AS (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) <> 'page') AS kept FROM e)
SELECT page_id, CAST(page_no AS INTEGER) AS page_no, CASE WHEN page_no = 1 THEN url ELSE regexp_extract(url, '^[^?#]*') || '?' ||
 array_to_string(list_append(kept, 'page=' || page_no), '&') || regexp_extract(url, '#.*$') END AS page_url FROM q""")
def listing_page_urls(spark, sf):
    sources = table(spark, sf, "pages").select("page_id", "url", F.lit("page").alias("page_param"), F.lit(3).alias("max_pages"))
    return frontier.expand_pages(sources).select("page_id", "page_no", "page_url")


@query("decode_pages", """
SELECT page_id, sha256('<meta charset="' || CASE page_id % 3 WHEN 0 THEN 'iso-8859-1' WHEN 1 THEN 'utf-8' ELSE 'unheard-of' END || '">' || html) AS digest,
 CAST(length(html) AS BIGINT) AS n_chars FROM pages""")
def decode_pages(spark, sf):
    pages = table(spark, sf, "pages")
    kind = F.col("page_id") % 3
    name = F.when(kind == 0, "iso-8859-1").when(kind == 1, "utf-8").otherwise("unheard-of")
    text = F.concat(F.lit('<meta charset="'), name, F.lit('">'), F.col("html"))
    raw = pages.select("page_id", F.lit("text/html").alias("content_type"), F.when(
        kind == 0, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("body"), F.length(text) .alias("n"), F.length("html").alias("m"))
    decoded = P.decode_pages(raw)
    return decoded.select("page_id", F.sha2("html", 256).alias("digest"), (F.length("html") - F.col("n") + F.col("m")).cast("bigint").alias("n_chars"))


# --- elements -----------------------------------------------------------------------------------
@query("page_tags", """
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM
 (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""")
def page_tags(spark, sf):
    long = elements(shred_pages(table(spark, sf, "pages")))
    per_page = long.filter(~F.col("tag").startswith("#")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_pages"))


TEXT_SQL = """array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '<[^>]*>', chr(1), 'g'), chr(1)),
 lambda x: replace(replace(replace(replace(trim(x, ' ' || chr(10)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), lambda x: x <> ''), ' ')"""


@query("page_text", f"""
SELECT page_id, sha256({TEXT_SQL.format("regexp_extract(html, '<body>(.*)$', 1, 's')")}) AS digest,
 CAST(length({TEXT_SQL.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}) AS BIGINT) AS n_title FROM pages""")
def page_text(spark, sf):
    nodes = F.col("nodes")
    body = F.try_element_at(N.select_all(nodes, N.literal_selector("body")), F.lit(1))
    head = F.try_element_at(N.select_all(nodes, N.literal_selector("article > h1")), F.lit(1))
    shredded = shred_pages(table(spark, sf, "pages").select("page_id", "url", "html"), selectors=("body", "article > h1"))
    return shredded.select(
        "page_id", F.sha2(N.visible_text(N.subtree(nodes, body), " "), 256).alias("digest"),
        F.length(N.text_of(nodes, head)).cast("bigint").alias("n_title"))


FORMS = {
    "nav:has(a) > ul > li": "len(regexp_extract_all(html, '<li>'))",
    'ul:has(a[href*="e"]) > li': "CASE WHEN regexp_matches(html, '<a href=\"[^\"]*e') THEN len(regexp_extract_all(html, '<li>')) ELSE 0 END",
    "li:not(:has(b)), li:has(b)": "len(regexp_extract_all(html, '<li>'))",
    'a[href^="/t"]': "len(regexp_extract_all(html, '<a href=\"/t'))",
    "html > body div.ad": "len(regexp_extract_all(html, '<div class=\"ad\">'))",
    'body:has(nav) > div.ad:-soup-contains("au")':
        "CASE WHEN contains(regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1), 'au') THEN 1 ELSE 0 END",
    "head:has(> title) > meta[charset]": "1",
    "body > li, nav > li": "0",
}


@query("selector_forms", " UNION ALL ".join(
    f"SELECT page_id, {nth} AS form, CAST({sql} AS BIGINT) AS picked FROM pages" for nth, sql in enumerate(FORMS.values())))
def selector_forms(spark, sf):
    """How many elements each form of selector picks on every page."""
    nodes = F.col("nodes")
    picked = F.array(*[F.size(N.select_all(nodes, N.literal_selector(css))).cast("bigint") for css in FORMS])
    shredded = shred_pages(table(spark, sf, "pages").select("page_id", "url", "html"), selectors=tuple(FORMS))
    return shredded.select("page_id", F.posexplode(picked).alias("form", "picked"))


LINKS_SQL = f"""
raw AS (SELECT page_id, url, {HOST_SQL} AS source, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hs,
 regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS ts FROM pages),
x AS (SELECT page_id, url, source, unnest(range(1, len(hs) + 1)) AS k, hs, ts FROM raw),
l AS (SELECT page_id, source, k, regexp_extract(url, '^https?://[^/?#]*') || replace(list_extract(hs, k), '&amp;', '&') AS link,
 {squish_sql("replace(list_extract(ts, k), '&amp;', '&')")} AS title FROM x),
links AS (SELECT page_id, source, k, {norm_sql("link")} AS url, title FROM l)"""


def _links(spark, sf):
    """(page_id, source, k, url, title) of every link, k in document order."""
    nodes = F.col("nodes")
    found = F.filter(nodes, lambda n: N.matches(n, N.literal_selector("a[href]")) & n["link"].isNotNull())
    rows = shred_pages(_pages(spark, sf)).select("page_id", "source", F.posexplode(F.transform(
        found, lambda n: F.struct(n["link"].alias("link"), N.text_of(nodes, n).alias("text")))).alias("i", "l"))
    return rows.select(
        "page_id", "source", (F.col("i") + 1).cast("bigint").alias("k"), urls.normalize_url(F.col("l.link")).alias("url"),
        squish(F.col("l.text")).alias("title"))


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, k, url, title FROM links")
def page_links(spark, sf):
    return _links(spark, sf).select("page_id", "k", "url", "title")


@query("link_allow_deny", f"""
WITH {LINKS_SQL} SELECT page_id, k, url FROM links WHERE regexp_matches(url, '/[a-z]+$|/[A-Z]') AND NOT regexp_matches(url, 'th|ing$')
 AND length(title) >= 4 AND NOT regexp_matches(title, '^S')""")
def link_allow_deny(spark, sf):
    array = lambda *p: F.array(*[F.lit(x) for x in p])
    return _links(spark, sf).filter(
        urls.allowed(F.col("url"), array("/[a-z]+$", "/[A-Z]"), array("th", "ing$"))
        & (F.length("title") >= 4) & urls.allowed(F.col("title"), F.array().cast("array<string>"), array("^S"))
    ).select("page_id", "k", "url")


@query("card_resolution", f"""
WITH {LINKS_SQL}, keyed AS (SELECT page_id, k, title, split_part(link, '#', 1) AS key FROM l),
n AS (SELECT page_id, count(DISTINCT key) AS keys FROM keyed GROUP BY page_id)
SELECT page_id, k, CASE WHEN keys = 1 THEN 'nav' ELSE 'li' END AS card FROM keyed JOIN n USING (page_id)""")
def card_resolution(spark, sf):
    sources = dims.sources_table(spark, [{"name": "web", "type": "html", "link_selector": "nav a", "list_image_selector": "img"}])
    pages = dims.with_source(table(spark, sf, "pages").withColumn("cfg", F.lit("web")), sources, "cfg")
    nodes = F.col("nodes")
    found = listings.with_links(shred_pages(pages)).select("page_id", F.posexplode(F.transform(
        "links", lambda k: N.node(nodes, k["card"])["tag"])).alias("i", "card"))
    return found.select("page_id", (F.col("i") + 1).cast("bigint").alias("k"), "card")


WEB = {"name": "web", "type": "html", "link_selector": "nav li > a", "min_title_length": 4, "deny_patterns": ["ing$"],
       "title_strip_pattern": r"[.,]+$", "max_items": 20}


def _listed(spark, sf):
    """Typed listings of every page; a host is a source and a page one of its listing pages."""
    sources = dims.sources_table(spark, [WEB])
    pages = _pages(spark, sf).withColumn("cfg", F.lit("web")).withColumn("page_no", F.col("page_id"))
    return listings.extract_listings(shred_pages(dims.with_source(pages, sources, "cfg")), NOW)


LISTED_SQL = LINKS_SQL + """,
listed AS (SELECT source, page_id AS page_no, k AS pos, url, trim(regexp_replace(title, '[.,]+$', '')) AS title FROM links
 WHERE NOT regexp_matches(url, 'ing$') AND length(trim(regexp_replace(title, '[.,]+$', ''))) >= 4)"""
FIRST_SQL = LISTED_SQL + """,
first_seen AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY page_no, pos) AS r FROM listed) WHERE r = 1)"""
STOP_SQL = FIRST_SQL + f""",
read AS (SELECT DISTINCT {HOST_SQL} AS source, page_id AS page_no FROM pages),
per_page AS (SELECT r.source, r.page_no, count(f.url) AS n_new FROM read r LEFT JOIN first_seen f USING (source, page_no) GROUP BY 1, 2),
stops AS (SELECT source, min(page_no) FILTER (WHERE n_new = 0) AS stop_page FROM per_page GROUP BY 1),
kept AS (SELECT f.* FROM first_seen f JOIN stops USING (source) WHERE stop_page IS NULL OR page_no < stop_page),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_no, pos) AS listed_rank FROM kept)"""


@query("extract_listings", f"WITH {LISTED_SQL} SELECT source, page_no, url, title FROM listed")
def extract_listings(spark, sf):
    return _listed(spark, sf).select("source", "page_no", "url", "title")


@query("first_seen", f"WITH {FIRST_SQL} SELECT source, page_no, url, title FROM first_seen")
def first_seen(spark, sf):
    rows = _listed(spark, sf).select("source", "page_no", "pos", "url", "title")
    return dedupe.first_seen(rows, ["source", "url"], ["page_no", "pos"]).select("source", "page_no", "url", "title")


@query("page_stop", f"WITH {STOP_SQL} SELECT source, page_no, url FROM kept")
def page_stop(spark, sf):
    rows = materialize(_listed(spark, sf).select("source", "page_no", "pos", "url"))
    read = _pages(spark, sf).select("source", F.col("page_id").alias("page_no"))
    return dedupe.dedupe_listings(rows, read).select("source", "page_no", "url")


@query("item_limit", f"WITH {STOP_SQL} SELECT source, page_no, url, listed_rank FROM ranked WHERE listed_rank <= 20")
def item_limit(spark, sf):
    rows = materialize(_listed(spark, sf).select("source", "page_no", "pos", "url", F.col("src.max_items").alias("max_items")))
    read = _pages(spark, sf).select("source", F.col("page_id").alias("page_no"))
    kept = dedupe.dedupe_listings(rows, read, F.col("max_items"))
    return kept.select("source", "page_no", "url", F.col("listed_rank").cast("bigint").alias("listed_rank"))


@query("empty_listings", f"""
WITH {LISTED_SQL} SELECT {HOST_SQL} AS source, page_id AS page_no FROM pages WHERE page_id NOT IN (SELECT page_no FROM listed)""")
def empty_listings(spark, sf):
    read = _pages(spark, sf).select("source", F.col("page_id").alias("page_no"))
    return listings.empty_listings(read, _listed(spark, sf))


# --- content ------------------------------------------------------------------------------------
def _stored(pages: DataFrame) -> DataFrame:
    """The https pages as the content table, one document per URL."""
    norm = pages.filter(F.startswith("url", F.lit("https"))).withColumn("u", urls.normalize_url(F.col("url")))
    first = norm.groupBy("u").agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"))
    return store.conform(first.select(
        "url", F.concat(F.lit("old "), F.col("page_id").cast("string")).alias("title"), F.lit("KEEP").alias("status"),
        F.lit("GOODS").alias("storage_category"), urls.doc_id(F.col("u")).alias("doc_id"),
        F.concat(F.lit("GOODS:"), urls.doc_id(F.col("u"))).alias("content_id"),
        F.when(F.col("page_id") % 4 == 0, F.col("page_id")).alias("price")))


def _arrivals(pages: DataFrame) -> DataFrame:
    """Every page arrives twice: once with a tracking parameter and a price, once without either."""
    sep = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    tracked = F.concat(F.regexp_extract("url", "^[^#]*", 0), sep, F.lit("utm_medium=x"))
    common = [F.concat(F.lit("new "), F.col("page_id").cast("string")).alias("title"),
              F.when(F.col("page_id") % 3 == 0, "FIGURE").otherwise("ANIME").alias("category")]
    first = pages.select((F.col("page_id") * 2).alias("seq"), tracked.alias("url"), *common, (F.col("page_id") + 1000).alias("price"),
                         F.lit("https://i.example/a.jpg").alias("imageUrl"))
    second = pages.select((F.col("page_id") * 2 + 1).alias("seq"), "url", *common, F.lit(None).cast("bigint").alias("price"),
                          F.lit("javascript:x").alias("imageUrl"))
    return first.unionByName(second)


ARRIVED_SQL = f"""
p AS (SELECT page_id, url LIKE 'https%' AS old, {NORM} AS u FROM pages), g AS (SELECT u, min(page_id) AS first_id, max(page_id) AS last_id, count(*) AS n,
 min(page_id) FILTER (WHERE old) AS old_id, count(*) FILTER (WHERE old) AS n_old FROM p GROUP BY u)"""


@query("content_merge", f"""
WITH {ARRIVED_SQL}
SELECT 'GOODS:' || sha256(u) AS content_id, 'old ' || old_id AS title, 'KEEP' AS status, last_id + 1000 AS price, 'https://i.example/a.jpg' AS image_url FROM g WHERE n_old > 0
UNION ALL SELECT CASE WHEN first_id % 3 = 0 THEN 'FIGURE:' ELSE 'ANIME:' END || sha256(u), 'new ' || first_id, 'NEW', last_id + 1000, 'https://i.example/a.jpg' FROM g WHERE n_old = 0""")
def content_merge(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    merged, _ = store.merge_content(_stored(pages), _arrivals(pages), NOW, ["seq"])
    return merged.select("content_id", "title", "status", "price", F.col("imageUrl").alias("image_url"))


@query("incremental_merge", f"""
WITH {ARRIVED_SQL}
SELECT 'GOODS:' || sha256(u) AS content_id, 'old ' || old_id AS title, 'KEEP' AS status, last_id + 1000 AS price, 'https://i.example/a.jpg' AS image_url FROM g WHERE n_old > 0
UNION ALL SELECT CASE WHEN first_id % 3 = 0 THEN 'FIGURE:' ELSE 'ANIME:' END || sha256(u), 'new ' || first_id, 'NEW', last_id + 1000, 'https://i.example/a.jpg' FROM g WHERE n_old = 0""")
def incremental_merge(spark, sf):
    """The same merge into the stored table, bucket by bucket."""
    pages, root = table(spark, sf, "pages").select("page_id", "url"), f"{shared_dir(spark)}/content-{uuid.uuid4().hex}"
    snapshots.write_content(_stored(pages), root, n_buckets=16)
    snapshots.merge(spark, root, _arrivals(pages), NOW, ["seq"])
    return snapshots.read_content(spark, root).select("content_id", "title", "status", "price", F.col("imageUrl").alias("image_url"))


@query("purge_stored", f"""
SELECT page_id AS content_id FROM pages WHERE NOT (page_id % 3 = 0 AND page_id % 4 < 2)""")
def purge_stored(spark, sf):
    """What a purge of the stored table leaves."""
    root = f"{shared_dir(spark)}/content-{uuid.uuid4().hex}"
    snapshots.write_content(store.conform(_untitled(spark, sf)), root, n_buckets=16)
    hit = urls.untitled_leftover(F.col("url"), F.col("title"))
    snapshots.rewrite(spark, root, hit, lambda rows: store.purge_untitled(rows)[0])
    return snapshots.read_content(spark, root).select(F.col("content_id").cast("bigint").alias("content_id"))


@query("merge_counters", f"""
WITH {ARRIVED_SQL} SELECT count(*) AS urls, CAST(sum(2 * n) AS BIGINT) AS processed, CAST(sum(CASE WHEN n_old = 0 THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
 CAST(sum(CASE WHEN n_old = 0 THEN 2 * n - 1 ELSE 2 * n END) AS BIGINT) AS existing,
 CAST(sum(CASE WHEN n_old = 0 THEN n - 1 ELSE n END) AS BIGINT) AS updated FROM g""")
def merge_counters(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    _, result = store.merge_content(_stored(pages), _arrivals(pages), NOW, ["seq"])
    return result.agg(
        F.count(F.lit(1)).alias("urls"), F.sum("n_rows").alias("processed"), F.sum("inserted").cast("bigint").alias("inserted"),
        F.sum("existing").alias("existing"), F.sum("updated").alias("updated"))


def _documents(pages: DataFrame) -> DataFrame:
    """Each page stored under its own id; pages below /fr/ again under their number; those below /de/ with a broken link."""
    own = pages.select(urls.doc_id(urls.normalize_url(F.col("url"))).alias("doc_id"), "url", F.lit("NEW").alias("status"))
    legacy = pages.filter(F.contains("url", F.lit("/fr/"))).select(F.format_string("n%08d", "page_id").alias("doc_id"), F.concat(
        F.regexp_extract("url", "^[^#]*", 0), F.lit("#legacy")).alias("url"), F.lit("KEEP").alias("status"))
    broken = pages.filter(F.contains("url", F.lit("/de/"))).select(F.format_string("x%08d", "page_id").alias("doc_id"), F.regexp_replace(
        "url", "^https?", "ftp").alias("url"), F.lit("HOLD").alias("status"))
    return own.unionByName(legacy).unionByName(broken).withColumn("content_id", F.concat(F.lit("GOODS:"), F.col("doc_id")))


DOCUMENTS_SQL = f"""
d AS (SELECT sha256({NORM}) AS doc_id, url, 'NEW' AS status FROM pages
 UNION ALL SELECT 'n' || lpad(CAST(page_id AS VARCHAR), 8, '0'), regexp_extract(url, '^[^#]*') || '#legacy', 'KEEP' FROM pages WHERE url LIKE '%/fr/%'
 UNION ALL SELECT 'x' || lpad(CAST(page_id AS VARCHAR), 8, '0'), regexp_replace(url, '^https?', 'ftp'), 'HOLD' FROM pages WHERE url LIKE '%/de/%'),
i AS (SELECT doc_id, status, url AS raw_url, {NORM} AS url FROM d)"""


@query("duplicate_urls", f"""
WITH {DOCUMENTS_SQL} SELECT url, doc_id, status, n FROM i JOIN (SELECT url, count(*) AS n FROM i WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1) USING (url)""")
def duplicate_urls(spark, sf):
    return store.duplicate_urls(_documents(table(spark, sf, "pages"))).select("url", "doc_id", "status", "n")


@query("invalid_urls", f"WITH {DOCUMENTS_SQL} SELECT doc_id, raw_url AS url FROM i WHERE url IS NULL")
def invalid_urls(spark, sf):
    return store.invalid_urls(_documents(table(spark, sf, "pages")))


@query("canonical_document", f"""
WITH {DOCUMENTS_SQL} SELECT url AS url_norm, 'GOODS:' || doc_id AS content_id FROM
 (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN doc_id = sha256(url) THEN 0 ELSE 1 END, doc_id) AS r FROM i WHERE url IS NOT NULL) WHERE r = 1""")
def canonical_document(spark, sf):
    return store.canonical_documents(_documents(table(spark, sf, "pages")))


@query("purge_untitled", f"""
SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'https://x.com/u/status/' || page_id WHEN page_id % 4 = 1 THEN 'https://www.laftel.net/' ELSE url END AS url
FROM pages WHERE page_id % 3 = 0 AND page_id % 4 < 2""")
def purge_untitled(spark, sf):
    return store.purge_untitled(_untitled(spark, sf))[1]


def _untitled(spark, sf):
    """A page per row, some with a placeholder title and a link that a purge takes."""
    kind = F.col("page_id") % 4
    link = F.when(kind == 0, F.concat(F.lit("https://x.com/u/status/"), F.col("page_id").cast("string"))).when(
        kind == 1, F.lit("https://www.laftel.net/")).otherwise(F.col("url"))
    title = F.when(F.col("page_id") % 3 == 0, urls.UNTITLED).otherwise("t")
    return table(spark, sf, "pages").select(F.col("page_id").alias("content_id"), link.alias("url"), title.alias("title"))


# --- frontier -----------------------------------------------------------------------------------
@query("robots_filter", f"""
WITH f AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS origin, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
 CASE length({HOST_SQL}) % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS code FROM pages)
SELECT page_id, CASE WHEN code = 404 THEN true WHEN code >= 400 THEN false WHEN path LIKE '/en/1%' THEN true
 WHEN path LIKE '/en/%' THEN false WHEN path LIKE '/fr/%' THEN false ELSE true END AS robots_allowed FROM f""")
def robots_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    u = urls.parts(F.col("url"))
    origins = pages.select(F.concat(u.scheme, F.lit("://"), u.authority).alias("origin"), u.host.alias("host")).distinct()
    code = F.when(F.length("host") % 5 == 0, 404).when(F.length("host") % 5 == 1, 503).otherwise(200)
    rule = lambda i, prefix, ok: F.struct(F.lit(i).alias("rule_order"), F.lit(prefix).alias("path_prefix"), F.lit(ok).alias("allowed"))
    rules = origins.select("origin", F.inline(F.array(rule(0, "/en/1", True), rule(1, "/en/", False), rule(2, "/fr/", False))))
    return frontier.robots_filter(pages, rules, origins.select("origin", code.alias("http_status"))).select("page_id", "robots_allowed")


@query("needs_detail", f"""
WITH s AS (SELECT page_id, {NORM} AS u FROM pages),
t AS (SELECT u, min(page_id) AS p FROM s WHERE u LIKE 'https%' GROUP BY u),
c AS (SELECT user_id, max(ts) AS at FROM events GROUP BY user_id)
SELECT s.page_id, CASE WHEN t.p IS NULL THEN true WHEN s.page_id % 3 = 0 AND t.p % 4 = 0 THEN true WHEN s.page_id % 2 = 1 AND t.p % 4 = 1 THEN false
 WHEN c.at IS NULL THEN true ELSE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(c.at) >= 26 * 3600000000 END AS needs_detail
FROM s LEFT JOIN t USING (u) LEFT JOIN c ON c.user_id = t.p""")
def needs_detail(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    checked = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("detailCheckedAt"))
    p = F.col("page_id")
    content = store.conform(pages.filter(F.startswith("url", F.lit("https"))).join(checked, p == F.col("user_id"), "left").select(
        "url", F.format_string("n%08d", p).alias("doc_id"), F.format_string("G:n%08d", p).alias("content_id"), "detailCheckedAt",
        F.when(p % 4 == 1, "https://i.example/a.jpg").alias("imageUrl"), F.when(p % 4 != 0, F.array().cast("array<string>")).alias("detailImageUrls")))
    listed = pages.select("page_id", "url", (p % 2 == 0).alias("product_mode"), (p % 3 == 0).alias("want_gallery"), F.lit(26.0).alias("refresh_hours"))
    return frontier.needs_detail(listed, content, NOW).select("page_id", "needs_detail")


@query("fetch_queue", f"""
WITH {STOP_SQL}, o AS (SELECT DISTINCT source FROM read),
lists AS (SELECT source, 'list' AS kind, n AS page_no, 'https://' || source || '/l' || CASE WHEN n > 1 THEN '?p=' || n ELSE '' END AS url FROM o, range(1, 4) AS r(n)),
allowed AS (SELECT source FROM lists WHERE page_no = 1 AND length(source) % 4 <> 0),
q AS (SELECT * FROM lists UNION ALL SELECT source, 'detail', page_no, url FROM ranked WHERE listed_rank <= 20)
SELECT source, kind, CAST(page_no AS BIGINT) AS page_no, url FROM q WHERE source IN (SELECT source FROM allowed) AND NOT regexp_matches(url, '^https?://[^/]*/(t|l\\?p=3)')""")
def fetch_queue(spark, sf):
    rows = materialize(_listed(spark, sf).select("source", "page_no", "pos", "url"))
    read = _pages(spark, sf).select("source", F.col("page_id").alias("page_no"))
    kept = dedupe.dedupe_listings(rows, read, WEB["max_items"])
    names = read.select("source").distinct()
    sources = names.select(
        F.col("source").alias("name"), F.concat(F.lit("https://"), F.col("source"), F.lit("/l")).alias("url"), F.lit("p").alias("page_param"),
        F.lit(3).alias("max_pages"), F.lit(True).alias("respect_robots"))
    options = dims.sources_table(spark, [WEB | {"product_mode": True}])
    listed = dims.with_source(kept.withColumn("cfg", F.lit("web")), options, "cfg")
    origin = names.select("source", F.explode(F.array(F.lit("http://"), F.lit("https://"))).alias("s")).select(
        "source", F.concat("s", "source").alias("origin"))
    rule = lambda i, prefix: F.struct(F.lit(i).alias("rule_order"), F.lit(prefix).alias("path_prefix"), F.lit(False).alias("allowed"))
    rules = origin.select("origin", F.inline(F.when(F.length("source") % 4 == 0, F.array(rule(0, "/"))).otherwise(F.array(rule(0, "/t"), rule(1, "/l?p=3")))))
    queue = frontier.fetch_queue(sources, listed, None, rules, origin.select("origin", F.lit(200).alias("http_status")), NOW)
    return queue.select("source", "kind", F.col("page_no").cast("bigint").alias("page_no"), "url")


@query("image_backfill", f"""
WITH m AS (SELECT page_id, {HOST_SQL} AS h FROM pages WHERE page_id % 4 <> 0), e AS (SELECT page_id FROM m WHERE length(h) % 3 = 0 ORDER BY page_id LIMIT 60)
SELECT count(*) AS processed, count(*) FILTER (WHERE page_id IN (SELECT page_id FROM e) AND page_id % 5 > 1) AS updated,
 count(*) FILTER (WHERE page_id NOT IN (SELECT page_id FROM e) OR page_id % 5 = 1) AS still_missing,
 count(*) FILTER (WHERE page_id IN (SELECT page_id FROM e) AND page_id % 5 = 0) AS failed FROM m""")
def image_backfill(spark, sf):
    pages = _pages(spark, sf)
    content = pages.select(F.format_string("G:%010d", "page_id").alias("content_id"), "url", "source", F.when(
        F.col("page_id") % 4 == 0, "https://i.example/a.jpg").when(F.col("page_id") % 4 == 1, "ftp://x").alias("imageUrl"))
    sources = pages.select(F.col("source").alias("name")).distinct().withColumn("fetch_detail_image", F.length("name") % 3 == 0)
    chosen, marked = backfill.image_candidates(content, sources)
    n = F.split_part("content_id", F.lit(":"), F.lit(2)).cast("bigint") % 5
    tried = chosen.select("content_id", F.when(n > 1, "https://i.example/n.jpg").alias("photo"), (n == 0).alias("failed"))
    return backfill.image_counters(marked, tried)


# --- pages made of parts: cards, details and products -------------------------------------------
SHOP = {"name": "parts", "type": "html", "url": "https://shop.example/l", "shop": "부품 가게", "preorder_words": ["발매 :"], "extract": {
    "list": {"item": "li.item", "fields": {
        "link": {"selector": "a", "attr": "href"}, "title": {"selector": ".t"}, "price": {"selector": ".price", "parse": "krw"},
        "image": {"selector": "img.ph", "attr": "data-src"}, "status": {"selector": ".badge, img.sold", "parse": "sale_status"},
        "deadline": {"selector": ".d", "parse": "date"}}}}}
PRICE_SQL = "format('{:,}', p_partkey * 37 + 500)"


@query("mapped_listing", """
SELECT 'https://shop.example/product/' || p_partkey AS url, p_name || ' ' || p_type AS title, CASE WHEN p_partkey * 37 + 500 >= 1000 THEN p_partkey * 37 + 500 END AS price,
 CASE WHEN p_partkey * 37 + 500 >= 1000 THEN CASE p_size % 4 WHEN 0 THEN 'SOLD_OUT' WHEN 1 THEN 'PREORDER' ELSE 'IN_STOCK' END END AS sale_status,
 CASE WHEN p_partkey * 37 + 500 >= 1000 AND p_size % 12 + 1 <= 12 THEN '2026-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '-05' END AS deadline,
 'https://shop.example/img/' || p_partkey || '.jpg' AS image_url FROM part""")
def mapped_listing(spark, sf):
    part = spread(table(spark, sf, "part"), PAGE_ROWS)
    price = F.format_number(F.col("p_partkey") * 37 + 500, 0)
    size = F.col("p_size")
    badge = F.when(size % 4 == 0, '<i class="badge"></i><img class="sold" alt="품절">').when(
        size % 4 == 1, '<i class="badge">발매 : 곧</i>').otherwise('<i class="badge">판매중</i>')
    key = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit('<p>99,000원</p><ul><li class="item new"><a href="/product/'), key, F.lit('?utm_id=1"><img class="ph" data-src="/img/'), key,
        F.lit('.jpg"></a><span class="t">'), F.col("p_name"), F.lit("\n "), F.col("p_type"), F.lit('</span><b class="price">'), price, F.lit("원</b>"),
        badge, F.lit('<u class="d">26년 '), (size % 12 + 1).cast("string"), F.lit('월 5일</u></li><li class="item"><span class="t">링크 없는 카드</span></li></ul>'))
    sources = dims.sources_table(spark, [SHOP])
    pages = part.select(F.lit("parts").alias("source"), F.col("p_partkey").alias("page_no"), F.lit("https://shop.example/l").alias("url"), html.alias("html"))
    rows = listings.extract_listings(shred_pages(dims.with_source(pages, sources)), NOW)
    return rows.select("url", "title", "price", F.col("saleStatus").alias("sale_status"), F.col("preorderEndAt").alias("deadline"), F.col("imageUrl").alias("image_url"))


@query("detail_modes", """
WITH d AS (SELECT *, p_partkey % 3 AS mode, p_partkey * 37 + 500 AS n FROM part)
SELECT 'https://shop.example/product/' || p_partkey AS url, CASE WHEN mode = 0 AND n + 2000 >= 1000 THEN n + 2000 ELSE 5000 END AS price,
 CASE WHEN mode = 0 THEN CASE p_size % 4 WHEN 0 THEN 'SOLD_OUT' WHEN 1 THEN 'PREORDER' ELSE 'IN_STOCK' END ELSE 'PREORDER' END AS sale_status,
 CASE WHEN mode < 2 THEN 'https://shop.example/og/' || p_partkey || '.jpg' ELSE 'https://shop.example/card.jpg' END AS image_url,
 CASE mode WHEN 1 THEN NULL WHEN 0 THEN 'https://shop.example/d1.jpg' ELSE 'https://shop.example/og/' || p_partkey || '.jpg,https://shop.example/d1.jpg' END AS gallery FROM d""")
def detail_modes(spark, sf):
    part = spread(table(spark, sf, "part"), PAGE_ROWS)
    modes = [
        {"name": "product", "product_mode": True, "product_text_selector": ".panel", "detail_images_selector": ".g img"},
        {"name": "image", "fetch_detail_image": True},
        {"name": "gallery", "list_product_mode": True, "detail_images_selector": ".g img"}]
    sources = dims.sources_table(spark, [{"type": "html", "url": "https://shop.example/l"} | m for m in modes])
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    mode = F.element_at(F.array(*[F.lit(m["name"]) for m in modes]), (F.col("p_partkey") % 3 + 1).cast("int"))
    link = F.concat(F.lit("https://shop.example/product/"), key)
    word = F.when(size % 4 == 0, "품절").when(size % 4 == 1, "예약").otherwise("구매")
    html = F.concat(
        F.lit('<meta property="og:image" content="/og/logo.png"><meta name="twitter:image" content="/og/'), key, F.lit('.jpg"><nav>예약 1,000원</nav>'),
        F.lit('<div class="panel">판매가 '), F.format_number(F.col("p_partkey") * 37 + 2500, 0), F.lit('원 <p>'), word, F.lit('</p><p class="hidden">품절</p></div>'),
        F.lit('<div class="g"><img src="/og/'), key, F.lit('.jpg"><img ec-data-src="/d1.jpg"><img src="/d1.jpg"><img src="/icon.png"></div>'))
    pages = part.select(mode.alias("source"), link.alias("url"), html.alias("html"))
    cards = dims.with_source(part.select(
        mode.alias("source"), link.alias("url"), F.col("p_name").alias("title"), F.lit("https://shop.example/card.jpg").alias("imageUrl"),
        F.lit("PRODUCT").alias("entityType"), F.lit("s").alias("shop"), F.lit("PREORDER").alias("saleStatus"), F.lit(5000).cast("bigint").alias("price"),
        F.lit("KRW").alias("currency"), F.lit(None).cast("string").alias("preorderEndAt"), F.lit(None).cast("timestamp").alias("productCheckedAt"),
        F.array().cast("array<string>").alias("errors")), sources)
    read = details.read_details(shred_pages(dims.with_source(pages, sources)), NOW).withColumn("failed", F.lit(False))
    rows = details.apply_details(cards, read, NOW)
    return rows.select("url", "price", F.col("saleStatus").alias("sale_status"), F.col("imageUrl").alias("image_url"),
                       F.when(F.col("detailImageUrls").isNotNull(), F.array_join("detailImageUrls", ",")).alias("gallery"))


@query("figure_products", """
SELECT 'https://f.example/shop/detail.php?pno=' || p_partkey AS url, '[' || (p_size % 12 + 1) || '월 입고] 피규어 ' || p_name AS title, p_partkey * 37 + 5000 AS price,
 CASE WHEN p_size % 5 = 0 THEN 'SOLD_OUT' WHEN p_size % 5 = 1 THEN 'PREORDER' ELSE 'IN_STOCK' END AS sale_status,
 CASE WHEN p_size % 5 = 1 THEN '2026-03-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS deadline, (p_size % 12 + 1) || '월 입고' AS release_window,
 p_brand AS manufacturer, p_size || 'cm' AS size_text FROM part WHERE p_type <> 'ECONOMY'""")
def figure_products(spark, sf):
    part = spread(table(spark, sf, "part"), PAGE_ROWS)
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    name = F.concat(F.lit("["), (size % 12 + 1).cast("string"), F.lit("월 입고] "), F.when(
        F.col("p_type") == "ECONOMY", "일반 상품 ").otherwise("피규어 "), F.col("p_name"))
    note = F.when(size % 5 == 0, "<p>품절</p>").when(size % 5 == 1, F.concat(
        F.lit("<p>예약마감일 : 26년 3월 "), (size % 28 + 1).cast("string"), F.lit("일</p>"))).otherwise("")
    html = F.concat(
        F.lit('<head><meta property="og:title" content="피규어팜"></head><h1>짧다</h1><div class="goods_name">'), name, F.lit("</div><p>제조사</p><p>"), F.col("p_brand"),
        F.lit("</p><p>치수 : "), size.cast("string"), F.lit("cm</p><p>3,000원</p><p>"), F.format_number(F.col("p_partkey") * 37 + 5000, 0), F.lit("원</p>"), note)
    sources = dims.sources_table(spark, [{"name": "figures", "type": "figurefarm"}])
    pages = part.select(F.lit("figures").alias("source"), F.concat(F.lit("https://f.example/shop/detail.php?pno="), key).alias("url"), html.alias("html"))
    rows = details.figure_products(shred_pages(dims.with_source(pages, sources)), NOW)
    return rows.select("url", "title", "price", F.col("saleStatus").alias("sale_status"), F.col("preorderEndAt").alias("deadline"),
                       F.col("releaseWindowText").alias("release_window"), "manufacturer", F.col("sizeText").alias("size_text"))
