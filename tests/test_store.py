import hashlib
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from listing_lake.operators import backfill, dedupe, frontier, reports, store
from listing_lake.sources import dims

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
sha = lambda u: hashlib.sha256(u.encode()).hexdigest()


def content(spark, *rows):
    return store.conform(spark.createDataFrame(list(rows), store.CONTENT_DDL))


def doc(url, category="FIGURE", doc_id=None, **kw):
    doc_id = doc_id or sha(url)
    return {"content_id": f"{category}:{doc_id}", "storage_category": category, "doc_id": doc_id, "url": url, "status": "KEEP", **kw}


CANDIDATE = "seq int, source string, url string, title string, category string, price bigint, imageUrl string, detailImageUrls array<string>, shop string"


def test_merge(spark):
    a, b, c = (f"https://e.example/{x}" for x in "abc")
    old = content(
        spark, doc(a, title="old", note="n", price=1), doc(b, doc_id="zz", title="legacy z"), doc(b, doc_id="aa", title="legacy a"))
    rows = spark.createDataFrame([
        (1, "s", a + "?utm_source=q", "new", "GOODS", 2000, "https://i.example/a.jpg", ["https://i.example/a.jpg", "javascript:x",
         "https://i.example/d1.jpg", "https://i.example/d1.jpg"], None),
        (2, "s", b, "t", None, None, "javascript:alert(1)", None, None),
        (3, "s", b, "t", None, None, None, [], ""),
        (4, "s", c, "first", "GOODS", 10, None, None, "x"),
        (5, "s", c, "second", "ANIME", 20, None, None, None),
        (6, "s", "mailto:x", "bad", None, None, None, None, None),
    ], CANDIDATE)
    merged, result = store.merge_content(old, rows, NOW, ["seq"])
    got = {r.content_id: r for r in merged.collect()}
    first = got[f"FIGURE:{sha(a)}"]
    assert (first.title, first.price, first.imageUrl, first.detailImageUrls) == ("old", 2000, "https://i.example/a.jpg", ["https://i.example/d1.jpg"])
    assert (first.note, first.status, first.category, first.collectedAt) == ("n", "KEEP", None, None)
    target, other = got["FIGURE:aa"], got["FIGURE:zz"]
    assert (target.detailImageUrls, target.shop, target.imageUrl, other.detailImageUrls) == ([], "", None, None)
    new = got[f"GOODS:{sha(c)}"]
    assert (new.title, new.price, new.shop, new.status, new.collectedAt) == ("first", 20, "x", "NEW", NOW.replace(tzinfo=None))
    assert len(got) == 4
    counts = {r.url_norm: (r.n_rows, r.inserted, r.existing, r.updated) for r in result.collect()}
    assert counts == {a: (1, 0, 1, 1), b: (2, 0, 2, 1), c: (2, 1, 1, 1)}
    # Merging the same rows again changes nothing but counts.
    again, second = store.merge_content(merged, rows, NOW + timedelta(days=1), ["seq"])
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))
    assert second.agg(F.sum("inserted")).first()[0] == 0


def test_identity_reports(spark):
    b = "https://e.example/b"
    df = content(spark, doc(b, doc_id="zz"), doc(b + "#x", doc_id="aa"), doc("https://e.example/c"), doc("nope", doc_id="bad"))
    assert sorted((r.url, r.doc_id, r.n) for r in store.duplicate_urls(df).collect()) == [(b, "aa", 2), (b, "zz", 2)]
    assert [r.doc_id for r in store.invalid_urls(df).collect()] == ["bad"]
    df = content(spark, doc(b, doc_id="aa"), doc(b))
    assert [r.content_id for r in store.canonical_documents(df).collect()] == [f"FIGURE:{sha(b)}"]


def test_edits(spark):
    df = content(spark, doc("https://e.example/a", doc_id="a"), doc("https://e.example/b", doc_id="b"))
    edits = spark.createDataFrame([
        (1, "FIGURE:a", "status", "HOLD", NOW), (2, "FIGURE:a", "status", "BROKEN", NOW + timedelta(1)), (3, "FIGURE:a", "note", " hi ", NOW),
        (4, "FIGURE:a", "note", "", NOW + timedelta(1)), (5, "FIGURE:a", "postedAt", None, NOW), (6, "FIGURE:a", "status", "IGNORE", NOW),
    ], "seq int, content_id string, field string, value string, ts timestamp")
    rows = {r.doc_id: r for r in store.apply_edits(df, edits, "seq").collect()}
    assert (rows["a"].status, rows["a"].note, rows["a"].postedAt) == ("IGNORE", "", NOW.replace(tzinfo=None))
    assert (rows["b"].status, rows["b"].note, rows["b"].postedAt) == ("KEEP", None, None)


def test_purge(spark):
    df = content(spark, doc("https://x.com/a/status/1", doc_id="x", title="(제목 없음)"), doc("https://e.example/", doc_id="k", title="(제목 없음)"),
                 doc("https://e.example/n", doc_id="n"))
    left, matched = store.purge_untitled(df)
    assert sorted(r.doc_id for r in left.collect()) == ["k", "n"] and [r.id for r in matched.collect()] == ["FIGURE:x"]
    assert store.purge_untitled(df, dry_run=True)[0].count() == 3


def crawl(spark, rows, pages, limit=None, dedupe_rows=True):
    c = spark.createDataFrame([("s", p, i, u) for i, (p, u) in enumerate(rows)], "source string, page_no int, pos int, url string")
    p = spark.createDataFrame([("s", n, d) for n, d in pages], "source string, page_no int, denied boolean")
    return [r.url for r in dedupe.dedupe_listings(c, p, limit, dedupe_rows).orderBy("page_no", "pos").collect()]


def test_pagination(spark):
    rows = [(1, "a1"), (1, "a2"), (2, "a2"), (2, "a3"), (3, "a4")]
    ok = [(1, False), (2, False), (3, False)]
    assert crawl(spark, [r for r in rows if r[0] < 3], ok[:2]) == ["a1", "a2", "a3"]
    assert crawl(spark, [(1, "a1"), (2, "a1"), (3, "a4")], ok) == ["a1"]
    assert crawl(spark, rows, ok, 3) == ["a1", "a2", "a3"] and crawl(spark, rows, ok, 0) == []
    assert crawl(spark, rows, [(1, False), (2, True), (3, False)]) == ["a1", "a2"]
    assert crawl(spark, rows, [(1, True), (2, False), (3, False)]) == []
    assert crawl(spark, rows, ok, 4, dedupe_rows=False) == ["a1", "a2", "a2", "a3"]


def test_rank_agrees_with_a_plain_count(spark):
    import random

    rng = random.Random(5)
    rows = [(f"s{rng.randint(0, 2)}", rng.randint(1, 3000), i) for i in range(4000)]
    c = spark.createDataFrame(rows, "source string, page_no int, pos int")
    per_page = c.groupBy("source", "page_no").agg(F.count("*").alias("n_new"))
    got = {(r.source, r.pos): r.listed_rank for r in dedupe.rank_in_source(c, per_page).collect()}
    want, seen = {}, {}
    for s, p, i in sorted(rows):
        seen[s] = seen.get(s, 0) + 1
        want[(s, i)] = seen[s]
    assert got == want


def test_needs_detail(spark):
    hour = lambda n: NOW - timedelta(hours=n)
    u = lambda k: f"https://e.example/{k}"
    df = content(
        spark, doc(u("photo"), imageUrl="https://i.example/a.jpg"), doc(u("c1"), detailCheckedAt=hour(1)), doc(u("c100"), detailCheckedAt=hour(100)),
        doc(u("never")), doc(u("p2"), imageUrl="https://i.example/a.jpg", productCheckedAt=hour(2)),
        doc(u("p200"), imageUrl="https://i.example/a.jpg", productCheckedAt=hour(200)),
        doc(u("gnull"), productCheckedAt=hour(1)), doc(u("gfull"), productCheckedAt=hour(1), detailImageUrls=["d"]),
        doc(u("gnone"), productCheckedAt=hour(1), detailImageUrls=[]))
    cases = [("new", False, 72.0, False, True), ("photo", False, 72.0, False, False), ("c1", False, 72.0, False, False),
             ("c100", False, 72.0, False, True), ("never", False, 72.0, False, True), ("p2", True, 72.0, False, False), ("p200", True, 72.0, False, True),
             ("gnull", True, 72.0, True, True), ("gfull", True, 72.0, True, False), ("gnone", True, 72.0, True, False), ("c1", False, 0.0, False, True)]
    listed = spark.createDataFrame([(i, u(k), p, h, g) for i, (k, p, h, g, _) in enumerate(cases)] + [(99, "bad", False, 72.0, False)],
                                   "i int, url string, product_mode boolean, refresh_hours double, want_gallery boolean")
    got = {r.i: r.needs_detail for r in frontier.needs_detail(listed, df, NOW).collect()}
    assert got == {**{i: c[4] for i, c in enumerate(cases)}, 99: True}
    assert frontier.needs_detail(listed, df, NOW, force=True).filter("not needs_detail").count() == 0
    assert frontier.needs_detail(listed, None, NOW).filter("not needs_detail").count() == 0


def test_robots(spark):
    rules = spark.createDataFrame([("https://a.example", 0, "/shop/open", True), ("https://a.example", 1, "/shop", False),
                                   ("https://b.example", 0, "*", False)], "origin string, rule_order int, path_prefix string, allowed boolean")
    status = spark.createDataFrame([("https://a.example", 200), ("https://b.example", 200), ("https://c.example", 404), ("https://d.example", 503)],
                                   "origin string, http_status int")
    cases = [("https://a.example/shop/open/1", True, True), ("https://a.example/shop/x", True, False), ("https://a.example/x", True, True),
             ("https://b.example/", True, False), ("https://c.example/x", True, True), ("https://d.example/x", True, False),
             ("https://e.example/x", True, False), ("https://e.example/x?n", False, True)]
    urls = spark.createDataFrame([(u, r) for u, r, _ in cases], "url string, respect_robots boolean")
    got = {(r.url, r.respect_robots): r.robots_allowed for r in frontier.robots_filter(urls, rules, status).collect()}
    assert got == {(u, r): w for u, r, w in cases}


def test_fetch_queue(spark):
    sources = dims.sources_table(spark, [
        {"name": "s", "type": "html", "url": "https://a.example/l", "page_param": "p", "max_pages": 3, "product_mode": True},
        {"name": "t", "type": "html", "url": "https://b.example/l"}])
    rules = spark.createDataFrame([("https://a.example", 0, "/l?p=3", False), ("https://b.example", 0, "/", False)],
                                  "origin string, rule_order int, path_prefix string, allowed boolean")
    status = spark.createDataFrame([("https://a.example", 200), ("https://b.example", 200)], "origin string, http_status int")
    listed = dims.with_source(spark.createDataFrame([("s", 1, 1, "https://a.example/i/1"), ("s", 1, 2, "https://a.example/i/2")],
                                                    "source string, page_no int, pos int, url string"), sources)
    stored = content(spark, doc("https://a.example/i/1", productCheckedAt=NOW - timedelta(hours=1)))
    got = [(r.kind, r.url) for r in frontier.fetch_queue(sources, listed, stored, rules, status, NOW).orderBy("kind", "page_no", "pos").collect()]
    assert got == [("detail", "https://a.example/i/2"), ("list", "https://a.example/l"), ("list", "https://a.example/l?p=2")]


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1, 0, 0, 0), ("a", 0, 1, 1, 1), ("b", 0, 1, 0, 0)],
                                 "source string, inserted int, existing int, updated int, failed int")
    got = {r.source: tuple(r)[1:] for r in reports.run_report(rows).collect()}
    assert got == {"a": (2, 1, 1, 1, 1), "b": (1, 0, 1, 0, 0), "TOTAL": (3, 1, 2, 1, 1)}
    errors = spark.createDataFrame([("a", 1, "x", ""), ("a", 3, "z", ""), ("a", 2, "y", ""), ("b", 1, "q", None), ("c", 1, "m", "why")],
                                   "source string, seq int, message string, reason string")
    assert {r.source: r.note for r in reports.error_summary(errors).collect()} == {"a": "x; y 외 1건", "b": "q", "c": "why"}
    sources = dims.sources_table(spark, [
        {"name": "a", "type": "html"}, {"name": "b", "type": "html", "enabled": False}, {"name": "c", "type": "rss", "local_only": True},
        {"name": "d", "type": "ftp"}])
    got = {r.name: (r.skip_reason, r.counts_as_failed) for r in reports.eligibility(sources).collect()}
    assert got == {"a": (None, False), "b": ("비활성화", False), "c": ("수동 전용", False), "d": ("지원하지 않는 수집 방식: ftp", True)}
    assert reports.eligibility(sources, allow_manual=True).filter("skip_reason is null").count() == 2
    automatic, manual = reports.split_sources(sources)
    assert (automatic.count(), manual.count()) == (3, 1)


def test_image_backfill(spark):
    df = content(spark, doc("https://e.example/1", doc_id="1", source="s"), doc("https://e.example/2", doc_id="2", source="s"),
                 doc("https://e.example/3", doc_id="3", source="other", imageUrl="javascript:x"), doc("https://e.example/4", doc_id="4", imageUrl="https://i.example/x.jpg"))
    sources = dims.sources_table(spark, [{"name": "s", "fetch_detail_image": True}, {"name": "other"}])
    chosen, marked = backfill.image_candidates(df, sources)
    assert [r.content_id for r in chosen.collect()] == ["FIGURE:1", "FIGURE:2"]
    tried = spark.createDataFrame([("FIGURE:1", "https://i.example/n.jpg", False), ("FIGURE:2", None, False)], "content_id string, photo string, failed boolean")
    assert backfill.image_counters(marked, tried).first().asDict() == {"processed": 3, "updated": 1, "still_missing": 2, "failed": 0}
    filled = {r.doc_id: r.imageUrl for r in backfill.fill_images(df, tried.union(spark.createDataFrame(
        [("FIGURE:4", "https://i.example/no.jpg", False)], tried.schema))).collect()}
    assert filled == {"1": "https://i.example/n.jpg", "2": None, "3": "javascript:x", "4": "https://i.example/x.jpg"}


def test_translation_backfill(spark):
    df = content(spark, doc("https://e.example/1", doc_id="1", title="One", summary="Two"), doc("https://e.example/2", doc_id="2", title="None"),
                 doc("https://e.example/3", doc_id="3", title="한글", summary="Two"), doc("https://e.example/4", doc_id="4", title="x", titleKo="엑스"),
                 doc("https://e.example/5", doc_id="5", title="한글"))
    t = spark.createDataFrame([(sha("One"), "하나", "unknown"), (sha("Two"), "둘", "en")], "text_hash string, text_ko string, language string")
    after = backfill.translate(df, t, NOW)
    got = {r.doc_id: (r.titleKo, r.summaryKo, r.sourceLanguage) for r in after.collect()}
    assert got == {"1": ("하나", "둘", "en"), "2": (None, None, None), "3": ("", "둘", "en"), "4": ("엑스", None, None), "5": (None, None, None)}
    assert backfill.translation_counters(df, after).first().asDict() == {"processed": 5, "updated": 2, "skipped": 2, "failed": 1}


def test_overlay(spark):
    base = [{"name": "a", "url": "u", "shop": "mine"}, {"name": "b", "url": "v"}]
    over = [{"name": "a", "extract": {"list": {}}, "shop": "theirs"}, {"name": "b", "shop": "theirs"}, {"name": "c", "url": "w"}]
    got = dims.overlay_configs(base, over)
    assert got == [{"name": "a", "url": "u", "shop": "mine", "extract": {"list": {}}}, {"name": "b", "url": "v", "shop": "theirs"},
                   {"type": "html", "enabled": False, "respect_robots": True, "name": "c", "url": "w"}]
    left = spark.createDataFrame([("a", "u", "mine", None), ("b", "v", None, "old")], "name string, url string, shop string, rule string")
    right = spark.createDataFrame([("a", None, "theirs", "new"), ("b", None, "theirs", None), ("c", "w", None, None)], left.schema)
    rows = dims.overlay_merge(left, right, "name", ["rule"], ["shop"], {"shop": "none"}, "url").orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("a", "u", "mine", "new"), ("b", "v", "theirs", "old"), ("c", "w", "none", None)]
