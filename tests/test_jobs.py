import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from listing_lake.operators import feed, snapshots, store
from listing_lake.plans import jobs
from listing_lake.sources import dims
from listing_lake.streaming import streams

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_pages_to_feed(spark, tmp_path):
    sources = dims.sources_table(spark, [{
        "name": "가게", "type": "html", "url": "https://shop.example/l", "link_selector": "li a", "list_product_mode": True, "max_items": 3,
        "category": "FIGURE", "source_tier": "OFFICIAL", "region": "KR"}])
    card = lambda n, title, rest="12,000원 예약": f'<li><a href="/p/{n}?utm_source=x">{title}</a> {rest}</li>'
    pages = spark.createDataFrame([
        ("가게", 1, "https://shop.example/l", card(1, "원피스 루피 피규어") + card(2, "리제로 렘 × 원피스") + card(1, "다시 나온 상품")),
        ("가게", 2, "https://shop.example/l?p=2", card(2, "또 나온 상품") + card(3, "기타 상품 이름", "품절") + card(4, "한도 밖 상품"))],
        "source string, page_no int, url string, html string")
    found = jobs.list_pages(pages, sources, NOW)
    assert [(r.url, r.listed_rank) for r in found.orderBy("listed_rank").collect()] == [
        (f"https://shop.example/p/{n}", n) for n in (1, 2, 3)]
    snapshot, result = jobs.merge_run(store.conform(spark.createDataFrame([], store.CONTENT_DDL)), found, sources, NOW, ["page_no", "pos"])
    assert result.agg(F.sum("inserted")).first()[0] == 3
    root = str(tmp_path / "content")
    snapshots.write_content(snapshot, root)
    content = snapshots.read_content(spark, root, "FIGURE")
    works = dims.works_table(spark, [{"name": "Re:제로", "aliases": ["리제로"]}, {"name": "ONE PIECE", "aliases": "원피스"}])
    items, aliases = jobs.build_feed(content, works, NOW)
    got = {r.view.title_text: (r.works, r.view.signal_score) for r in items.collect()}
    assert got == {"원피스 루피 피규어": (["ONE PIECE"], 48.0), "리제로 렘 × 원피스": (["Re:제로", "ONE PIECE"], 48.0), "기타 상품 이름": ([], 45.0)}
    assert [r.id for r in feed.query_feed(items, NOW, q="Re:제로").collect()] == [r.id for r in items.filter("size(works) = 2").collect()]
    posts = {r.work: r for r in jobs.digest_per_work(items).collect()}
    assert posts["ONE PIECE"].n == 2 and posts["Re:제로"].body == "1. 리제로 렘 × 원피스\n   가게 · 예약중 · 12,000원\n"
    feed.write_feed(items, aliases, NOW, str(tmp_path / "site"))
    header = json.loads(next((tmp_path / "site" / "header").glob("part-*.json")).read_text())
    assert header["compare"]["maxSources"] == 20 and header["builtAt"].startswith("2026-01-01")
    assert spark.read.json(str(tmp_path / "site" / "items")).count() == 3


def test_detail_job(spark):
    sources = dims.sources_table(spark, [{"name": "s", "type": "html", "url": "https://shop.example/l", "product_mode": True}])
    pages = spark.createDataFrame([("s", 1, "https://shop.example/l", '<a href="/p/1">상품 하나 둘</a>')], "source string, page_no int, url string, html string")
    details = spark.createDataFrame([("s", "https://shop.example/p/1", "<p>31,000원</p>", False)], "source string, url string, html string, failed boolean")
    (row,) = jobs.add_details(jobs.list_pages(pages, sources, NOW), details, sources, NOW).collect()
    assert (row.price, row.saleStatus) == (31000, "IN_STOCK")


def test_feed_and_api_jobs(spark):
    sources = dims.sources_table(spark, [
        {"name": "r", "type": "rss", "max_items": 2},
        {"name": "j", "type": "json_api", "items_path": "l", "id_field": "i", "title_field": "t", "detail_url_template": "/p/{id}", "max_items": 3, "image_html_field": "h"}])
    item = lambda n: f"<item><title>t{n}</title><link>/{n}</link></item>"
    docs = spark.createDataFrame([("r", 1, "https://f.example/f", f"<rss><channel>{item(1)}{item(1)}{item(2)}{item(3)}</channel></rss>")],
                                 "source string, page_no int, url string, body string")
    assert sorted(r.url[-1] for r in jobs.read_feeds(docs, sources).collect()) == ["1", "2"]
    body = lambda *n: json.dumps({"l": [{"i": i, "t": f"t{i}", "h": f'<img src="/{i}.jpg">'} for i in n]})
    rows = spark.createDataFrame([("j", 1, "https://f.example/a", body(1, 1)), ("j", 2, "https://f.example/a", body(2, 3)), ("j", 3, "https://f.example/a", body())],
                                 "source string, page_no int, url string, body string")
    got = jobs.read_api(rows, sources).orderBy("listed_rank").collect()
    assert [(r.url, r.imageUrl) for r in got] == [(f"https://f.example/p/{i}", f"https://f.example/{i}.jpg") for i in (1, 1, 2)]


def write_batches(spark, folder, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_upsert_stream_is_idempotent(spark, tmp_path):
    schema = "seq int, url string, title string, price bigint, category string"
    inbox, root = str(tmp_path / "in"), str(tmp_path / "content")
    write_batches(spark, inbox, schema, [(1, "https://e.example/a", "t", 10, "GOODS"), (2, "https://e.example/b", "t", 20, "GOODS")])
    run = lambda checkpoint, folder=inbox: streams.upsert_stream(
        streams.read_stream(spark, folder, schema), root, str(tmp_path / checkpoint), lambda: NOW, ["seq"], n_buckets=4)
    run("c1")
    write_batches(spark, inbox, schema, [(3, "https://e.example/a?utm_id=1", "new", 30, "ANIME")])
    run("c1")
    stored = lambda: {r.url: (r.title, r.price) for r in snapshots.read_content(spark, root).collect()}
    rows = {"https://e.example/a": ("t", 30), "https://e.example/b": ("t", 20)}
    assert stored() == rows and len(snapshots.versions(spark, root)) == 3
    run("c2")  # a lost checkpoint reads the files anew: stored rows stay as they are
    assert stored() == rows
    other = str(tmp_path / "other")
    write_batches(spark, other, schema, [(1, "https://e.example/c", "u", 40, "GOODS")])
    run("c3", other)  # the first batch of another stream is no replay
    assert stored() == rows | {"https://e.example/c": ("u", 40)}
    for name in ("0", ".0.crc"):  # lost between merge and commit
        (tmp_path / "c3" / "commits" / name).unlink()
    versions = snapshots.versions(spark, root)
    run("c3", other)
    assert snapshots.versions(spark, root) == versions


def test_event_time_streams(spark, tmp_path):
    schema = "source string, url string, collectedAt timestamp"
    inbox = str(tmp_path / "in")
    at = lambda h: NOW + timedelta(hours=h)
    write_batches(spark, inbox, schema, [("s", "https://e.example/a", at(0)), ("s", "https://e.example/a#x", at(1)), ("s", "https://e.example/b", at(14)),
                                         ("s", "https://e.example/c", at(15)), ("s", "https://e.example/c", at(80))])
    source = lambda: streams.read_stream(spark, inbox, schema)
    streams.run_available(streams.first_seen_listings(source()), str(tmp_path / "c1"), streams.to_parquet(str(tmp_path / "o1")))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 3
    streams.run_available(streams.daily_intake(source(), [F.col("source")], "collectedAt", "1 hour"), str(tmp_path / "c2"), streams.to_parquet(str(tmp_path / "o2")))
    days = {(r.day, r.n) for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    assert days == {("2026-01-01", 3), ("2026-01-02", 1)}
    streams.run_available(streams.refresh_due(source(), "url", "collectedAt", 72, "1 hour"), str(tmp_path / "c3"), streams.to_parquet(str(tmp_path / "o3")))
    due = {r.url: r.due_at for r in spark.read.parquet(str(tmp_path / "o3")).collect()}
    assert due == {"https://e.example/a": at(72).replace(tzinfo=None), "https://e.example/a#x": at(73).replace(tzinfo=None)}


def test_refresh_due_renews_and_forgets(spark, tmp_path):
    schema = "url string, at timestamp"
    inbox = str(tmp_path / "in")
    at = lambda h: NOW + timedelta(hours=h)
    run = lambda: streams.run_available(
        streams.refresh_due(streams.read_stream(spark, inbox, schema), "url", "at", 6, "1 hour"), str(tmp_path / "c"), streams.to_parquet(str(tmp_path / "o")))
    got = lambda: sorted((r.url, r.due_at) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    due = lambda *pairs: sorted((u, at(h).replace(tzinfo=None)) for u, h in pairs)
    write_batches(spark, inbox, schema, [("a", at(0)), ("b", at(0)), ("c", at(0)), ("c", at(3))])
    run()
    assert got() == []
    write_batches(spark, inbox, schema, [("a", at(5)), ("a", at(2)), ("d", at(8))])  # a is checked anew in time, b is not
    run()
    assert got() == due(("b", 6))
    write_batches(spark, inbox, schema, [("b", at(12)), ("d", at(14))])  # b starts over; a and c fall due
    run()
    assert got() == due(("b", 6), ("a", 11), ("c", 9))
    write_batches(spark, inbox, schema, [("e", at(40))])
    run()
    assert got() == due(("b", 6), ("a", 11), ("c", 9), ("b", 18), ("d", 20))


def test_rows_with_much_work_are_dealt_to_many_tasks(spark, tmp_path):
    from listing_lake.plans.feed_queries import rendered_cards
    from listing_lake.session import spread

    part = spark.range(25).select(
        F.col("id").alias("p_partkey"), (F.col("id") % 9).cast("int").alias("p_size"),
        *[F.lit("small").alias(name) for name in ("p_name", "p_type", "p_brand")])
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    table = spark.read.parquet(f"{tmp_path}/part.parquet")
    assert spread(table, task_rows=2).rdd.getNumPartitions() == 13 and spread(table, task_rows=100).rdd.getNumPartitions() == 4
    cards = rendered_cards(spark, str(tmp_path))
    assert cards.rdd.getNumPartitions() == 4 and cards.count() == 25


def test_values_that_are_filtered_are_computed_once(spark):
    """A filter below the values it reads would hold a copy of their expressions and do the work twice."""
    from listing_lake.functions.text import once
    from listing_lake.sources import payloads

    item = "<item><title> a </title><link>{}</link></item>"
    feeds = ["<rss><channel>" + item.format("/a?utm_id=1") + item.format(" ") + "</channel></rss>", "<rss><channel/></rss>", "", None]
    rows = payloads.read_feed_xml(spark.createDataFrame([(i, "https://f.example/x", b) for i, b in enumerate(feeds)], "i int, url string, body string"))
    assert [(r.i, r.pos, r.url) for r in rows.collect()] == [(0, 0, "https://f.example/a")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any("xml" in line.lower() or "regexp" in line for line in plan.splitlines() if "Filter" in line)
    kept = once(spark.range(4), twice=F.col("id") * 2).filter("twice > 2")
    assert [tuple(r) for r in kept.orderBy("id").collect()] == [(2, 4), (3, 6)]
