"""A collection run over every type of source: counters per source, failures, and the same rows from a stream of raw bodies."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from listing_lake.operators import snapshots
from listing_lake.plans import collection
from listing_lake.sources import dims, payloads
from listing_lake.streaming import streams

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
PAGE = "source string, page_no int, url string, body string"
DETAIL = "source string, url string, html string, failed boolean"
HOST = "https://mall.example"


def card(n, price="12,000원"):
    return f'<li><a href="/goods/{n}">진열 상품 번호 {n}</a> {price}</li>'


def feed(*items):
    return "<rss><channel>" + "".join(f"<item><title>소식 {n}</title><link>/goods/{n}</link></item>" for n in items) + "</channel></rss>"


@pytest.fixture(scope="module")
def sources(spark):
    return dims.sources_table(spark, [
        {"name": "shop", "type": "html", "url": f"{HOST}/l", "link_selector": "li a", "list_product_mode": True},
        {"name": "news", "type": "rss", "url": f"{HOST}/f"},
        {"name": "broken", "type": "rss", "url": f"{HOST}/g"},
        {"name": "api", "type": "json_api", "url": f"{HOST}/a", "items_path": "l", "id_field": "i", "title_field": "t",
         "detail_url_template": "/goods/{id}", "image_field": "p"},
        {"name": "figures", "type": "figurefarm", "url": "https://fig.example/l", "max_items": 5},
        {"name": "seen", "type": "local_browser", "url": f"{HOST}/b", "local_only": True},
        {"name": "off", "type": "rss", "url": f"{HOST}/o", "enabled": False},
        {"name": "odd", "type": "ftp", "url": f"{HOST}/p"},
    ])


def fetched(spark):
    figure = lambda n, name: f'<div class="ffm-product-card"><a href="/shop/detail.php?pno={n}">x</a><b class="name">{name}</b></div>'
    pages = spark.createDataFrame([
        ("shop", 1, f"{HOST}/l", card(1) + card(2)), ("shop", 2, f"{HOST}/l?p=2", card(2) + card(3)),
        ("news", 1, f"{HOST}/f", feed(3, 4, 4)), ("broken", 1, f"{HOST}/g", "<rss><channel>"),
        ("api", 1, f"{HOST}/a", json.dumps({"l": [{"i": 1, "t": "하나", "p": "/1.jpg"}, {"i": 5, "t": "다섯"}, {"i": 5, "t": "다섯"}]})),
        ("figures", 1, "https://fig.example/l", figure(1, "루피 피규어") + figure(2, "종이 상자") + figure(3, "렘 피규어") + figure(4, "") + figure(5, "조로 피규어")),
        ("nobody", 1, f"{HOST}/n", card(9)), ("off", 1, f"{HOST}/o", feed(7)),
    ], PAGE)
    detail = lambda n, title: f"<h1>{title}</h1><p>제조사</p><p>가나</p><p>9,000원</p>"
    details = spark.createDataFrame([
        ("figures", "https://fig.example/shop/detail.php?pno=1", detail(1, "루피 한정 피규어 세트"), False),
        ("figures", "https://fig.example/shop/detail.php?pno=3", None, True),
        ("figures", "https://fig.example/shop/detail.php?pno=4", detail(4, "아무 관계 없는 종이 상자"), False)], DETAIL)
    return collection.Fetched(pages, details)


def report(run):
    return {r.source: (r.processed, r.inserted, r.existing, r.updated, r.failed, r.note) for r in run.report.collect()}


def test_run_over_all_types(spark, sources, tmp_path):
    root = str(tmp_path / "content")
    old = spark.createDataFrame([(0, f"{HOST}/goods/2", "오래된 제목", "GOODS")], "seq int, url string, title string, category string")
    snapshots.merge(spark, root, old, NOW, ["seq"], n_buckets=4)
    dry = report(collection.run_collection(spark, root, fetched(spark), sources, NOW, dry_run=True))
    run = collection.run_collection(spark, root, fetched(spark), sources, NOW, n_buckets=4)
    got = report(run)
    failed = "https://fig.example/shop/detail.php?pno=3: 상세 페이지 실패: https://fig.example/shop/detail.php?pno=3"
    assert got == dry == {
        "shop": (3, 2, 1, 1, 0, ""),           # 1 and 3 are new, 2 is stored and gets its price
        "news": (2, 1, 1, 0, 0, ""),           # the shop comes first, so it inserted 3; a feed carries no product field
        "broken": (0, 0, 0, 0, 1, payloads.FEED_ERROR),
        "api": (3, 1, 2, 1, 0, ""),            # repeated entries stay, as an API gives them; the first has a photo
        "figures": (3, 3, 0, 0, 1, failed),    # 1 read, 3 failed, 5 not due; 2 named no figure in the list, 4 none on its page
        "seen": (0, 0, 0, 0, 0, "수동 전용"), "off": (0, 0, 0, 0, 0, "비활성화"),
        "odd": (0, 0, 0, 0, 1, "지원하지 않는 수집 방식: ftp"),
        "TOTAL": (11, 7, 4, 2, 3, "")}
    assert [tuple(r) for r in run.unknown.collect()] == [("nobody", 1)]
    stored = {r.url: r for r in snapshots.read_content(spark, root).collect()}
    assert stored[f"{HOST}/goods/3"].source == "shop" and stored[f"{HOST}/goods/2"].title == "오래된 제목" and stored[f"{HOST}/goods/2"].price == 12000
    assert stored[f"{HOST}/goods/1"].imageUrl == f"{HOST}/1.jpg" and len(stored) == 8
    figure = stored["https://fig.example/shop/detail.php?pno=1"]
    assert (figure.price, figure.manufacturer, figure.title) == (9000, "가나", "루피 한정 피규어 세트")
    again = report(collection.run_collection(spark, root, fetched(spark), sources, NOW))
    assert again["TOTAL"][:4] == (11, 0, 11, 5)


def test_rendered_cards_denied_pages_and_empty_runs(spark, sources, tmp_path):
    cards = spark.createDataFrame(
        [("seen", 1, i, f"{HOST}/b", f"/goods/{n}", None, None, None, "브라우저 상품", "글", None) for i, n in enumerate((1, 1, 2))],
        "source string, page_no int, pos int, page_url string, href string, data_href string, data_url string, onclick string, link_text string,"
        " context_text string, images array<struct<lazy string, src string, width int, height int>>")
    denied = spark.createDataFrame([("shop", 1)], "source string, page_no int")
    nothing = spark.createDataFrame([], PAGE)
    run = collection.run_collection(
        spark, str(tmp_path / "c"), collection.Fetched(nothing, None, cards, denied), sources, NOW, allow_manual=True, n_buckets=4)
    got = report(run)
    assert got["seen"] == (2, 2, 0, 0, 0, "") and got["shop"] == (0, 0, 0, 0, 0, collection.DENIED_REASON) and got["TOTAL"] == (2, 2, 0, 0, 1, "")
    empty = report(collection.run_collection(spark, str(tmp_path / "d"), collection.Fetched(nothing), sources, NOW, n_buckets=4))
    assert empty["TOTAL"] == (0, 0, 0, 0, 1, "") and len(empty) == 9


def test_item_errors_and_links_that_cannot_be_saved(spark, sources):
    rows = collection._arrivals(spark.createDataFrame(
        [("shop", 1, None, None), ("shop", 2, f"{HOST}/goods/1", ["a", "b"]), ("shop", 3, f"{HOST}/goods/2", [])],
        "source string, listed_rank bigint, url string, errors array<string>")).withColumn("ord", F.lit(0))
    from listing_lake.operators import store
    outcome = store.outcome(store.stage(rows, collection.SEQ), spark.createDataFrame([], "url_norm string, content_id string"))
    (r,) = collection.source_counters(rows, outcome).collect()
    assert tuple(r) == ("shop", 3, 2, 0, 0, 2)
    assert [x.message for x in collection.item_errors(rows).orderBy("seq").collect()] == ["None: 저장 실패: url", f"{HOST}/goods/1: a; b"]


FEEDS = {
    "namespaces": "<rss xmlns:dc='u'><channel><item><title>a</title><link>/1</link><dc:date>2024</dc:date></item></channel></rss>",
    "guid": "<rss><channel><item><title>a</title><guid>/7</guid></item><item><title>b</title><guid isPermaLink='false'>/8</guid></item></channel></rss>",
    "encoded": "<rss><channel><item><link>/1</link><content:encoded><![CDATA[<b>q</b>]]></content:encoded></item></channel></rss>",
    "ampersand": "<rss><channel><item><title>b & c &amp; d</title><link>/2</link></item><item><link>/3</link></item></channel></rss>",
    "cut off": "\n<rss><channel><item><title>a</title><link>/1</link></item><item><title>b",
    "declared late": "  <?xml version='1.0'?><rss><channel><item><link>/4</link></item></channel></rss>",
    "atom": "<feed><entry><title type='html'>t</title><link rel='self' href='/s'/><link href='/a'/><content>c</content><updated>5</updated></entry></feed>",
    "empty feed": "<rss><channel></channel></rss>", "other page": "<html><body>x</body></html>",
    "no xml": "not xml", "nothing": "", "missing": None, "hopeless": "<rss><channel><item><title></item></channel></rss>"}


def test_feeds_that_are_not_well_formed(spark):
    rows = spark.createDataFrame([(k, 1, "https://f.example/x", v) for k, v in FEEDS.items()], PAGE)
    parsed = payloads.parse_feeds(rows)
    got = {}
    for r in payloads.feed_entries(parsed).orderBy("source", "pos").collect():
        got.setdefault(r.source, []).append((r.url.removeprefix("https://f.example"), r.title, r.summary, r.publishedAt))
    assert got == {
        "namespaces": [("/1", "a", "", "2024")], "guid": [("/7", "a", "", None)], "encoded": [("/1", "(untitled)", "<b>q</b>", None)],
        "ampersand": [("/2", "b & c & d", "", None), ("/3", "(untitled)", "", None)], "cut off": [("/1", "a", "", None)],
        "declared late": [("/4", "(untitled)", "", None)], "atom": [("/a", "t", "c", "5")]}
    failed = payloads.feed_failures(parsed).collect()
    assert {r.source for r in failed} == {"no xml", "nothing", "missing", "hopeless"} and {r.error for r in failed} == {payloads.FEED_ERROR}


RAW = "source string, kind string, page_no int, url string, content_type string, body binary, failed boolean"


def raw_page(source, page_no, text, charset="utf-8", kind="list", url=f"{HOST}/l"):
    return (source, kind, page_no, url, f"text/html; charset={charset}", bytearray(text.encode("cp949" if charset == "euc-kr" else charset)), False)


def test_stream_of_raw_bodies_equals_one_run(spark, sources, tmp_path):
    first = [raw_page("shop", 1, card(1) + card(2), "euc-kr"), raw_page("news", 1, feed(2, 8))]
    second = [raw_page("shop", 2, card(3, "77,000원 예약"), "euc-kr"), raw_page("news", 2, feed(9))]
    inbox, root = str(tmp_path / "in"), str(tmp_path / "content")
    run = lambda: streams.intake_stream(
        streams.read_stream(spark, inbox, RAW, files_per_batch=1), sources, root, str(tmp_path / "check"), lambda: NOW, str(tmp_path / "reports"), n_buckets=4)
    for rows in (first, second):
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(inbox)
        run()
    whole = str(tmp_path / "whole")
    text = spark.createDataFrame(first + second, RAW)
    pages = text.select("source", "page_no", "url", F.decode("body", "UTF-8").alias("body")).filter("source = 'news'").unionByName(
        text.filter("source = 'shop'").select("source", "page_no", "url", F.decode("body", "x-windows-949").alias("body")))
    collection.run_collection(spark, whole, collection.Fetched(pages), sources, NOW, n_buckets=4)
    rows = lambda at: sorted(map(str, snapshots.read_content(spark, at).collect()))
    assert rows(root) == rows(whole) and len(rows(root)) == 5
    logged = spark.read.parquet(str(tmp_path / "reports")).filter("source = 'TOTAL'").orderBy("batch").collect()
    assert [(r.batch, r.processed, r.inserted) for r in logged] == [(0, 4, 3), (1, 2, 2)]
    versions = snapshots.versions(spark, root)
    for name in ("1", ".1.crc"):  # lost between merge and commit
        (tmp_path / "check" / "commits" / name).unlink()
    run()
    assert snapshots.versions(spark, root) == versions
