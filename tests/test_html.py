import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from listing_lake.operators import details, listings, nodes as N, selectors, shred
from listing_lake.operators.shred import elements, shred_pages
from listing_lake.sources import dims, intake, pages as P, payloads

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
BASE = "https://shop.example.com/list"


def shredded(spark, html, url=BASE, config=None, selectors=()):
    config = {"name": "s", "type": "html", "url": url} | (config or {})
    df = spark.createDataFrame([("s", 1, url, html)], "source string, page_no int, url string, html string")
    return shred_pages(dims.with_source(df, dims.sources_table(spark, [config])), selectors=selectors)


def listed(spark, html, config, url=BASE):
    return listings.extract_listings(shredded(spark, html, url, config), NOW).orderBy("pos").collect()


HTML = """<html><body><div id="top" class="a  b"><p>one<b>two</b> three</p><img src=x.png><!-- no --><script>var x = 1;</script>
<ul><li class="item"><a href="/p/1?x=&quot;&amp;">A &amp; B</a></li><li class="item sold"><a href="http://o.example/p/2">C</a><p>d</li></ul></div></body></html>"""


def test_shred(spark):
    rows = elements(shredded(spark, HTML)).orderBy("pos").collect()
    tags = [r.tag for r in rows]
    assert tags == ["html", "body", "div", "p", "#text", "b", "#text", "#text", "img", "script", "#code", "ul", "li", "a", "#text", "li",
                    "a", "#text", "p", "#text"]
    assert [r.text for r in rows if r.text] == ["one", "two", "three", "var x = 1;", "A & B", "C", "d"]
    by_id = {r.node_id: r for r in rows}
    assert all(r.parent_id is None or by_id[r.parent_id].node_id < r.node_id <= r.last_id <= by_id[r.parent_id].last_id for r in rows)
    assert by_id[13].attrs == {"href": '/p/1?x="&'}


SELECTORS = [
    ("li", [12, 15]), ("li.item.sold", [15]), ("#top", [2]), ("div#top.b ul > li", [12, 15]), ("body > li", []), ("li:not(.sold) a", [13]),
    ('a[href^="/p/"]', [13]), ('a[href*="p/2"]', [16]), ("a[href]", [13, 16]), ("li:has(p)", [15]), ("li:has(> p), b", [5, 15]),
    ('li:-soup-contains("A & B")', [12]), ("img, p b", [5, 8]), ("li a:not(.sold a)", [13]), ('a[href="/p/1?x=\\"&"]', None), ("*.item", [12, 15]),
    (".a", [2]), ('div[class~="b"]', [2]), ("div p b", [5]), ("l", []), (".ite", []),
    ("ul:has(b) > li", []), ("div:has(b) > ul > li:not(.sold)", [12]), ('div:-soup-contains("onetwo") > p', [3]), ("div:has(> ul:has(p)) a", [13, 16]),
    ('[class="a b"] > ul', [11]), ('[class^="ite"][class$="ld"]', [15]), ("li:has(a:not([href^='/']))", [15]), ("li:not(:has(p))", [12]),
    ("li:has(p, b)", [15]), ("body *:not(div *)", [2]), (":scope > html > body", [1]), (":scope li > p", [18]),
]


def test_selectors(spark):
    page = shredded(spark, HTML, selectors=[css for css, want in SELECTORS if want is not None])
    cases = [(css, want) for css, want in SELECTORS if want is not None]
    found = page.select(*[
        F.transform(N.select_all(F.col("nodes"), N.literal_selector(css)), lambda n: n["id"]).alias(f"c{i}") for i, (css, _) in enumerate(cases)
    ]).first()
    assert {css: found[i] for i, (css, _) in enumerate(cases)} == dict(cases)
    with pytest.raises(ValueError):
        N.selector("a + b")


def test_visible_text(spark):
    html = '<div>now <b>12,000원</b><p class="DisplayNone x">예약</p><i style="color:red; display: none"><u>품절</u></i></div>'
    got = shredded(spark, html).select(N.visible_text(F.col("nodes")).alias("v")).first().v
    assert got == "now\n12,000원"


NEWS = """<div class="wrap"><div class="c-item"><div class="ph"><img src="/img/icon.png"><img data-src="/photo/a.jpg" src="/blank.gif"></div>
<h3><a href="/news/1?utm_source=x">첫 번째 소식입니다</a></h3></div>
<div class="c-item"><div class="ph"><img src="/photo/b.jpg" width=40 height=40><img srcset="/photo/c.jpg 2x, /photo/d.jpg" ></div><h3><a href="/news/2">두 번째 소식입니다</a></h3></div>
<div class="c-item"><h3><a href="/news/3">세 번째 소식입니다</a></h3></div><a href="/x">짧</a></div>"""


def test_news_cards_do_not_borrow(spark):
    rows = listed(spark, NEWS, {"link_selector": ".c-item a", "list_image_selector": "img", "title_strip_pattern": r"입니다$"})
    assert [(r.url, r.title, r.imageUrl) for r in rows] == [
        ("https://shop.example.com/news/1", "첫 번째 소식", "https://shop.example.com/photo/a.jpg"),
        ("https://shop.example.com/news/2", "두 번째 소식", "https://shop.example.com/photo/c.jpg"),
        ("https://shop.example.com/news/3", "세 번째 소식", None)]


CARDS = """<ul><li><a href="/product/detail.html?product_no=1"><img src="/big/1.jpg"></a><p class="name"><a href="/product/detail.html?product_no=1">
<span class="title">상품명</span> <span>피규어　하나</span></a></p><p>소비자가 : 82,000원</p><p>판매가 : 62,000
원</p><p>발매 : 27년</p></li>
<li><p class="name"><a href="/product/2"><span>피규어 둘 카드</span></a></p><img alt="품절" src="/i.gif"> 9,000원 마감 26년 3월 5일</li>
<li><p class="name"><a href="/product/{$url}"><span>틀에 남은 카드</span></a></p></li></ul>"""


def test_card_products(spark):
    config = {
        "link_selector": "p.name a", "title_selector": ":scope > span:not(.title)", "list_product_mode": True, "card_alt_text": True,
        "price_pattern": r"판매가\s*:\s*([\d,]+)\s*원|([\d,]+)원 마감", "preorder_words": ["발매 :"], "allow_patterns": [r"product_no=\d", r"/product/\d"],
        "list_image_selector": "img", "shop": "가게"}
    a, *rest = listed(spark, CARDS, config)
    assert (a.title, a.price, a.saleStatus, a.shop, a.imageUrl) == ("피규어 하나", 62000, "PREORDER", "가게", "https://shop.example.com/big/1.jpg")
    (b,) = rest
    assert (b.title, b.price) == ("피규어 둘 카드", None)
    config["price_pattern"] = None
    b = listed(spark, CARDS, config)[1]
    assert (b.price, b.saleStatus, b.preorderEndAt, b.entityType) == (9000, "SOLD_OUT", "2026-03-05", "PRODUCT")


def test_published(spark):
    html = '<a href="/n/1">소식 하나 입니다<p>2026/1/5</p></a><a href="/n/2">소식 둘 입니다<p>어제</p></a><a href="/n/3">소식 셋 입니다<p>곧</p></a><a href="/n/4">소식 넷 입니다</a>'
    rows = listed(spark, html, {"published_selector": "p", "published_format": "%Y/%m/%d"})
    assert [(r.publishedAt, r.errors) for r in rows] == [
        ("2026-01-05", []), ("2025-12-31", []), (None, ["게시일 형식 오류: 곧"]), (None, [])]
    assert listed(spark, '<a href="/n/1">소식 하나 입니다<time datetime="x">y</time></a>', {"published_selector": "time"})[0].publishedAt == "x"


PROFILE = {"extract": {
    "list": {"item": "li.item", "fields": {
        "link": {"selector": "a", "attr": "href"}, "title": {"selector": ".t"}, "image": {"selector": "img.ph", "attr": "data-src"},
        "price": {"selector": ".price", "parse": "krw"}, "status": {"selector": ".badge, img.sold", "parse": "sale_status", "attr": "alt"},
        "deadline": {"selector": ".d", "parse": "date"}}},
    "detail": {"fields": {"gallery": {"selector": ".g img", "attr": "src", "many": True}, "price": {"selector": "b", "parse": "krw"},
                          "image": {"selector": ".main img", "attr": "src"}}}}}
MAPPED = """<p>99,000원</p><ul><li class="item"><a href="/product/1"><img class="ph" data-src="/img/a.jpg"></a><span class="t">테스트 피규어 A</span>
<i class="price">12,000원</i><i class="badge">예약</i><i class="d">26년 3월 5일</i></li><li class="item"><a href="/product/2"></a><span class="t">테스트 피규어 B</span>
<i class="price">8,500원</i><i class="badge"></i><img class="sold" alt="품절"></li><li class="item"><span class="t">링크 없는 카드</span></li></ul>"""


def test_mapped_list(spark):
    rows = listed(spark, MAPPED, PROFILE)
    got = [(r.title, r.price, r.saleStatus, r.url, r.imageUrl, r.preorderEndAt) for r in rows]
    assert got == [
        ("테스트 피규어 A", 12000, "PREORDER", "https://shop.example.com/product/1", "https://shop.example.com/img/a.jpg", "2026-03-05"),
        ("테스트 피규어 B", 8500, "SOLD_OUT", "https://shop.example.com/product/2", None, None)]


def joined(spark, config, detail_html, card=None, failed=False):
    url = "https://shop.example.com/product/1"
    config = {"name": "s", "type": "html", "url": BASE} | config
    table = dims.sources_table(spark, [config])
    base = {"source": "s", "page_no": 1, "pos": 1, "url": url, "title": "제목", "imageUrl": "https://shop.example.com/card.jpg", "errors": [],
            "price": 12000, "saleStatus": "IN_STOCK", "entityType": "PRODUCT", "shop": "s", "currency": "KRW", "preorderEndAt": None,
            "productCheckedAt": None} | (card or {})
    schema = ("source string, page_no int, pos int, url string, title string, imageUrl string, errors array<string>, price bigint, saleStatus string,"
              " entityType string, shop string, currency string, preorderEndAt string, productCheckedAt timestamp")
    candidates = dims.with_source(spark.createDataFrame([base], schema), table)
    page = dims.with_source(spark.createDataFrame([("s", url, detail_html)], "source string, url string, html string"), table)
    read = details.read_details(shred_pages(page), NOW).withColumn("failed", F.lit(failed))
    return details.apply_details(candidates, read, NOW).first()


DETAIL = """<head><meta property="og:image" content="/og/logo.png"><meta name="twitter:image" content="/og/p.jpg"></head><nav>예약</nav>
<div class="panel">판매가 178,000원 <p class="hidden">품절</p></div><div class="g"><img src="/og/p.jpg"><img ec-data-src="/d1.jpg"><img src="/d1.jpg"><img src="/icon.png"></div>"""


def test_detail_modes(spark):
    image = joined(spark, {"fetch_detail_image": True}, DETAIL)
    assert (image.imageUrl, image.price, image.detailImageUrls) == ("https://shop.example.com/og/p.jpg", 12000, None)
    product = joined(spark, {"product_mode": True, "product_text_selector": ".panel", "detail_images_selector": ".g img"}, DETAIL)
    assert (product.price, product.saleStatus, product.imageUrl) == (178000, "IN_STOCK", "https://shop.example.com/og/p.jpg")
    assert product.detailImageUrls == ["https://shop.example.com/d1.jpg"] and product.detailCheckedAt == NOW.replace(tzinfo=None)
    whole = joined(spark, {"product_mode": True}, DETAIL)
    assert whole.saleStatus == "PREORDER"
    gallery = joined(spark, {"list_product_mode": True, "detail_images_selector": ".g img"}, DETAIL)
    assert (gallery.price, gallery.imageUrl) == (12000, "https://shop.example.com/card.jpg")
    assert gallery.detailImageUrls == ["https://shop.example.com/og/p.jpg", "https://shop.example.com/d1.jpg"]
    none = joined(spark, {"list_product_mode": True, "detail_images_selector": ".none img"}, DETAIL)
    assert none.detailImageUrls == [] and none.errors == []
    idle = joined(spark, {}, DETAIL)
    assert (idle.detailImageUrls, idle.detailCheckedAt, idle.price) == (None, None, 12000)
    failed = joined(spark, {"product_mode": True}, DETAIL, failed=True)
    assert failed.price == 12000 and len(failed.errors) == 1


def test_mapped_detail(spark):
    html = '<div class="main"><img src="/m.jpg"></div><b>31,000원</b><div class="g"><img src="/g1.jpg"><img src="/m.jpg"><img src="/g1.jpg"><img src="/logo.png"></div>'
    row = joined(spark, PROFILE, html)
    assert (row.price, row.saleStatus, row.imageUrl) == (31000, "IN_STOCK", "https://shop.example.com/m.jpg")
    assert row.detailImageUrls == ["https://shop.example.com/g1.jpg"]


def test_empty_listing(spark):
    page = shredded(spark, "<p>none</p>")
    assert listings.empty_listings(page, listings.extract_listings(page, NOW)).count() == 1


FIGURE = """<head><meta property="og:title" content="피규어팜"></head><h1>짧다</h1><div class="goods_name">[3월 입고] 넨도로이드 프리렌</div>
<p>제조사</p><p>굿스마일</p><p>치수 : 높이 10cm</p><p>3,000원</p><p>62,000원</p><p>예약마감일 : 26년 3월 5일</p>"""


def test_figure_products(spark):
    row = details.figure_products(shredded(spark, FIGURE), NOW).first()
    assert (row.title, row.price, row.saleStatus, row.preorderEndAt) == ("[3월 입고] 넨도로이드 프리렌", 62000, "PREORDER", "2026-03-05")
    assert (row.releaseWindowText, row.manufacturer, row.sizeText, row.currency) == ("3월 입고", "굿스마일", "높이 10cm", "KRW")
    failed = details.figure_products(shredded(spark, "<p>x</p>"), NOW).first()
    assert (failed.title, failed.errors, failed.price) == (details.TITLE_FAILED, [details.TITLE_ERROR], None)
    long_line = details.figure_products(shredded(spark, "<p>아주 긴 피규어 상품 이름 줄입니다</p><p>품절</p>"), NOW).first()
    assert (long_line.title, long_line.saleStatus) == ("아주 긴 피규어 상품 이름 줄입니다", "SOLD_OUT")
    assert details.figure_products(shredded(spark, '<h1>일반 문구 상품 이름</h1>'), NOW).count() == 0


def test_figure_links(spark):
    html = """<div class="ffm-product-card"><a href="/shop/detail.php?pno=1">x</a><b class="name">넨도로이드 A</b></div>
    <div class="ffm-product-card"><a href="/shop/detail.php?pno=2">x</a><b class="name">스티커</b></div><a href="/shop/detail.php?pno=3">x</a><a href="detail.php?z">y</a>"""
    rows = details.figure_links(shredded(spark, html)).orderBy("pos").collect()
    assert [(r.url[-1], r.list_title, r.is_candidate) for r in rows] == [("1", "넨도로이드 A", True), ("2", "스티커", False), ("3", "", True)]


def test_charsets(spark):
    text = "[예약] 건담 똠"
    meta = f'<meta charset="euc-kr">{text}'
    raw = [(1, "text/html", meta.encode("cp949"), meta), (2, "text/html; charset=utf-8", meta.encode(), meta),
           (3, None, f'<meta charset="nonsense">{text}'.encode(), f'<meta charset="nonsense">{text}'), (4, "text/html", text.encode("cp949"), text),
           (5, "text/html", '<meta content="text/html; charset=Shift_JIS">予約'.encode("shift_jis"), '<meta content="text/html; charset=Shift_JIS">予約'),
           (6, None, b"ok \xec\x98", None)]
    df = spark.createDataFrame([r[:3] for r in raw], "i int, content_type string, body binary")
    got = {r.i: r.html for r in P.decode_pages(df).collect()}
    assert {i: got[i] for i in range(1, 6)} == {r[0]: r[3] for r in raw[:5]}


RSS = """<rss xmlns:dc="x"><channel><title>f</title><item><title>A</title><link>/a?utm_source=r</link><description>d&amp;e</description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item>
<item><title></title><link>https://f.example/b</link></item><item><title>no link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>E</title><link rel="self" href="/self"/><link rel="alternate" href="/e"/><summary>s</summary><updated>2026-01-05T00:00:00Z</updated></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("r", "https://f.example/feed", RSS), ("a", "https://f.example/atom", ATOM), ("x", "https://f.example/x", "<rss")], "source string, url string, body string")
    rows = sorted(map(tuple, payloads.read_feed_xml(df).collect()))
    assert rows == [
        ("a", 0, "https://f.example/e", "E", "s", "2026-01-05T00:00:00Z"),
        ("r", 0, "https://f.example/a", "A", "d&e", "Mon, 05 Jan 2026 10:00:00 GMT"),
        ("r", 1, "https://f.example/b", "(untitled)", "", None)]


API = {"name": "s", "type": "json_api", "items_path": "listData", "id_field": "idx", "title_field": "title", "image_html_field": "content",
       "page_count_field": "pageCount", "detail_url_template": "https://www.example.com/post/{id}", "date_field": "meta.0.day", "date_format": "%Y-%m-%d %H:%M:%S.%f"}
BODY = r"""{"listData":[{"idx":1,"title":"타임테이블","meta":[{"day":"2026-01-05 10:00:00.0"}],"content":"<p><img src=\"https://pbs.twimg.com/media/G6M?format=jpg&amp;name=large\"></p>"},
{"idx":2,"title":"이미지 없음","meta":[{"day":"soon"}],"content":"<p>본문만</p>"},{"idx":3,"title":""},{"title":"no id"}], "pageCount":2}"""


def test_json(spark):
    table = dims.sources_table(spark, [API])
    bodies = [(1, BODY), (2, BODY), (3, BODY)]
    df = spark.createDataFrame([("s", n, "https://www.example.com/api", b) for n, b in bodies], "source string, page_no int, url string, body string")
    df = dims.with_source(df, table).withColumn("api", F.col("src.api")).drop("src")
    read = payloads.page_count_stop(df)
    assert sorted(r.page_no for r in read.select("page_no").collect()) == [1, 2]
    rows = payloads.with_entry_image(payloads.read_json_payloads(read.filter("page_no = 1"))).orderBy("pos").collect()
    assert [(r.url, r.title, r.publishedAt, r.imageUrl) for r in rows] == [
        ("https://www.example.com/post/1", "타임테이블", "2026-01-05", "https://pbs.twimg.com/media/G6M?format=jpg&name=large"),
        ("https://www.example.com/post/2", "이미지 없음", "soon", None)]
    empty = df.withColumn("body", F.when(F.col("page_no") == 2, '{"listData":[]}').otherwise('{"listData":[1]}'))
    assert [r.page_no for r in payloads.page_count_stop(empty).select("page_no").collect()] == [1]


def test_manual_entries(spark):
    df = spark.createDataFrame([
        (1, "https://store.laftel.net/products/1", " 피규어 ", "FIGURE", "NEWS", None, ""), (2, "https://store.laftel.net/products/1", "", "GOODS", "NEWS", "OFFICIAL", None),
        (3, "https://e.example/a", "t", "FIGURE", "NEWS", None, "javascript:x"), (4, "nope", "t", "FIGURE", "NEWS", None, None)],
        "seq int, url string, title string, category string, angle string, tier string, image_url string")
    good, bad = intake.manual_entries(df)
    a, b = good.orderBy("seq").collect()
    assert (a.title, a.source, a.sourceType, a.shop, a.entityType, a.saleStatus) == ("피규어", "Laftel Store", "manual_product", "Laftel", "PRODUCT", "UNKNOWN")
    assert (b.title, b.source, b.entityType, b.sourceTier) == ("(제목 없음)", "수동 입력", None, "OFFICIAL")
    assert sorted((r.seq, r.reject_reason) for r in bad.collect()) == [(3, "image"), (4, "url")]


def test_rendered_cards(spark):
    table = dims.sources_table(spark, [{"name": "s", "type": "local_browser", "product_mode": True, "allow_patterns": ["/PRODUCTS/"], "required_text_patterns": ["피규어"]}])
    images = [{"lazy": "", "src": "/logo.png", "width": 300, "height": 300}, {"lazy": "/small.jpg", "src": "", "width": 40, "height": 40},
              {"lazy": "", "src": "/ok.jpg", "width": 0, "height": 0}]
    rows = [(1, "/products/1", None, "피", "피규어 상품 이름\n12,000원 예약", images), (2, None, "go('/products/2')", "링크 문구", "스티커", []), (3, "/other/3", None, "긴 제목", "피규어", [])]
    df = spark.createDataFrame([("s", 1, i, BASE, h, None, None, o, t, c, im) for i, h, o, t, c, im in rows],
                               "source string, page_no int, pos int, page_url string, href string, data_href string, data_url string, onclick string,"
                               " link_text string, context_text string, images array<struct<lazy:string,src:string,width:int,height:int>>")
    (row,) = intake.rendered_cards(dims.with_source(df, table), NOW).collect()
    assert (row.url, row.title, row.price, row.saleStatus, row.imageUrl) == (
        "https://shop.example.com/products/1", "피규어 상품 이름", 12000, "PREORDER", "https://shop.example.com/ok.jpg")


def parsed(html, *css):
    """Nodes of a page, with the ids each selector picks."""
    parts = tuple(dict.fromkeys(row["css"] for c in css for row in selectors.parse(c)))
    nodes = shred._page_nodes(html, BASE, parts)
    return nodes, {part: [n["id"] for n in nodes for hit in n["hits"] or [] if hit["css"] == part] for part in parts}


def test_unsupported_selectors_are_refused():
    for css in ("a + b", "li ~ p", "a >", "> ", ":hover", "a:has(b:not(c d))", "a b:scope"):
        with pytest.raises(ValueError):
            selectors.parse(css)


class Plain:
    """Selectors by walking the tree anew for every question."""

    def __init__(self, nodes):
        self.nodes = nodes

    def above(self, i):
        while self.nodes[i]["parent"] is not None:
            i = self.nodes[i]["parent"]
            yield i

    def below(self, i):
        return [n["id"] for n in self.nodes[i + 1:self.nodes[i]["last"] + 1] if n["text"] is None]

    def simple(self, i, compound):
        tag, classes, function, argument = compound
        node = self.nodes[i]
        if node["text"] is not None or tag not in ("*", node["tag"]) or not set(classes) <= set((dict(node["attrs"]).get("class") or "").split()):
            return False
        if function == "has":
            return any(self.chain(d, argument, i) for d in self.below(i))
        if function == "not":
            return not self.chain(i, argument, None)
        if function == "words":
            return argument in "".join(n["text"] for n in self.nodes[i:node["last"] + 1] if n["tag"] == "#text")
        return True

    def chain(self, i, steps, anchor):
        """`steps`: (child, compound) from outermost to innermost. With an anchor the chain lies below it."""
        (child, compound), outer = steps[-1], steps[:-1]
        if not self.simple(i, compound):
            return False
        ups = list(self.above(i))
        if not outer:
            return anchor is None or (anchor == -1 and (not child or not ups)) or (ups[:1] == [anchor] if child else anchor in ups)
        return any(self.chain(u, outer, anchor) for u in (ups[:1] if child else ups) if anchor is None or anchor == -1 or u > anchor)


def spelled(steps, scoped=False):
    out = []
    for nth, (child, (tag, classes, function, argument)) in enumerate(steps):
        text = tag + "".join(f".{c}" for c in classes)
        if function == "words":
            text += f':-soup-contains("{argument}")'
        elif function:
            text += f":{function}({spelled(argument)})"
        out.append(("> " if child and (nth or scoped or argument_like(steps)) else "") + text)
    return " ".join(out)


def argument_like(steps):
    return steps[0][0]


def test_selectors_agree_with_walking_the_tree():
    pick = random.Random(11)
    tags, classes = ["div", "p", "ul", "li", "b"], ["x", "y"]

    def page(depth=0):
        out = ""
        for _ in range(pick.randrange(1, 4)):
            tag = pick.choice(tags)
            inner = page(depth + 1) if depth < 4 and pick.random() < 0.7 else ""
            names = " ".join(c for c in classes if pick.random() < 0.4)
            out += f'<{tag} class="{names}">{pick.choice(["", "figure", "sale"])}{inner}</{tag}>{pick.choice(["", "fig"])}'
        return out

    def compound(level, inside):
        kinds = [None, None, "words"] + (["has", "not"] if level < 2 else [])
        function = pick.choice(kinds)
        argument = "figure" if function == "words" else steps(level + 1, function == "has" or inside, function == "not") if function else None
        return pick.choice([*tags, "*"]), [c for c in classes if pick.random() < 0.2], function, argument

    def steps(level=0, inside=False, negated=False):
        n = 1 if negated and inside else pick.randrange(1, 3 if level else 4)
        return [(pick.random() < 0.4 and (i > 0 or (inside and not negated)), compound(level, inside)) for i in range(n)]

    checked = hits = 0
    for _ in range(60):
        html, asked = page(), [steps() for _ in range(12)]
        nodes, got = parsed(html, *[spelled(s) for s in asked])
        plain = Plain(nodes)
        for s in asked:
            want = [n["id"] for n in nodes if plain.chain(n["id"], s, None)]
            assert got[spelled(s)] == want, (spelled(s), html)
            checked, hits = checked + 1, hits + len(want)
        for s in asked[:4]:
            direct = pick.random() < 0.5
            scoped = [(direct, s[0][1]), *s[1:]]
            css = ":scope " + spelled(scoped, scoped=True)
            found, _ = parsed(html, css)
            for root in [-1, *[n["id"] for n in nodes if n["text"] is None]][:12]:
                inside = range(len(nodes)) if root == -1 else plain.below(root)
                want = [i for i in inside if nodes[i]["text"] is None and plain.chain(i, scoped, root)]
                at = {n["id"]: hit["at"] for n in found for hit in n["hits"] or []}
                assert [i for i in inside if i in at and (root in at[i] if direct else at[i][0] > root)] == want, (css, root, html)
    assert checked == 720 and hits > 500


def test_deep_and_wide_pages_take_linear_time_and_memory(spark):
    deep = '<div class="a b">' * 10_000 + "<p>end</p>"
    wide = "".join(f'<li><a href="/p/{i}">item {i}</a><a href="/p/{i}">again</a></li>' for i in range(10_000))

    def seconds(html, *css):
        start = time.perf_counter()
        nodes, found = parsed(html, *css)
        return time.perf_counter() - start, nodes, found

    asked = ("div.a div p", "div:has(p) > p", 'div:-soup-contains("end") > div.b', ":scope > div > p", "div:not(ul div):has(> p)", "li:has(a) > a")
    took, nodes, found = seconds(deep, *asked)
    half, _, _ = seconds(deep[:len('<div class="a b">') * 5_000] + "<p>end</p>", *asked)
    assert [len(found[c]) for c in asked] == [1, 1, 9_999, 1, 1, 0] and sum(len(n["near"]) for n in nodes) <= 8 * len(nodes)
    assert took < 4 * half + 1
    # Through Spark: ten thousand links on one page, each with its card.
    rows = shredded(spark, f"<ul>{wide}</ul>", config={"link_selector": "li > a", "list_product_mode": True})
    found = listings.with_links(rows).select(F.explode("links").alias("l")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l.card").isNotNull()).alias("cards"), F.countDistinct("l.card").alias("distinct")).first()
    assert (found.n, found.cards, found.distinct) == (20_000, 20_000, 10_000)


def test_nearest_other_links(spark):
    keys = "aabbbcaad"
    links = [(i * 2, k) for i, k in enumerate(keys)]
    df = spark.createDataFrame([(links,), ([],), (links[:1],)], "links array<struct<id:int,key:string>>")
    got = df.select(N.with_gaps(F.col("links"), F.lit(99)).alias("g")).collect()
    want = []
    for i, k in enumerate(keys):
        low = max((j * 2 for j in range(i) if keys[j] != k), default=-1)
        high = min((j * 2 for j in range(i + 1, len(keys)) if keys[j] != k), default=99)
        want.append((i * 2, k, low, high))
    assert [tuple(x) for x in got[0].g] == want and got[1].g == [] and [tuple(x) for x in got[2].g] == [(0, "a", -1, 99)]


def test_batches_of_pages_are_bounded_by_bytes():
    big = shred.BATCH_BYTES
    assert list(shred._slices([1, big, big + 5, 1, 1])) == [(0, 1), (1, 1), (2, 1), (3, 2)]
    assert list(shred._slices([])) == [] and [n for _, n in shred._slices([0] * 130)] == [64, 64, 2]
