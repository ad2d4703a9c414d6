from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from listing_lake.functions import cards
from listing_lake.operators import feed
from listing_lake.operators.store import CONTENT_DDL, conform

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def content(spark, *rows):
    return conform(spark.createDataFrame([{"content_id": f"FIGURE:{i}", **r} for i, r in enumerate(rows)], CONTENT_DDL))


def test_score(spark):
    df = content(
        spark,
        {"publishedAt": NOW.isoformat()},
        {"sourceTier": "OFFICIAL", "region": "KR", "entityType": "PRODUCT", "saleStatus": "PREORDER",
         "title": "한정판 피규어", "collectedAt": NOW},
        {"publishedAt": (NOW - timedelta(hours=216)).isoformat()},
        {"collectedAt": NOW - timedelta(hours=215, minutes=59)},
        {"title": "x"},
    )
    rows = cards.with_score(df, NOW).orderBy("content_id").collect()
    assert [r.signal_score for r in rows] == [35.0, 51.0, 0.0, 0.0, 0.0]
    assert [len(r.components) for r in rows] == [1, 5, 0, 1, 0]


def test_score_matches_rounding_of_the_formula(spark):
    ages = [7 * i * 60 + 13 for i in range(0, 1800, 7)]
    df = content(spark, *[{"collectedAt": NOW - timedelta(seconds=a)} for a in ages])
    got = {r.collectedAt: r.signal_score for r in cards.with_score(df, NOW).collect()}
    for a in ages:
        want = round(max(0.0, 100 - a / 3600 / 2.16) * 0.35, 1)
        assert got[(NOW - timedelta(seconds=a)).replace(tzinfo=None)] == want


def test_breakdown_sums_and_sorts(spark):
    df = content(spark, {"sourceTier": "OFFICIAL", "region": "KR", "entityType": "PRODUCT", "saleStatus": "PREORDER",
                         "title": "한정판", "collectedAt": NOW - timedelta(hours=200)})
    view = cards.card_view(df, NOW).first().view
    points = [p.points for p in view.score_breakdown]
    assert points == sorted(points, reverse=True)
    assert round(sum(points), 1) == view.signal_score
    assert [p.label for p in view.score_breakdown] == ["공식 소스", "국내", "예약 임박", "한정판", "신선도"]


def test_card_view(spark):
    df = content(spark, {
        "url": "https://shop.example/p/1", "title": "2026.01.02 [예약] 프리렌", "titleKo": " ", "source": "가게", "category": "FIGURE",
        "summary": "가" * 130, "sourceLanguage": "ja", "collectedAt": NOW, "imageUrl": "javascript:x",
        "detailImageUrls": ["https://i.example/a.jpg", "https://i.example/logo.png"], "publishedAt": "2026-01-01",
        "entityType": "PRODUCT", "price": 12000, "currency": "USD", "shop": "가게", "saleStatus": "IN_STOCK",
    }, {"title": "Frieren", "titleKo": "프리렌", "sourceLanguage": "ZH-cn", "postedAt": NOW})
    a, b = [r.view for r in cards.card_view(df, NOW).orderBy("content_id").collect()]
    assert (a.title_date, a.title_text, a.original_title, a.lang_tag) == ("2026.01.02", "[예약] 프리렌", "", "")
    assert (a.image_url, a.detail_image_urls) == ("", ["https://i.example/a.jpg"])
    assert a.summary == "가" * 120 + "…"
    assert a.product_caption == "가게 · 판매중 · 12,000 USD"
    assert a.meta == "가게 · 피규어 · 뉴스 · 미디어 · 새 항목 · 미발행 · 게시 2026-01-01 · 수집 2026-01-01 09:00"
    assert a.is_new_today and a.signal_labels == ["NEW"]
    assert (b.title_text, b.original_title, b.lang_tag) == ("프리렌", "Frieren", "CH")
    assert b.meta == "미분류 · 뉴스 · 미디어 · 새 항목 · 발행 2026-01-01 09:00"


def test_deadline_mark(values):
    item = {c: F.lit(None).cast("string") for c in cards.CARD_FIELDS}
    item |= {"entityType": F.lit("PRODUCT"), "price": F.lit(None).cast("bigint"), "preorderEndAt": F.lit("2026-06-12")}
    got = values([("2026-09-19",), ("2026-06-12",)], "d string", cards.product_caption(item, F.col("d")))
    assert got == ["예약마감 2026-06-12 (마감 지남)", "예약마감 2026-06-12"]


FIGURE_A = {"title": "[예약] 넨도로이드 프리렌 [3차]", "shop": "헤로타임", "saleStatus": "PREORDER", "price": 62000, "currency": "KRW",
            "manufacturer": "굿스마일", "entityType": "PRODUCT", "url": "https://a.example/1"}
FIGURE_B = {"title": "넨도로이드 프리렌", "shop": "코믹스아트", "saleStatus": "IN_STOCK", "price": 58000, "currency": "KRW",
            "entityType": "PRODUCT", "url": "javascript:alert(1)"}
NEWS = {"title": "새 소식", "source": "뉴스", "url": "https://n.example/1"}


def digest(spark, *rows):
    df = content(spark, *rows)
    posts = cards.feed_items(df.withColumn("works", F.array().cast("array<string>")), NOW)
    ranked = posts.withColumn("g", F.lit(1)).withColumn("rank", F.split_part("id", F.lit(":"), F.lit(2)).cast("int"))
    return feed.digest(ranked, ["g"]).first()


def test_digest(spark):
    both = digest(spark, FIGURE_A, FIGURE_B)
    assert both.body == (
        "1. 넨도로이드 프리렌\n   헤로타임 · 예약중 · 62,000원 · 굿스마일\n2. 넨도로이드 프리렌\n   코믹스아트 · 판매중 · 58,000원\n")
    assert both.reply == "상품 페이지 참고 ↓\n\n1. 넨도로이드 프리렌\nhttps://a.example/1\n"
    news = digest(spark, NEWS)
    assert (news.body, news.reply) == ("1. 새 소식\n   뉴스\n", "링크 ↓\n\n1. 새 소식\nhttps://n.example/1\n")
    assert digest(spark, {**FIGURE_B}).reply == ""


def test_short_name_and_length(values):
    name = cards.short_name(F.col("t"), F.col("k"), F.col("m"), F.col("s"))
    rows = [("[예약]", None, None, None), (None, None, None, None), ("【한정】 굿스마일 렘 (c++) - 헤로타임", None, "굿스마일", "헤로타임"),
            ("Figure A+B https://x.example/1 |", "", "a+b", "q"), ("원제", "번역", None, None)]
    assert values(rows, "t string, k string, m string, s string", name) == [
        "[예약]", "(제목 없음)", "렘 (c++)", "Figure", "번역"]
    assert values([("가 https://example.com/xxx?y=1",)], "t string", cards.post_length(F.col("t"))) == [25]


def test_recommended(spark):
    rows = [{"collectedAt": NOW - timedelta(hours=i + 1), "status": "NEW"} for i in range(12)]
    rows += [{"collectedAt": NOW, "status": "IGNORE"}, {"collectedAt": NOW, "status": "NEW", "postedAt": NOW},
             {"collectedAt": NOW - timedelta(days=3), "status": "NEW", "sourceTier": "OFFICIAL", "region": "KR",
              "entityType": "PRODUCT", "saleStatus": "PREORDER", "title": "한정판"},
             {"collectedAt": NOW - timedelta(days=15), "status": "NEW", "publishedAt": NOW.isoformat(), "sourceTier": "OFFICIAL"}]
    got = [r.content_id for r in feed.recommended(content(spark, *rows), NOW).collect()]
    assert got == ["FIGURE:14"] + [f"FIGURE:{i}" for i in range(9)]


def test_inbox_filters_after_the_limit(spark):
    rows = [{"collectedAt": NOW - timedelta(hours=i), "status": "IGNORE" if i < 29 else "NEW", "source": f"s{i % 2}"} for i in range(40)]
    rows.append({"collectedAt": NOW - timedelta(days=20), "status": "NEW"})
    df = content(spark, *rows)
    assert [r.content_id for r in feed.inbox_page(df, NOW).collect()] == ["FIGURE:29"]
    page = feed.keyset_page(df, NOW, days="14")
    cursor = feed.page_cursor(page).first()
    assert cursor.has_more and cursor.after_id == "FIGURE:29"
    after = (cursor.after_collected_at.replace(tzinfo=timezone.utc), cursor.after_id)
    assert feed.keyset_page(df, NOW, days="14", after=after).count() == 10
    assert feed.recent(df, NOW, "nonsense").count() == 40 and feed.recent(df, NOW, "ALL").count() == 41
    assert [r.source for r in feed.source_options(page).collect()] == ["s0", "s1"]


def test_feed_search_sort_and_facets(spark):
    df = content(
        spark, {"title": "Re: 제로 렘 피규어", "source": "A", "category": "FIGURE", "collectedAt": NOW},
        {"title": "기타", "source": "B", "category": "GOODS", "collectedAt": NOW - timedelta(days=8)},
        {"title": "원피스", "source": "B", "category": "FIGURE", "collectedAt": NOW - timedelta(days=1)},
    ).withColumn("works", F.when(F.col("title").contains("제로"), F.array(F.lit("Re:제로부터"))).when(
        F.col("title") == "원피스", F.array(F.lit("ONE PIECE"), F.lit("Re:제로부터"))).otherwise(F.array().cast("array<string>")))
    items = cards.feed_items(df, NOW)
    aliases = spark.createDataFrame([("Re:제로부터", ["리제로"]), ("ONE PIECE", ["원피스", "Ｏｐ"])], "name string, aliases array<string>")
    searchable = feed.with_search_text(items, aliases)
    ids = lambda **kw: [r.id for r in feed.query_feed(searchable, NOW, **kw).collect()]
    assert ids() == ["FIGURE:0", "FIGURE:2", "FIGURE:1"]
    assert ids(sort="OLDEST") == ["FIGURE:1", "FIGURE:2", "FIGURE:0"]
    assert ids(q="리제로") == ["FIGURE:0", "FIGURE:2"] and ids(q="OP") == ["FIGURE:2"]
    assert ids(work="__NONE__") == ["FIGURE:1"] and ids(work="ONE PIECE") == ["FIGURE:2"]
    assert ids(source="B", category="FIGURE") == ["FIGURE:2"] and ids(days="7") == ["FIGURE:0", "FIGURE:2"]
    counts = {(r.kind, r.value): r.n for r in feed.facets(items).collect()}
    assert counts == {("total", ""): 3, ("unclassified", ""): 1, ("work", "Re:제로부터"): 2, ("work", "ONE PIECE"): 1,
                      ("source", "A"): 1, ("source", "B"): 2, ("category", "FIGURE"): 2, ("category", "GOODS"): 1}
    assert [r.value for r in feed.categories_present(feed.facets(items)).collect()] == ["FIGURE", "GOODS"]
    assert [r.value for r in feed.work_menu(feed.facets(items)).collect()] == ["Re:제로부터", "ONE PIECE"]


def test_pick_items(spark):
    df = content(spark, NEWS, FIGURE_A, FIGURE_B)
    picked, missing = feed.pick_items(df, ["FIGURE:2", "FIGURE:0", "FIGURE:2", "FIGURE:9"])
    assert [r.content_id for r in picked.orderBy("pos").collect()] == ["FIGURE:2", "FIGURE:0"]
    assert [r.content_id for r in missing.collect()] == ["FIGURE:9"]
    import pytest

    for bad in ([], ["x"], [f"A:{i}" for i in range(21)], ["A:b/c"]):
        with pytest.raises(ValueError):
            feed.pick_items(df, bad)
