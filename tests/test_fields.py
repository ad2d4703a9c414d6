from datetime import datetime, timezone

from pyspark.sql import functions as F

from listing_lake.functions import fields
from listing_lake.functions.text import fold_search, fold_title, needs_translation, utf8_limit

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
T = F.col("t")


def one(values, expr, *texts):
    return values([(t,) for t in texts], "t string", expr)


def test_prices(values):
    assert one(values, fields.krw_price(T), "판매가 12,000원", "900원", "3,000원", "1,2345,000원", "109,100\n원", None) == [
        12000, None, 3000, None, 109100, None]
    assert one(values, fields.plausible_price(T), "3,000원 62,000원", "3,000원", "62,000 원") == [62000, 3000, None]


def test_pattern_price(values):
    text = "소비자가 : 82,000원 판매가 : 62,000원 발매 : 27년 06월"
    rows = [(text, None), (text, r"(?U)판매가\s*:\s*([\d,]+)\s*원"), (text, r"(?U)정가\s*([\d,]+)원")]
    assert values(rows, "t string, p string", fields.source_price(T, F.col("p"))) == [82000, 62000, None]


def test_sale_status(values):
    assert one(values, fields.sale_status(T), "예약 진행", "예약 품절", "판매", "pre-order now") == [
        "PREORDER", "SOLD_OUT", "IN_STOCK", "PREORDER"]
    extra = fields.sale_status(T, F.array(F.lit("발매 :")))
    assert one(values, extra, "발매 : 27년", "발매 : 27년 품절") == ["PREORDER", "SOLD_OUT"]


def test_dates(values):
    assert one(values, fields.parse_date(T), "26년 3월 15일", "2026.3.5", "2026-13-01 2026-01-02", "1999-01-01", "없음") == [
        "2026-03-15", "2026-03-05", None, None, None]
    text = "2025-01-01 " + "x" * 40 + " 예약 마감 26년 3월 15일까지"
    assert one(values, fields.deadline_near_keyword(T), text, "마감 26년 13월 1일 " + "x" * 40 + " 종료 2026-02-03", "2026-01-01") == [
        "2026-03-15", "2026-02-03", None]
    assert one(values, fields.labelled_deadline(T), "예약마감일 : 26년 3월 5일", "마감일 26년 3월 5일") == ["2026-03-05", None]
    assert one(values, fields.release_window(T), "[3월 입고] 이름", "이름 [3월 입고]") == ["3월 입고", ""]


def test_relative_day(values):
    texts = ["방금", "방금 전", "어제", "3시간 전", "2주 전", "1개월 전", "1년전", "내일"]
    assert one(values, fields.relative_day(T, NOW), *texts) == [
        "2026-01-01", "2026-01-01", "2025-12-31", "2025-12-31", "2025-12-18", "2025-12-02", "2025-01-01", None]


def test_published_value(values):
    pattern = F.lit(fields.spark_pattern("%Y/%m/%d"))
    got = one(values, fields.published_value(T, pattern, NOW), "2026/1/5", "어제", "언젠가", None)
    assert [tuple(g) for g in got] == [
        ("2026-01-05", None), ("2025-12-31", None), (None, "게시일 형식 오류: 언젠가"), (None, None)]


def test_published_at(values):
    utc = lambda *a: datetime(*a)
    cases = {
        "Mon, 05 Jan 2026 10:00:00 +0900": utc(2026, 1, 5, 1), "5 Jan 2026 10:00 GMT": utc(2026, 1, 5, 10),
        "Mon, 05 Jan 26 10:00:00 EST": utc(2026, 1, 5, 15), "2026-01-05": utc(2026, 1, 5),
        "2026-01-05T10:00:00+09:00": utc(2026, 1, 5, 1), "2026-01-05 10:00:00.5": utc(2026, 1, 5, 10, 0, 0, 500000),
        "20260105": utc(2026, 1, 5), "2026-01-05T10:00Z": utc(2026, 1, 5, 10), "2026-01-05T10:00:00+0900": utc(2026, 1, 5, 1),
        "2026-1-5": None, "soon": None, "": None, "2026-02-31": None,
    }
    got = one(values, F.date_format(fields.published_at(T), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), *cases)
    assert got == [v.strftime("%Y-%m-%dT%H:%M:%S.%f") if v else None for v in cases.values()]


def test_leading_date(values):
    got = one(values, fields.split_leading_date(T), "2026.1.5 10:30 제목 하나", "제목", "2026.1.5", None)
    assert [tuple(g) for g in got] == [("2026.1.5 10:30", "제목 하나"), ("", "제목"), ("", "2026.1.5"), ("", "")]


def test_iso_text(values):
    rows = [(datetime(2026, 1, 5, 1, 2, 3),), (datetime(2026, 1, 5, 1, 2, 3, 40),), (None,)]
    assert values(rows, "t timestamp", fields.iso_text(T)) == [
        "2026-01-05T01:02:03+00:00", "2026-01-05T01:02:03.000040+00:00", ""]


def test_fold(values):
    texts = ["붕괴:스타레일", "Ｒｅ：제로", "Straße  Nord", "ﾜﾝﾋﾟｰｽ", "ÉLAN ", "①　番", None, "İx"]
    import unicodedata

    fold = lambda v, f: None if v is None else " ".join(f(unicodedata.normalize("NFKC", v)).replace(":", " ").split())
    assert one(values, fold_title(T), *texts) == [fold(v, str.casefold) for v in texts]
    assert one(values, fold_search(T), *texts) == [fold(v, str.lower) for v in texts]


def test_translation_need(values):
    assert one(values, needs_translation(T), "ワンピース", "원피스 피규어", "One 피규어", "123", "", None) == [
        True, False, False, False, False, False]


def test_utf8_limit(values):
    texts = ["가" * 200, "a" * 499 + "é", "ab", "가" * 166 + " x", "é" * 249 + "a "]
    want = [(t.encode()[:500].decode(errors="ignore").rstrip() if len(t.encode()) > 500 else t) for t in texts]
    assert one(values, utf8_limit(T), *texts) == want


def test_product_struct(values):
    text = "소비자가 : 82,000원 판매가 : 62,000원 발매 : 27년 06월"
    none = F.lit(None).cast("string")
    words = F.array().cast("array<string>")
    got = one(values, fields.text_product(T, none, words, none, F.lit("가게"), NOW), text, "900원")
    assert (got[0].price, got[0].saleStatus, got[0].shop, got[0].currency) == (82000, "IN_STOCK", "가게", "KRW")
    assert got[1] is None
