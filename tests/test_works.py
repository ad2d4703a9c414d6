from pyspark.sql import functions as F

from listing_lake.operators import works as W
from listing_lake.sources.dims import works_table

WORKS = [
    {"name": "Re:제로부터 시작하는 이세계 생활", "aliases": ["Re:제로", "리제로"]},
    {"name": "ONE PIECE", "aliases": ["원피스"]},
    {"name": "사이버펑크 엣지러너", "aliases": ["Cyberpunk Edgerunners"]},
    {"name": "사이버펑크 엣지러너", "aliases": "사이버펑크, X"},
    {"name": "BLEACH"},
    {"name": ".hack//SIGN", "aliases": ["<>", "? !"]},
    {"name": "Pokémon", "aliases": ["Ｐ５"]},
    {"name": "!!"},
]
REZERO, CYBER = WORKS[0]["name"], "사이버펑크 엣지러너"
TITLES = [
    ("Re: 제로 렘 피규어", None, [REZERO]), ("ワンピース フィギュア", "원피스 루피 피규어", ["ONE PIECE"]),
    ("ONE PIECES set", None, []), ("ONE PIECE 루피", None, ["ONE PIECE"]), ("사이버펑크 루시 X", None, [CYBER]),
    ("루시 X", None, []), ("원피스 × 리제로 콜라보", None, [REZERO, "ONE PIECE"]), ("Bleach넨도로이드", None, ["BLEACH"]),
    ("[예약]BLEACHフィギュア", None, ["BLEACH"]), ("Bleached hair", None, []), ("sonebleach", None, []), ("BLEACH2", None, []),
    ("the .hack//sign box", None, [".hack//SIGN"]), ("a.hack//sign", None, []), ("x.hack//signs", None, []), ("a <> b", None, [".hack//SIGN"]),
    ("a? !b", None, []), ("에? !", None, [".hack//SIGN"]), ("pokémons", None, ["Pokémon"]), ("p5", None, ["Pokémon"]), ("wow!!", None, []),
    ("와!!", None, ["!!"]), ("ＯＮＥ　ＰＩＥＣＥ", None, ["ONE PIECE"]), ("", None, []), (None, None, []),
]


def test_titles(spark):
    keywords = W.work_keywords(works_table(spark, WORKS))
    items = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(TITLES)], "content_id int, title string, titleKo string")
    got = {r.content_id: r.works for r in W.with_works(items, keywords).collect()}
    assert [got[i] for i in range(len(TITLES))] == [w for _, _, w in TITLES]
    texts = items.select("content_id", W.fold_title(F.concat_ws(" ", "title", "titleKo")).alias("t"))
    alone = {r.content_id: r.works for r in W.match_works(texts, keywords, "content_id", "t").collect()}
    assert alone == {i: w for i, w in got.items() if w}


def test_seeds_agree_with_brute_force(spark):
    """Every keyword against every text, the plain way."""
    import re
    import unicodedata

    fold = lambda v: " ".join(unicodedata.normalize("NFKC", v).casefold().replace(":", " ").split())
    texts = [t for t, _, _ in TITLES if t] + [f"{a}{s}{b}" for a in ("x", "가", "", "é") for b in ("y", "나", "", "1")
                                            for s in ("one piece", "p5", "pokémon", ".hack//sign", "x", "<>", "リゼロ")]
    works = [{"name": w} for w in ("one piece", "p5", "pokémon", ".hack//sign", "<>", "リゼロ", "é1", "x", "y1")]
    keywords = W.work_keywords(works_table(spark, works))
    items = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", W.fold_title(F.col("t")).alias("t"))
    got = {(r.id, r.work) for r in W.match_pairs(items, keywords, "id", "t").collect()}
    want = set()
    for i, t in enumerate(texts):
        for w in works:
            k = fold(w["name"])
            pattern = re.escape(k) if not k.isascii() else rf"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])"
            if len(k) >= 2 and re.search(pattern, fold(t)):
                want.add((i, w["name"]))
    assert got == want


def test_rarest_seed_and_hot_parts(spark, monkeypatch):
    titles = [f"limited figure {i}" for i in range(40)] + ["limited figure alpha", "한정판 figure alpha", "한정 판 beta", "게임 한정판"]
    items = spark.createDataFrame(list(enumerate(titles)), "id int, t string").repartition(3)
    works = [{"name": n} for n in ("figure alpha", "Figure", "limited", "figure gamma", "한정판", "게임 한정판", "beta")]
    keywords = W.work_keywords(works_table(spark, works))
    monkeypatch.setattr(W, "HOT_SHARE", 20)
    seeded = {r.norm: (r.seed, r.parts) for r in W.rarest_seeds(keywords, items, "t").collect()}
    assert seeded["figure alpha"][0] == "w:alpha" and seeded["게임 한정판"][0] in ("p:게임", "p:임 ", "p: 한") and "figure gamma" not in seeded
    assert seeded["beta"][1] == 1 and seeded["figure"][1] > 5 and seeded["limited"][1] > 5
    got = {(r.id, r.work) for r in W.match_pairs(items, keywords, "id", "t").collect()}
    want = {(i, n) for i, t in enumerate(titles) for n in ("Figure", "limited") if n.lower() in t.split()}
    assert got == want | {(40, "figure alpha"), (41, "figure alpha"), (41, "한정판"), (43, "한정판"), (43, "게임 한정판"), (42, "beta")}
    assert W.match_pairs(items.filter("false"), keywords, "id", "t").count() == 0 and W.match_pairs(items, keywords.filter("false"), "id", "t").count() == 0


def test_only_seeds_of_the_dictionary_leave_their_task(spark, monkeypatch):
    """What matching writes grows with the hits, not with the words of the texts; an id may repeat, also with a text that is null."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(200)) + (" blue moon!" if i % 5 == 0 else " bluemoon")) for i in range(20)]
    items = spark.createDataFrame(rows + [(5, None), (None, "blue moon")], "id int, t string")
    written, keep = [], W.materialize

    def recorded(df, name="step"):
        table = keep(df, name)
        written.append(table.count())
        return table

    monkeypatch.setattr(W, "materialize", recorded)
    keywords = W.work_keywords(works_table(spark, [{"name": "Blue Moon", "aliases": ["moon!"]}]))
    got = sorted((r.id, r.work) for r in W.match_pairs(items, keywords, "id", "t").collect())
    assert got == [(i, "Blue Moon") for i in (0, 5, 10, 15)] and sum(written) < 40


def test_visible_aliases_and_coverage(spark):
    works = works_table(spark, WORKS)
    keywords = W.work_keywords(works)
    items = spark.createDataFrame([("A:1", "사이버펑크 루시"), ("A:2", "기타")], "content_id string, title string")
    matched = W.with_works(items, keywords)
    seen = W.visible_aliases(matched, works).collect()
    assert [(r.name, r.aliases) for r in seen] == [(CYBER, [CYBER, "Cyberpunk Edgerunners", "사이버펑크", "X"])]
    assert W.coverage(matched).first().asDict() == {"total": 2, "unclassified": 1}
    assert [r.content_id for r in W.unmatched(matched).collect()] == ["A:2"]


def test_alias_must_be_text(spark):
    import pytest

    with pytest.raises(ValueError):
        works_table(spark, [{"name": "a", "aliases": [{"b": "c"}]}])
