"""Language identification: n-gram counts and learning against plain loops, held-out accuracy, odd rows."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_lake.llm import language_id
from listing_lake.operators import store

SCHEMA = "content_id string, summary string, sourceLanguage string, title string, score string, others int"
WORDS = {
    "en": "the figure is on sale and ships with this new edition of that shop".split(),
    "de": "die figur ist im verkauf und wird mit dieser neuen auflage der händler größer".split(),
    "ko": "피규어 예약 안내 상품 출시 가격 한정판 매장 신작".split(),
}


def column(gram):
    """The hash of one n-gram, letter by letter."""
    rolled = 0
    for c in gram:
        rolled = (rolled * 0x01000193 + (ord(c) + 1) * 0x9E3779B1) % 2**32
    return (rolled ^ rolled >> 15) * 0x85EBCA6B % 2**32 >> 32 - language_id.LOG_COLUMNS


def plain_counts(value):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {value or ''} ")
    while "  " in letters:
        letters = letters.replace("  ", " ")
    out = collections.Counter()
    for n in language_id.ORDERS:
        for i in range(len(letters) - n + 1):
            if n > 1 or letters[i] != " ":
                out[column(letters[i:i + n])] += 1
    return out


def counted(texts):
    out = [collections.Counter() for _ in texts]
    for start, n, owner, columns, counts in language_id.count_grams(texts):
        assert not len(owner) or owner.max() < n
        for o, c, k in zip(owner, columns, counts):
            out[start + o][int(c)] += int(k)
    return out


def rows(n=240, seed=1):
    pick, out = random.Random(seed), []
    for i in range(n):
        language = pick.choice(list(WORDS))
        text = " ".join(pick.choice(WORDS[language]) for _ in range(pick.randrange(4, 40)))
        out.append((f"NEWS:{i}", text, language, "title", "old", 1))
    return out


@pytest.fixture(scope="module")
def content(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_counts_equal_plain_counts(monkeypatch):
    texts = ["", None, "a", "Figure!! figure 12 Größe İx", " \n ", "피규어 예약", "ab" * 500, "x.y" * 40, "𐐀𐐨 e"]
    assert counted(texts) == [plain_counts(t) for t in texts]
    # Groups of texts and long texts read by windows count alike.
    long_text = " ".join(WORDS["de"] * 50)
    monkeypatch.setattr(language_id, "WINDOW", 100)
    assert counted(texts + [long_text]) == [plain_counts(t) for t in texts + [long_text]]


def test_document_frequencies_cover_all_rows(spark, content):
    want = collections.Counter()
    for row in rows():
        want.update(plain_counts(row[1]).keys())
    got = language_id.document_frequencies(content)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want


def test_leader_equals_a_plain_loop():
    pick = random.Random(4)
    leader = language_id.Ftrl(3, 0.5, 1.0, 0.05, 0.1)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k, c):
        l1, l2 = (0.0, 0.0) if c == language_id.COLUMNS else (0.05, 0.1)
        if abs(z[k, c]) <= l1:
            return 0.0
        return -(z[k, c] - math.copysign(l1, z[k, c])) / ((1.0 + math.sqrt(n[k, c])) / 0.5 + l2)

    for _ in range(60):
        truth, columns = pick.randrange(3), sorted(pick.sample(range(12), 4))
        values = [pick.random() for _ in columns]
        leader.learn(truth, np.array(columns), np.array(values))
        terms = list(zip([*columns, language_id.COLUMNS], [*values, 1.0]))
        logit = [sum(weight(k, c) * v for c, v in terms) for k in range(3)]
        total = sum(math.exp(v) for v in logit)
        before = {(k, c): weight(k, c) for k in range(3) for c, _ in terms}
        for k in range(3):
            for c, v in terms:
                g = (math.exp(logit[k]) / total - (k == truth)) * v
                z[k, c] += g - (math.sqrt(n[k, c] + g * g) - math.sqrt(n[k, c])) / 0.5 * before[k, c]
                n[k, c] += g * g
    got = leader.weights(np.array([*range(12), language_id.COLUMNS]))
    want = [[weight(k, c) for c in [*range(12), language_id.COLUMNS]] for k in range(3)]
    assert np.allclose(got, want) and (got[:, :12] == 0).any()


def test_temperature_is_the_best_of_a_grid():
    pick = np.random.default_rng(2)
    truth = pick.integers(0, 3, 200)
    logits = pick.normal(size=(200, 3)) * 6
    logits[np.arange(200), truth] += 5
    best = language_id.best_temperature(logits, truth)

    def loss(t):
        target = np.full(logits.shape, 1 / 203)
        target[np.arange(200), truth] = 201 / 203
        return -(target * np.log(language_id.softmax(logits / t))).sum()

    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(-2.9, 2.9, 400))) + 1e-6
    assert language_id.best_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_held_out_rows_are_recognised(spark, content):
    model = language_id.fit(content.where(F.crc32(F.col("content_id").cast("binary")) % 3 != 1), most=60)
    assert model.languages == ["de", "en", "ko"] and (model.weights == 0).mean() > 0.9
    got = language_id.predict(content, model).where(F.crc32(F.col("content_id").cast("binary")) % 3 == 1).collect()
    assert len(got) > 40 and all(r.lang_pred == r.sourceLanguage and 1 / 3 < r.score <= 1 and r.title == "title" for r in got)
    again = language_id.fit(content.where(F.crc32(F.col("content_id").cast("binary")) % 3 != 1).repartition(7), most=60)
    assert (again.weights == model.weights).all() and again.temperature == model.temperature


def test_odd_rows(spark, content):
    model = language_id.fit(content, most=40, passes=1)
    odd = [(None, None, None, "t", None, 1), ("a", "", "ko", None, None, None), ("b", "12 !?", "en", None, None, None), ("c", "예약 " * 50_000, None, None, None, None),
           ("c", "예약 안내", None, None, None, None), ("c", "예약 안내", None, None, None, None)]
    frame = spark.createDataFrame(odd, SCHEMA)
    got = language_id.predict(frame, model)
    assert got.columns == ["content_id", "summary", "sourceLanguage", "title", "others", "lang_pred", "score"]
    found = sorted(((r.content_id or "", len(r.summary), r.lang_pred, r.score) for r in got.collect()))
    assert [f[:3] for f in found] == [("", 0, "und"), ("a", 0, "und"), ("b", 5, "und"), ("c", 5, "ko"), ("c", 5, "ko"), ("c", 150_000, "ko")]
    assert found[3] == found[4] and [f[3] for f in found[:3]] == [0, 0, 0]
    empty = language_id.fit(spark.createDataFrame([], store.CONTENT_DDL))
    assert {(r.lang_pred, r.score) for r in language_id.predict(frame, empty).collect()} == {("und", 0.0)}
    alone = language_id.fit(frame.withColumn("sourceLanguage", F.lit("ko")))
    assert {(r.lang_pred, r.score) for r in language_id.predict(frame.where("content_id = 'c'"), alone).collect()} == {("ko", 1.0)}
    assert language_id.predict(spark.createDataFrame([], store.CONTENT_DDL), model).count() == 0


def test_too_many_languages_are_refused(spark, monkeypatch, content):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language_id.fit(content)
