"""Collocations of a small content table, against plain counting, also where fingerprints collide."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listing_lake.llm import collocations
from listing_lake.operators import store

SCHEMA = "content_id string, summary string, sourceLanguage string, lang string, n long, text_a string"


def plain_counts(rows, longest=5):
    """Occurrences of all phrases and of all words, per language."""
    counts, totals = collections.Counter(), collections.Counter()
    for value, language in rows:
        language = "und" if language is None else language
        low = re.sub("[A-Z]", lambda m: m.group().lower(), value or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[language] += len(words)
            for size in range(1, longest + 1):
                counts.update((language, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    return counts, totals


def plain_phrases(rows, min_count, longest=5, share=100, top=2000):
    counts, totals = plain_counts(rows, longest)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (language, words), a in candidates.items():
        if any(g == language and len(longer) > len(words) and 100 * b >= share * a and any(
                longer[i:i + len(words)] == words for i in range(len(longer) - len(words) + 1)) for (g, longer), b in candidates.items()):
            continue
        cuts = [(1000 * a * totals[language] // (counts[language, words[:k]] * counts[language, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((language, " ".join(words), a, counts[language, words[:k]], counts[language, words[k:]], totals[language], score))
    ranked = []
    for language in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == language), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(mine[:top])]
    return sorted(ranked)


def texts(seed=3, n=120):
    pick = random.Random(seed)
    words = ["figure", "scale", "preorder", "shop", "피규어", "예약", "Limited", "edition", "x" * 300, "a", "é"]
    out = []
    for i in range(n):
        parts = [pick.choice(words) + pick.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n", " \x0b"]) for _ in range(pick.randrange(40))]
        out.append(("".join(parts) + pick.choice(["", "limited EDITION figure of the year", "new new new new"]), pick.choice(["ja", "ko", None, "und", ""])))
    hot = ("Shop notice: limited edition figure, preorder now at the shop", "ja")
    long_text = ("one two  three four five six. " * 4000, "ko")
    return out + [hot] * (n // 2) + [(None, "ja"), ("", None), (" \t\n", "ko"), ("...", "en"), ("word", "en"), long_text]


def frame(spark, rows):
    return spark.createDataFrame([(str(i % 50), t, g, "clash", 1, "clash") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("passes", [{}, {"hash_bits": 5, "window": 300, "filter_bits": 8}, {"hash_bits": 11}], ids=["usual", "all collide", "some collide"])
def test_phrases_equal_plain_counting(spark, passes):
    rows = texts(n=400)
    want = plain_phrases(rows, 8, top=30)
    assert len(want) > 60 and len({w[0] for w in want}) == 4
    assert found(collocations.mine_phrases(frame(spark, rows), min_count=8, top=30, **passes)) == want


def test_shorter_phrases_and_partial_cover(spark):
    rows = texts(5, 60)
    got = found(collocations.mine_phrases(frame(spark, rows), min_count=5, longest=3, share=60))
    assert got == plain_phrases(rows, 5, 3, 60)


def test_frequent_phrases_are_exact(spark):
    rows = texts(8, 50)
    counts, totals = plain_counts(rows)
    table = frame(spark, rows)
    phrases, sums = collocations.frequent_phrases(table, min_count=10)
    found = phrases.collect()
    key = F.shiftrightunsigned(F.xxhash64("content_id", F.coalesce("summary", F.lit(""))), 32)
    pointed = {r.key: r.summary for r in table.select("summary", key.alias("key")).collect()}
    assert all((r.lang, tuple(r.phrase.split(" "))) in plain_counts([(pointed[r.seen_in], r.lang)])[0] for r in found)
    assert {(r.lang, r.phrase): (r.n_words, r.n) for r in found} == {
        (g, " ".join(w)): (len(w), n) for (g, w), n in counts.items() if n >= 10}
    assert {r.lang: r.total for r in sums.collect()} == {g: n for g, n in totals.items() if n}


def test_nothing_gives_nothing(spark):
    assert collocations.mine_phrases(spark.createDataFrame([], store.CONTENT_DDL)).count() == 0
    assert collocations.mine_phrases(frame(spark, [(None, None), ("", "ja")])).count() == 0


def test_windows_cut_between_pieces_only():
    values = pa.array(["ab cd. ef", None, "", "gh ij kl mn", "op"])
    whole = b"ab cd. ef\n\n\ngh ij kl mn\nop\n"
    for limit in (1, 5, 13, 1000):
        parts = list(collocations._windows(values.slice(0), limit))
        assert b"".join(p.tobytes() for p, _, _ in parts) == whole
        assert [at for _, at, _ in parts] == [sum(len(p) for p, _, _ in parts[:i]) for i in range(len(parts))]
        assert all(p.tobytes()[-1:] in b".\n" for p, _, _ in parts)
    assert b"".join(p.tobytes() for p, _, _ in collocations._windows(values.slice(3), 5)) == b"gh ij kl mn\nop\n"


def test_task_adds_up_equal_words_only():
    tally = collocations.Tally(2)
    runs = np.array([[0, 1], [0, 1], [0, 2], [0, 1]], np.int32)
    tally.add(np.zeros(4, np.int64), np.array([0, 0, 0, 1], np.int32), runs, np.ones(4, np.int64), np.arange(4))
    tally.add(np.zeros(1, np.int64), np.zeros(1, np.int32), runs[:1], np.array([5]), np.array([9]))
    batches = list(tally.take([b"a", b"b", b"c"], ["ja", "ko"], rows=2))
    assert len(batches) == 2 and sorted(t for b in batches for t in zip(*[b.column(c).to_pylist() for c in ("lang", "phrase", "n_words", "n")])) == [
        ("ja", "a b", 2, 7), ("ja", "a c", 2, 1), ("ko", "a b", 2, 1)]
    assert not list(tally.take([], []))


def test_slices_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"shop figure. a shop figure\n", np.uint8)
    words = collocations.Words(data, np.zeros(1, np.uint64), lambda at: np.zeros(len(at), np.int64), 64)
    pairs, ids = words.fingerprints(2, np.flatnonzero(words.whole(2))), words.exact_ids({}).tolist()
    assert pairs[0] == pairs[2] != pairs[1] and [ids[i] for i in (0, 1)] == [ids[3], ids[4]] and len(set(ids)) == 3
