"""The training-data operators on small content tables, against plain Python versions and round trips."""

import base64
import collections
import hashlib
import os
import pathlib
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from listing_lake.llm import byte_bpe, components, fingerprints, line_dedup, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, sharding, warc, word_coding
from listing_lake.session import materialize

SCHEMA = "content_id long, summary string, title string, others string, words string, shard int, failed string"
LONG = " ".join(f"word{i % 977} figure{i}" for i in range(20_000))
TEXTS = [
    None, "", " \n\t ", "preorder", "새 피규어 예약 안내", LONG, "The shop opens preorders today for the new figure of the series, ships in spring.",
    "The shop opens preorders today for the new figure of the series, ships in spring.",
    "Shared notice line of the shop, please read.\nFigure A arrives.", "shared notice line of the shop, please read. \nFigure B arrives.",
    "Shared notice line of the shop, please read.\nFigure C arrives.\n", "SALE!! NOW!! " * 30, "price $$$ *** ### " * 40,
]


def rows(spark, texts=TEXTS):
    data = [(i, t, "title", "x", "y", 3, "z") for i, t in enumerate(texts)]
    data += [data[-1], (None, texts[-1], None, None, None, None, None), (7, "another text under an id that repeats", None, None, None, None, None)] if texts else []
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def content(spark):
    return rows(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return rows(spark, [])


def words_of(value):
    out, word = [], ""
    for c in value or "":
        if c in " \t\n\x0b\f\r":
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def lowered(value):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in value or "")


def test_permutation_is_one_and_inverts():
    for total in (1, 2, 3, 10, 97, 1000):
        places = sharding.permute(np.arange(total), total, seed=5)
        assert sorted(places) == list(range(total))
        assert (sharding.permute(places, total, seed=5, back=True) == np.arange(total)).all()
        assert sharding.row_at(*sharding.locate(total - 1, total, 4, 5), total, 4, 5) == total - 1


def test_shards_are_even_and_gapless(content, empty):
    got = sharding.shard_content(content, shards=4).collect()
    assert len(got) == content.count()
    slots = collections.defaultdict(list)
    for row in got:
        slots[row.shard].append(row.slot)
        assert (row.shard, row.slot) == sharding.locate(row.row_number, len(got), 4)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.text_crc32 for r in got if r.size == 1} == {0}
    assert sharding.shard_content(empty).count() == 0


def test_ledger_matches_plain_python(content, empty):
    ledger = quality_rules.rule_ledger(content)
    assert "others" in ledger.columns and ledger.columns.count("failed") == 1
    for row in ledger.collect():
        words = words_of(row.summary)
        windows = collections.defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i:i + 5])].append(i)
        covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in (row.summary or "").split("\n") if words_of(x)]
        assert (row.n_words, row.n_repeat_words, row.n_dup_lines) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert bool(row.failed & 1) == (len(words) < 10)
    assert quality_rules.rule_ledger(empty).count() == 0


def test_policies_and_ablations(content):
    ledger = quality_rules.apply_policies(quality_rules.rule_ledger(content))
    failed = [r.failed for r in ledger.collect()]
    mask = quality_rules.mask_of(quality_rules.POLICIES[3])
    assert ledger.where("kept_v3").count() == sum(f & mask == 0 for f in failed)
    for row in quality_rules.ablations(ledger).where("version = 3").collect():
        bit = quality_rules.mask_of([row.rule])
        assert (row.n_failed, row.n_only, row.n_kept) == (sum(f & bit != 0 for f in failed), sum(f & mask == bit for f in failed), sum(f & mask == 0 for f in failed))
    assert {r.n_kept for r in quality_rules.ablations(ledger.limit(0)).collect()} == {0}


def test_discriminant_separates_held_out_texts(spark, content, empty):
    clean = [(i, f"The series figure number {i} ships in spring, and orders close in {i % 28} days.", 1) for i in range(60)]
    junk = [(i + 100, f"$$$ ### {i} *** ||| " * (3 + i % 7), 0) for i in range(60)]
    data = spark.createDataFrame(clean + junk, "content_id long, summary string, quality int")
    statistics = quality_classifier.text_statistics(data)
    model = quality_classifier.fit(statistics, data.where("content_id % 3 <> 0").select("content_id", "quality"))
    scored = quality_classifier.score_quality(statistics, model).where("content_id % 3 = 0").collect()
    assert all((r.quality_score >= 0.3) == (r.quality == 1) for r in scored)
    every = quality_classifier.score_quality(quality_classifier.text_statistics(content), model)
    assert all(0 <= r.quality_score <= 1 for r in every.collect()) and every.count() == content.count()
    assert quality_classifier.score_quality(quality_classifier.text_statistics(empty), model).count() == 0
    even = quality_classifier.fit(statistics, data.limit(0).select("content_id", "quality"))
    assert {r.quality_score for r in quality_classifier.score_quality(statistics, even).collect()} == {0.5}


def test_byte_bpe_equals_the_rank_encoder(content, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_content(content, path, public_tokenizers.PATTERN).collect()
    assert len(got) == content.count()
    for row in got:
        ids = plain.encode_ordinary(row.summary or "")
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == ids and bytes(row.decoded).decode() == (row.summary or "") and row.n_tokens == len(ids)
    coder = byte_bpe.ByteBpe(path, public_tokenizers.PATTERN)
    for odd in ("\x00\x1c\x85　 á ", "  \n\n  x", "𝟘½ⅷ٣ '", "don't 'll ", "a" * 3000, "<|endoftext|>"):
        ids = coder.encode(odd)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(odd) and coder.decode(ids).decode() == odd
    assert byte_bpe.encode_content(empty, path, public_tokenizers.PATTERN).count() == 0


def test_scores_match_counts_and_are_probabilities(spark, content, empty):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    learn = F.col("content_id") % 3 != 2
    got = lm_scoring.score_content(content, learn, vocabulary, rounds=1, share=1).collect()
    texts = content.select("content_id", "summary", F.coalesce(learn, F.lit(False)).alias("learnt")).collect()
    tokens = [words_of(lowered(r.summary)) + ["\n"] for r in texts]
    counts = collections.Counter(w for r, ws in zip(texts, tokens) if r.learnt for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((len(ws), sum(counts[w] > 0 for w in ws), round(sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 4)) for ws in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score_content(empty, learn, vocabulary).count() == 0


def test_model_is_a_distribution_and_causal(spark, content):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    counts = lm_scoring.word_counts(content.select("summary").where("summary is not null"))
    ids, size, _ = lm_scoring._encoder(vocabulary)
    model = lm_scoring._count_model(lm_scoring._pairs(counts, vocabulary), lm_scoring._prefixes(counts, vocabulary), vocabulary)
    model.p["out"] += np.random.default_rng(1).standard_normal(model.p["out"].shape).astype(np.float32)
    word = np.frombuffer(ids.coder.pieces(["preorders"])[0], np.uint16)
    # After ids of no known word, inside a word and at its end.
    for tail in ([], word[:1], word):
        prefix = np.append(np.arange(40) % 30 + 300, tail).astype(np.int64)
        width = len(prefix) + 1
        scores = model.score(np.concatenate([np.append(prefix, x) for x in range(size)]), np.arange(size + 1) * width).reshape(size, width)
        assert abs(np.exp(scores[:, -1]).sum() - 1) < 1e-3
        assert np.allclose(scores[:, :-1], scores[0, :-1], atol=1e-4)


def test_attention_keeps_its_classes_and_rounds():
    import inspect

    assert lm_scoring.Attention.start(9)["out"].shape == (lm_scoring.WIDTH, 512)
    assert inspect.signature(lm_scoring.score_content).parameters["rounds"].default == 3


@pytest.mark.parametrize("parts", [{}, {"share": 3}])
def test_every_round_trains_on_every_learnable_row(spark, monkeypatch, parts):
    many = spark.range(60, numPartitions=4).select(F.col("id").alias("content_id"), F.repeat(F.lit("an order opens today "), 5_100).alias("summary"))
    seen = collections.Counter()

    def noted(content, model, parameters, vocabulary):
        seen.update(r.content_id for r in content.select("content_id").collect())
        return parameters

    monkeypatch.setattr(lm_scoring, "_train_round", noted)
    lm_scoring.score_content(many, F.col("content_id") % 3 != 2, public_tokenizers.path("byte_bpe_50k.json"), **parts)
    assert seen == {i: 3 for i in range(60) if i % 3 != 2}


def test_beginnings_that_tasks_lack_are_joined_to_the_rows(content, monkeypatch):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    def scores():
        got = lm_scoring.score_content(content, F.col("content_id") % 3 != 2, vocabulary, rounds=0).collect()
        return sorted((r.content_id or -1, r.n_tokens, r.base_score, r.score) for r in got)
    want = scores()
    for most in (0, 40):
        monkeypatch.setattr(lm_scoring, "PREFIXES", most)
        assert np.allclose(scores(), want, atol=1e-4, rtol=1e-5)


def test_rows_get_their_beginnings_in_turns_and_steps_go_when_done(spark, content, monkeypatch):
    from listing_lake.session import shared_dir

    written, present, write, folder = [], [], lm_scoring.materialize, pathlib.Path(shared_dir(spark))

    def noted(df, name):
        step = write(df, name)
        written.append((name, step.count(), dict(step.dtypes).get("beyond")))
        present.append({*folder.iterdir()} - before)
        return step

    monkeypatch.setattr(lm_scoring, "materialize", noted)
    monkeypatch.setattr(lm_scoring, "PREFIXES", 0)
    before = {*folder.iterdir()}
    many = content.union(content).repartition(1)
    assert lm_scoring.score_content(many, F.col("content_id") % 3 != 2, public_tokenizers.path("byte_bpe_50k.json"), rounds=0).count() == 32
    turns = [n for name, n, _ in written if name == "rows"]
    assert turns == [32 // lm_scoring.TURNS] * lm_scoring.TURNS and {kind for name, _, kind in written if name == "rows"} == {"array<binary>"}
    assert sorted(p.name.split("-")[0] for p in {*folder.iterdir()} - before) == ["scored"] * lm_scoring.TURNS + ["words"]
    # The rows of one turn at a time.
    assert max(sum(p.name.startswith("rows-") for p in step) for step in present) == 1


def test_beginnings_are_found_some_texts_at_a_time(monkeypatch):
    draw = np.random.default_rng(1)
    lengths = np.append(draw.integers(0, 300, 60), [0, 0])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids, opens = draw.integers(0, 50, starts[-1]), np.arange(50) % 5 == 0
    first = opens[ids]
    first[starts[:-1][lengths > 0]] = True
    hashes, walked, walk = lm_scoring._walk(ids, first)[0], [], lm_scoring._walk
    known = np.unique(hashes)[::3]
    none = np.zeros(len(known), np.int64)
    spelling = lm_scoring.Spelling(opens, np.full(50, 0.02), 0.5, [known, none + 1, none.astype(np.float32), none, none[:0], none[:0].astype(np.float32)])
    monkeypatch.setattr(lm_scoring, "_walk", lambda ids, opens: walked.append(len(ids)) or walk(ids, opens))
    monkeypatch.setattr(lm_scoring, "WALKED", 500)
    row, got, found, _ = spelling._found(ids, starts)
    assert (got == hashes).all() and (found == np.isin(hashes, known)).all() and (known[row[found]] == hashes[found]).all() and (row[~found] == len(known)).all()
    assert sum(walked) == len(ids) and max(walked) < 500 + 300
    of_text = np.repeat(np.arange(len(lengths)), lengths)
    assert list(zip(*[x.tolist() for x in spelling.unknown(ids, starts)])) == sorted({*zip(of_text[~found].tolist(), hashes.view(np.int64)[~found].tolist())})


def test_states_in_few_bytes_hold_all_counts(spark):
    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 31, 1 << 40, (1 << 62) + 3], np.int64)
    data, sizes = lm_scoring._packed(numbers)
    got, ends = lm_scoring._unpacked(data)
    assert got.tolist() == numbers.tolist() and ends.tolist() == np.cumsum(sizes).tolist() and sizes[:3].tolist() == [1, 1, 1]

    # Beginnings 1 to 8: 1 goes on to 2, 3 and 4 (ids 2 and 3 in one class), 2 to 5; the others end.
    counts = {1: (0, 1, 6_000_000_000, 100), 2: (1, 2, 5_000_000_000, 7), 3: (1, 3, 2, 2), 4: (1, 4, 1, 1), 5: (2, 5, 300, 300), 6: (0, 6, 1, 1), 7: (0, 7, 2, 2), 8: (0, 8, 1, 1)}
    prefixes = spark.createDataFrame([(p, *row) for p, row in counts.items()], "prefix long, before long, id long, n long, ended long")
    discount, states = lm_scoring._discount(prefixes), lm_scoring._states(prefixes, np.array([0, 0, 300, 300, 5, 6, 7, 8, 9])).toArrow()
    assert discount == max(0.3, 3 / (3 + 2 * 2))
    hashes, n, ended, cells, classes, shares = lm_scoring._decoded(states["prefix"].to_numpy(), states["code"], discount)
    found = dict(zip(hashes.tolist(), zip(n.tolist(), ended.tolist(), np.split(classes, np.cumsum(cells)[:-1]), np.split(shares, np.cumsum(cells)[:-1]))))
    assert states["n"].to_pylist() == n.tolist() and states["cells"].to_pylist() == cells.tolist() and {*found} == {*counts}
    of_class = {1: {300: (5_000_000_002, 2), 5: (1, 1)}, 2: {6: (300, 1)}}
    for prefix, (_, _, whole, last) in counts.items():
        assert found[prefix][0] == whole and np.isclose(found[prefix][1], (last - discount) / whole)
        want = {c: (total - kids * discount) / whole for c, (total, kids) in of_class.get(prefix, {}).items()}
        assert np.allclose([want.pop(c) for c in found[prefix][2].tolist()], found[prefix][3]) and not want
    assert max(len(c) for p, c in zip(hashes.tolist(), states["code"].to_pylist()) if p in (3, 4, 6, 7, 8)) == 2


def test_word_beginnings_of_any_depth(spark):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    word = "".join(f"q{i * 7919 % 1009}z" for i in range(50))
    counts = spark.createDataFrame([(1, 3, word)], "word long, n long, token string")
    ids, _, _ = lm_scoring._encoder(vocabulary)
    got = lm_scoring._prefixes(counts, vocabulary).collect()
    assert len(got) == len(ids.coder.pieces([word])[0]) // 2 > 50 and {r.n for r in got} == {3} and sum(r.ended for r in got) == 3


def shingles(value):
    words = words_of(lowered(value))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates_against_all_pairs(spark, content, empty):
    base = [f"w{i * 7919 % 1009}" for i in range(120)]
    data = [(i, " ".join(base[:40 + i % 3] + [f"edit{i}"] + base[41:])) for i in range(40)]
    data += [(100 + i, " ".join(base[30:90] + [f"u{i}x{k}" for k in range(80)])) for i in range(20)]
    data += [(1000 + r.content_id, r.summary) for r in content.where("content_id < 7").collect()]
    frame = spark.createDataFrame(data, "content_id long, summary string")
    got = {r.content_id: r for r in ngram_join.near_duplicates(frame).collect()}
    sets = {i: shingles(t) for i, t in data}
    parent = {i: i for i in sets}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in sets}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    every = ngram_join.near_duplicates(content).collect()
    assert len(every) == content.count() and {r.component_id for r in every if r.content_id is None} == {None}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_prefixes_of_sets_with_few_low_tokens(spark):
    passage = [f"hot{k}" for k in range(14)]
    data = []
    for i in range(60):
        own = [f"own{i // 3}x{k}" for k in range(14)]
        data.append((i, " ".join(passage + own + [[], ["tail"], [f"tail{i}"]][i % 3])))
    frame = spark.createDataFrame(data, "content_id long, summary string")
    tokens = ngram_join._token_table(frame, 5, 80)
    classes = tokens.groupBy(F.col("set_hash").alias("node"), "n_shingles", "n_low").agg(F.min("content_id").alias("first_id"))
    filters = ngram_join._filters(tokens, classes, 80).join(classes.select("node", "n_low"), "node").collect()
    need = lambda r: ngram_join._prefix_size(r.n_shingles, 80)
    assert any(r.n_low < need(r) for r in filters)
    assert all(len(p) <= need(r) for r in filters for p in (r.prefix_0, r.prefix_1, r.prefix_2))
    sets = {i: shingles(t) for i, t in data}
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            group[a] = min(group[b] for b in sets if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert {r.content_id: r.component_id for r in ngram_join.near_duplicates(frame).collect()} == group


def test_fingerprints(spark, content, empty):
    lexicon = fingerprints.lexicon(content, 0.01, 0.5)
    got = fingerprints.fingerprint_content(content, lexicon).withColumn("same", fingerprints.likeness(F.col("codes"), F.col("codes"))).collect()
    assert len(got) == content.count() and all(len(r.codes) == 160 for r in got)
    by_id = {r.content_id: r.codes for r in got if r.content_id not in (7, None)}
    assert by_id[0] == by_id[1] == by_id[2] and {r.same for r in got} == {1.0}
    assert any(r.codes == by_id[6] for r in got if r.content_id == 7)
    assert fingerprints.fingerprint_content(empty, lexicon).count() == 0 and fingerprints.lexicon(empty).count() == 0
    unique = content.where("content_id is not null and content_id <> 7").dropDuplicates(["content_id"])
    texts = {r.content_id: r.summary or "" for r in unique.collect()}
    ids = sorted(texts, reverse=True)
    for row in fingerprints.splice_next(unique).collect():
        following = ids[(ids.index(row.content_id) + 1) % len(ids)]
        cut = len(texts[row.content_id]) // 3
        assert row.next_id == following and row.edited == texts[row.content_id][:len(texts[row.content_id]) - cut] + texts[following][:cut]


def test_spliced_rows_are_gathered_where_they_are(spark, content):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = fingerprints.fingerprint_columns(fingerprints.splice_next(content), fingerprints.lexicon(content), "summary", "edited")
        plan = coded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The texts and the heads to a content id; nothing once their terms are exploded.
    assert plan.count("Exchange hashpartitioning") == 2 and "hashpartitioning(row" not in plan and "hashpartitioning(key" not in plan


def test_fingerprints_of_copies_and_of_texts_without_band_terms(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in draw.choice(4000, 60, replace=False)) for _ in range(200)]
    copied = " ".join(f"w{k}" for k in draw.choice(4000, 90, replace=False))
    apart = [" ".join(f"only{i}x{k}" for k in range(90)) for i in range(4)]
    data = list(enumerate([*texts, *[copied] * 100, *apart]))
    draw.shuffle(data)
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "content_id long, summary string")
    terms = fingerprints.lexicon(frame)
    counts = collections.Counter(w for t in {t for _, t in data} for w in t.split())
    assert terms.count() == sum(2 <= n <= 0.05 * len({t for _, t in data}) for n in counts.values())
    coded = fingerprints.fingerprint_columns(fingerprints.splice_next(frame).withColumn("text", F.col("summary")), terms, "summary", "edited")
    near = collections.defaultdict(list)
    for r in coded.select("text", fingerprints.likeness(F.col("summary"), F.col("edited")).alias("near")).collect():
        near[r.text].append(r.near)
    assert len(near[copied]) == 100 and all(0.2 < x <= 1 for x in near[copied])
    assert all(0.2 < near[t][0] < 1 for t in apart)


def test_shared_lines(content, empty):
    got = line_dedup.drop_shared_lines(content)
    assert got.columns[-2:] == ["n_lines", "n_dropped"] and "others" in got.columns
    lines = {r.content_id: (r.n_lines, r.n_dropped, r.summary) for r in got.where("content_id in (0, 8, 9, 10)").collect()}
    assert lines == {0: (1, 0, ""), 8: (2, 1, "Figure A arrives."), 9: (2, 1, "Figure B arrives."), 10: (3, 0, TEXTS[10])}
    assert got.count() == content.count() and line_dedup.drop_shared_lines(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"capacity": 64, "max_segments": 3, "max_loss": 40}])
def test_packing_keeps_every_id_within_the_limits(content, empty, limits):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    got = packing.pack_content(content, path, **limits).collect()
    capacity, segments, loss = limits.get("capacity", 4096), limits.get("max_segments", 256), limits.get("max_loss", 4096)
    of = collections.defaultdict(list)
    for r in got:
        of[r.sequence_id].append(r)
    for pieces in of.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and len(pieces) <= segments and sum(p.n_loss for p in pieces) <= loss
    for row in content.where("content_id in (0, 5, 9)").collect():
        ids = model.encode(row.title or "", add_special_tokens=False).ids + model.encode(row.summary or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted((p for p in got if p.content_id == row.content_id), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    assert packing.pack_content(empty, path).count() == 0


def test_warc_round_trip(spark, tmp_path):
    schema = "page_id long, url string, html string, payload string, digest string"
    html = {1: "<p>a</p>", 2: "<p>a</p>", 3: None, 4: "", 5: "é" * 100_001, 6: "<p>a</p>"}
    data = [(i, f"https://shop.example/{i} x", h, "p", "d") for i, h in html.items()] + [(None, None, "<p>a</p>", None, None), (6, None, "<p>a</p>", None, None)]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(data, schema), path, chunk_bytes=1000)
    got = {r.page_id: r for r in warc.resolve(warc.read_records(spark, path)).collect()}
    assert set(got) == {*html, None}
    for i, h in html.items():
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {i: r.refers_to for i, r in got.items()} == {1: 6, 2: 6, 3: 4, 4: None, 5: None, 6: None, None: None}
    chunks = spark.read.parquet(path).where("page_id = 5").orderBy("chunk_no").collect()
    assert len(chunks) == 201 and b"".join(zlib.decompress(bytes(c.data), 31) for c in chunks) == html[5].encode()
    assert chunks[0].header.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "/5%20x" in chunks[0].header
    none = str(tmp_path / "none")
    warc.write_archive(spark.createDataFrame([], schema), none)
    assert warc.resolve(warc.read_records(spark, none)).count() == 0


def test_near_copies_of_each_other_that_are_not_similar_make_no_pairs(spark, monkeypatch):
    base = [f"w{i}" for i in range(40)]
    copies = [base[:5 + i % 30] + [f"own{i}"] + base[6 + i % 30:] for i in range(300)]
    frame = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(copies)], "content_id long, summary string")
    pairs = []

    def noted(df, name="step"):
        out = materialize(df, name)
        pairs.extend([out.count()] if name == "candidates" else [])
        return out

    monkeypatch.setattr(ngram_join, "materialize", noted)
    got = ngram_join.near_duplicates(frame).collect()
    sets = [shingles(" ".join(words)) for words in copies]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert all(r.component_id == r.content_id for r in got) and sum(pairs) <= len(copies)


def test_steps_of_links_are_few_files_and_go_when_done(spark, monkeypatch):
    steps = []

    def noted(df, name="step"):
        steps.append(materialize(df, name))
        files.extend(steps[-1].inputFiles())
        return steps[-1]

    files = []
    monkeypatch.setattr(components, "materialize", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        arcs = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)]
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(arcs, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert len(files) == len(steps) > 3
    assert [os.path.exists(f.removeprefix("file://")) for f in files] == [False] * (len(files) - 1) + [True]


def test_written_steps_leave_no_shuffle_files(tmp_path):
    program = """
import os, sys
from listing_lake.session import local_session, materialize
spark = local_session(cores=2, partitions=2, spark__local__dir=sys.argv[1])
assert materialize(spark.range(1000).groupBy("id").count()).inputFiles()
print(sum(f.startswith("shuffle_") for _, _, names in os.walk(sys.argv[1]) for f in names), "files")
"""
    root = str(pathlib.Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", program, str(tmp_path)], env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("0 files"), out.stdout


def test_codes_are_sorted_without_a_comparing_expression(spark, content):
    coded = fingerprints.fingerprint_content(content, fingerprints.lexicon(content))
    plan = coded._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sort_array" in plan and "array_sort" not in plan


def test_packing_without_prompts_looks_classes_up_by_length(monkeypatch):
    compared, argmax = [], np.argmax
    monkeypatch.setattr(packing.np, "argmax", lambda x: compared.append(len(x)) or argmax(x))
    lengths = [int(n) for n in np.random.default_rng(3).integers(1, 9000, 400)]
    outcomes = []
    for mixed in (0, 1):
        packer = packing._Packer(4096, 256, 4096, 0)
        packer._mixed = mixed  # one too many: the products of all classes are compared
        pieces = [p for i, n in enumerate(lengths) for p in packer.add((i, np.zeros(n, np.uint16), 0))] + packer.pack(last=True)
        outcomes.append([(p[0][0], *p[1:]) for p in pieces])
        assert bool(compared) == bool(mixed)
    assert outcomes[0] == outcomes[1] and sum(p[2] for p in outcomes[0]) == sum(lengths)


def test_packing_takes_the_class_with_the_greatest_product(monkeypatch):
    best, asked = packing._Packer._best, collections.Counter()

    def compared(packer, room, loss_room, fits):
        got = best(packer, room, loss_room, fits)
        usable = [k for k in packer.items if (k[0] <= room and k[1] <= loss_room if fits else loss_room or k[0] > k[1])]
        value = lambda k: k[0] * room / packer.capacity**2 + k[1] * loss_room / packer.max_loss**2
        assert (got in usable and abs(value(got) - max(map(value, usable))) < 1e-9) if usable else got is None
        asked[fits, bool(loss_room), got is None] += 1
        return got

    monkeypatch.setattr(packing._Packer, "_best", compared)
    draw, packer = np.random.default_rng(5), packing._Packer(512, 16, 400, 0)
    examples = [(i, np.zeros(n, np.uint16), int(n * draw.choice([0, 0.05, 0.2, 0.5]))) for i, n in enumerate(draw.integers(1, 900, 600).tolist())]
    pieces = [p for e in examples for p in packer.add(e)] + packer.pack(last=True)
    tokens, loss = collections.Counter(), collections.Counter()
    for example, start, length, sequence, _ in pieces:
        tokens[sequence] += length
        loss[sequence] += max(0, start + length - max(start, example[2]))
    assert sum(tokens.values()) == sum(len(e[1]) for e in examples) and max(tokens.values()) <= 512 and max(loss.values()) == 400
    # Sequences that meet the loss limit go on with prompts of texts that are cut there.
    assert asked[False, False, False] and any(tokens[q] == 512 and loss[q] == 400 for q in tokens)


def test_packing_query_has_prompts_and_meets_its_loss_limit(spark, tmp_path):
    from tokenizers import Tokenizer

    from listing_lake.llm import queries

    path = str(tmp_path)
    texts = ["One line without a prompt " * (1 + i % 7) if i % 4 == 0 else f"Heading {i} of the text\n" + f"the figure ships to shop {i} in spring\n " * (20 + i % 90) for i in range(120)]
    texts += [None, "", "\n", "Heading only\n", "\n no heading", "Überschrift größer\r\n\nText 새 피규어"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    got = queries.QUERIES["op9_vector_packing"](spark, path).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, tokens, loss = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in got:
        pieces[r.doc_id].append(r)
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += r.n_loss
    for i, whole in enumerate(texts):
        ids = model.encode(whole or "", add_special_tokens=False).ids + [2]
        prompt = len(model.encode(whole.split("\n")[0], add_special_tokens=False).ids) if whole and "\n" in whole else 0
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids) and sum(p.n_loss for p in pieces[i]) == len(ids) - prompt
    assert max(tokens.values()) == 4096 and max(loss.values()) == queries.MAX_LOSS < 4096
    assert any(tokens[q] > loss[q] == queries.MAX_LOSS for q in loss)


def test_words_are_coded_by_their_parts():
    import pyarrow as pa

    coder, _ = word_coding.tokenizer_coder(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    parts = word_coding.WordCoder(lambda words: asked.extend(words) or coder.encode(words), by_parts=True)
    odd = "Ship ship. SHIP, ship! don't it's. İx. J̌. <|ENDOFTEXT|> <|endoftext|> x<|endoftext|>. é. é. a1. 12. ... . ab-. x- 'S. Σας. KK. à! A . \x00."
    texts = pa.array([odd, None, "", " \t", "ship. " * 3, odd[::-1], LONG])
    got, at = parts.code(texts)
    want, want_at = word_coding.WordCoder(coder.encode).code(texts)
    assert got.tolist() == want.tolist() and at.tolist() == want_at.tolist()
    assert coder.by_parts and asked.count("ship") == 1 and not {"Ship", "ship.", "SHIP,"} & {*asked}
    assert parts.code(pa.array([], pa.string()))[0].tolist() == []
    assert not word_coding.tokenizer_coder(public_tokenizers.path("byte_bpe_50k.json"))[0].by_parts
