"""The corpus pipeline on a small table, stage by stage against plain Python."""

import collections
import unicodedata

import public_tokenizers

import corpus_pipeline
from test_llm import lowered, shingles, words_of


def near_groups(sets):
    """The smallest place in `sets` of each one's group, by all pairs."""
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group


def kept_of_groups(docs):
    """Multiset of (id, how many rows stay) that near-duplicate removal leaves: one row per group, with its smallest id."""
    known = sorted((d for d in docs if d[0] is not None), key=lambda d: d[0])
    group = near_groups([shingles(t) for _, t in known])
    ids = [known[g][0] for g in sorted(set(group))]
    return collections.Counter([*ids, *[None for d in docs if d[0] is None]])


def test_one_row_of_each_near_duplicate_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    docs = [(1, text), (1, text), (1, lowered(text.upper())), (2, text + " end"), (3, other), (3, other + " end"), (3, text), (4, other), (5, "alone it is"), (None, text), (None, text)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert got.columns == frame.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == kept_of_groups(docs) == {1: 1, 3: 1, 5: 1, None: 2}


def passes_rules(text):
    words, text = words_of(text), text or ""
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    repeated = len(lines) - len(set(lines))
    n, chars = len(words), sum(map(len, words))
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    return not (
        n < 10 or 100 * len(covered) > 20 * n or 10 * sum(c in "#*$%&|<>" for c in text) > 3 * n or 2 * upper > letters
        or repeated >= 3 and 100 * repeated > 30 * len(lines) or chars > 20 * n or chars < 2 * n or 100 * echoes > 20 * n or 2 * letters < chars)


def without_shared_lines(docs):
    ids = collections.defaultdict(set)
    key = lambda line: lowered(line.strip(" \t\n\x0b\f\r"))
    for i, text in docs:
        for line in text.split("\n"):
            if i is not None and len(key(line)) >= 20:
                ids[key(line)].add(i)
    lost = lambda i, line: i is not None and len(ids[key(line)]) >= 3 and i != max(ids[key(line)])
    return [(i, "\n".join(line for line in text.split("\n") if not lost(i, line))) for i, text in docs]


def test_run_stage_by_stage(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    # Numbers spelled in words of their own, so that the clean texts are no near copies of each other.
    clean = {i: f"The series figure number{i} ships in spring from shop{i}, and all orders for item{i} close in {i % 28} days there." for i in range(60)}
    clean |= {i: clean[i] + "\nShared notice line of the shop, please read." for i in range(20, 26)}
    long = " ".join(f"the {a}{b} figure ships" for a in ("red", "blue", "old", "new", "small") for b in ("cat", "dog", "fox", "bird", "fish"))
    clean |= {200: long, 201: long + " today", 202: long + " now"}
    junk = {i + 100: f"$$$ ### {i} *** ||| " * (3 + i % 7) for i in range(60)}
    docs = [*clean.items(), *junk.items()]
    docs += [(7, clean[7]), (200, long), (30, "The shop also sells many other things under an id that repeats, so please look around."), (None, clean[3]), (None, long), (None, None)]
    docs += [(300, "Orders ship in spring."), (301, None), (302, "THE SHOP OPENS ALL ORDERS TODAY FOR EVERY FIGURE OF THE SERIES IN SPRING")]
    path = str(tmp_path)
    frame = spark.createDataFrame([(i, t, "shop", len(t or "")) for i, t in docs], "doc_id long, text string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i in clean)) for i in (*clean, *junk)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    after, write = {}, corpus_pipeline.materialize

    def noted(df, name):
        after[name] = write(df, name)
        return after[name]

    monkeypatch.setattr(corpus_pipeline, "materialize", noted)
    pieces = corpus_pipeline.run(spark, path).collect()
    rows = {name: [(r.doc_id, r.text) for r in after[name].collect()] for name, _ in corpus_pipeline.STAGES[:-1]}
    counted = lambda x: collections.Counter(x)
    assert all(after[name].columns == frame.columns for name in rows)

    scored = counted(rows["quality_classifier"])
    assert not scored - counted(docs) and not {i for i, _ in scored} & set(junk)
    assert all(scored[d] == n for d, n in counted(docs).items() if d[1] in clean.values())

    assert counted((i, t or "") for i, t in rows["quality_rules"]) == counted((i, t or "") for i, t in rows["quality_classifier"] if passes_rules(t))
    assert counted(rows["line_dedup"]) == counted(without_shared_lines(rows["quality_rules"]))
    assert rows["line_dedup"] != rows["quality_rules"] and all(r.n_chars == len(r.text) for r in after["line_dedup"].collect())

    left = rows["ngram_jaccard_join"]
    assert not counted(left) - counted(rows["line_dedup"]) and len(left) < len(rows["line_dedup"])
    assert counted(i for i, _ in left) == kept_of_groups(rows["line_dedup"])

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, got, full = collections.Counter(), collections.Counter(), collections.Counter()
    for i, text in left:
        want[i] += len(model.encode(text or "", add_special_tokens=False).ids) + 1
    for p in pieces:
        got[p.doc_id] += p.length
        full[p.sequence_id] += p.length
    assert got == want and max(full.values()) <= 4096
