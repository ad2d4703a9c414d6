"""The hash tree over content rows, against a plain version that hashes level by level."""

import hashlib

import pytest
from pyspark.sql import functions as F

from listing_lake.llm import merkle
from listing_lake.operators import store

FIELDS = ("content_id", "source", "sourceLanguage", "price", "summary")
SCHEMA = "content_id string, source string, sourceLanguage string, price bigint, summary string, tree string, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(digests):
    out = [list(digests)]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, at):
    out = []
    for level in tree[:-1]:
        out.append((at % 2 == 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        at //= 2
    return out


def plain(rows):
    """Sorted (id, leaf, subroot, root, proof) of rows given as field tuples."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or "", sha(*map(framed, row[:5])), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for at, (_, _, leaf, name) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            out.append((name, leaf, trees[g][-1][0], top[-1][0], path(trees[g], at) + path(top, i)))
    return sorted(out, key=repr)


def row(i, language, text="figure", price=None):
    return (None if i is None else f"FIGURE:{i:05d}", "shop", language, price, text, "clash", None)


CASES = {
    "one row": [row(1, "ja")],
    "one group of five": [row(i, "ko", price=i) for i in range(5)],
    "groups, nulls, repeats": [row(i, ("ja", "ko", "en", None, "")[i % 5 if i % 3 else 0], ("", None, "피규어 예약", "x" * 50_000)[i % 4], i) for i in range(23)]
    + [row(7, "ja")] * 3 + [row(None, "ja"), row(None, "ja"), row(None, None, None)],
    "every row its own group": [row(i, f"l{i}") for i in range(9)],
}


@pytest.mark.parametrize("name, levels_at_once", list(zip(CASES, (10, 1, 2, 10))))
def test_manifest_equals_plain_tree(spark, name, levels_at_once):
    frame = spark.createDataFrame(CASES[name], SCHEMA).repartition(3)
    sealed = merkle.manifest(frame, FIELDS, keep=("price", "tree"), block_levels=levels_at_once)
    got = sealed.withColumn("ok", merkle.verified(F.col("leaf"), F.col("proof"), F.col("root"))).collect()
    assert all(r.ok and r.tree == "clash" for r in got)
    found = [(r.content_id, r.leaf, r.subroot, r.root, [(s.left, s.digest) for s in r.proof]) for r in got]
    assert sorted(found, key=repr) == plain(CASES[name])


def test_changed_row_fails_its_proof(spark):
    frame = spark.createDataFrame(CASES["groups, nulls, repeats"], SCHEMA)
    changed = merkle.field_hash(*[F.col(c) + 1 if c == "price" else F.col(c) for c in FIELDS])
    sealed = merkle.manifest(frame.withColumn("now", changed), FIELDS, keep=("now", "price"))
    told = sealed.select("price", merkle.verified(F.col("now"), F.col("proof"), F.col("root")).alias("ok")).collect()
    assert {r.ok for r in told if r.price is not None} == {False} and {r.ok for r in told if r.price is None} == {True}


def test_empty_content_and_default_fields(spark):
    nothing = spark.createDataFrame([], store.CONTENT_DDL)
    assert merkle.manifest(nothing).count() == 0
    one = store.conform(spark.createDataFrame([("FIGURE:1", "ja")], "content_id string, sourceLanguage string"))
    kept = merkle.manifest(one).first()
    assert kept.leaf == kept.subroot == kept.root == sha(*map(framed, ("FIGURE:1", None, "ja", None, None, None, None))) and kept.proof == []


def test_fields_need_one_text_form(spark):
    with pytest.raises(ValueError, match="createdAt"):
        merkle.manifest(spark.createDataFrame([], store.CONTENT_DDL), ("createdAt",))


def test_sweeps_deliver_in_label_order():
    leaves = [sha(str(i)) for i in range(11)]
    root, received = merkle.deliver_up(leaves, 4)
    assert root == levels(leaves)[-1][0] and len(received) == 6 + 3 + 2 + 1
    proofs = merkle.deliver_down(received, 11, 4, [{"left": True, "digest": "above"}])
    for at, proof in enumerate(proofs):
        assert [(s["left"], s["digest"]) for s in proof] == path(levels(leaves), at) + [(True, "above")]
