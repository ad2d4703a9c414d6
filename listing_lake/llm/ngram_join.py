"""Similarity join of content rows on word shingles, by prefix filters under several token orders."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from listing_lake.llm.common import settled, text
from listing_lake.llm.components import connected_components
from listing_lake.session import materialize, narrow, release

# The part of the token space whose document frequencies are known to the first order.
LOW_SHARE = 0.25
ORDERS = 3
# Sets of up to so many tokens meet by their exact size, larger ones by size classes of this ratio.
EXACT_SIZES, SIZE_STEP = 32, 1.12
# The part of the token space looked at before whole sets are, and the bits of a set's parity.
NEXT_SHARE = 0.6
PARITY_BITS = 256


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# Unrelated odd multipliers, one per place of a word in its shingle.
_PLACES = _avalanche(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of fewer words has one shingle, one without words none."""
    import xxhash

    from listing_lake.llm.word_coding import split_words

    names, codes, starts = split_words(pc.ascii_lower(texts.fill_null("")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in names), np.uint64, len(names))[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        if n >= width:
            rolled += hashes[j:n - width + 1 + j] * _PLACES[j]
    rolled = _avalanche(rolled)
    out = []
    for first, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if end - first >= width:
            out.append(np.unique(rolled[first:end - width + 1]))
        elif end > first:
            total = (hashes[first:end] * _PLACES[:end - first]).sum(dtype=np.uint64) + np.uint64(end - first)
            out.append(_avalanche(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_hash(tokens: np.ndarray) -> int:
    return int(np.array([_avalanche(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)]).view(np.int64)[0])


def _prefix_size(n, percent: int):
    """Tokens of a set of n of which a similar set must share one, under any order of all tokens."""
    return n + (-percent * n) // 100 + 1 if isinstance(n, int) else n - F.ceil(n * percent / 100).cast("int") + 1


def _token_table(content: DataFrame, width: int, percent: int) -> DataFrame:
    """`content_id`, size and hash of the set, how many tokens are low, and the tokens to post: the low ones, or all where these are
    fewer than the prefix."""
    limit = np.uint64(int(LOW_SHARE * 2**64))
    schema = StructType([
        content.schema["content_id"], StructField("n_shingles", IntegerType()), StructField("set_hash", LongType()),
        StructField("n_low", IntegerType()), StructField("posted", ArrayType(LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            low = [int(np.searchsorted(tokens, limit)) for tokens in sets]
            posted = [s if k < _prefix_size(len(s), percent) else s[:k] for s, k in zip(sets, low)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in posted])]).astype(np.int32)
            flat = np.concatenate(posted).view(np.int64) if posted else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([_set_hash(s) for s in sets], pa.int64()),
                pa.array(low, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ], names=schema.names)

    return content.mapInArrow(run, schema)


def _filters(tokens: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Per set that may have a partner: its prefixes under `ORDERS` global orders, tokens nobody else has left out.

    All orders put low tokens before the others and both by rising frequency among the rows that post them: the first breaks ties by the
    token, the others take frequencies by powers of two and break ties by another hash. Tokens of a single row fill up a prefix
    without being posted, so most sets have an empty rest. A set with fewer low tokens than its prefix has posted all its tokens; those
    of the others that nobody else has posted come first among them.
    """
    postings = tokens.select(F.col("set_hash").alias("node"), F.explode("posted").alias("token"))
    frequent = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # A token of a third of all rows is split by the skew join: each posting meets one row. Rows of one set collapse on the map side.
    hits = postings.join(frequent, "token").groupBy("node").agg(F.collect_set(F.struct("df", "token")).alias("found"))
    of_class = hits.join(classes.select("node", "n_shingles", "n_low"), "node").withColumn(
        "weight", F.aggregate("found", F.lit(0).cast("long"), lambda total, x: total + x["df"]))
    need = _prefix_size(F.col("n_shingles"), percent)
    high = lambda x: (x["token"] < 0) | (x["token"] >= F.lit(int(LOW_SHARE * 2**64)))
    n_high = F.size(F.filter("found", high))
    single_high = F.col("n_shingles") - F.col("n_low") - n_high
    rest = F.when(F.col("n_low") < need, F.size("found") - n_high + F.greatest(F.lit(0), need - F.col("n_low") - single_high)).otherwise(
        need - (F.col("n_low") - F.size("found")))

    def prefix(k: int) -> Column:
        if k == 0:
            ordered = F.sort_array(F.transform("found", lambda x: F.struct(high(x).alias("high"), x["df"].alias("df"), x["token"].alias("token"))))
        else:
            ordered = F.sort_array(F.transform("found", lambda x: F.struct(
                high(x).alias("high"), F.floor(F.log2(x["df"])).alias("rarity"), F.xxhash64(x["token"], F.lit(k)).alias("tie"), x["token"].alias("token"))))
        return F.transform(F.slice(ordered, F.lit(1), F.col("rest")), lambda x: x["token"])

    return materialize(
        of_class.withColumn("rest", rest).where("rest > 0")
        .select("node", "n_shingles", (-F.col("weight") / F.col("n_shingles")).alias("rank"), (F.col("n_low") - (F.size("found") - n_high)).alias("low_alone"),
                *[prefix(k).alias(f"prefix_{k}") for k in range(ORDERS)]),
        "filters",
    )


def _alike_in_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _parity(tokens: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of the tokens falls on it: two sets differ by at least as many tokens as their parities by bits."""
    odd = np.bincount((tokens % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _whole_sets(nodes: DataFrame, classes: DataFrame, content: DataFrame, width: int) -> DataFrame:
    """(`node`, `tokens`, `parity`): the whole sets of the given nodes, made from one text of each."""
    schema = "node long, tokens array<long>, parity array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, nodes = shingle_sets(batch.column(1), width), batch.column(0).to_pylist()
            # Rows of one id may hold several texts: the set's hash tells which one is meant.
            keep = [(n, s.view(np.int64), _parity(s)) for n, s in zip(nodes, sets) if _set_hash(s) == n]
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keep], pa.int64()), *[pa.array([k[i] for k in keep], pa.list_(pa.int64())) for i in (1, 2)],
            ], names=["node", "tokens", "parity"])

    named = nodes.join(classes, "node").select("node", F.col("first_id").alias("content_id"))
    texts = content.join(named, "content_id").select("node", "summary")
    return materialize(texts.mapInArrow(run, schema), "sets")


def _similar(pairs: DataFrame, n_pairs: int, filters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the `n_pairs` pairs (`a`, `b`) whose sets are similar: the other orders' prefixes must meet as well, then whole sets are compared."""
    prefixes = [f"prefix_{k}" for k in range(1, ORDERS)]
    both = (
        pairs.join(filters.select(F.col("node").alias("a"), *prefixes), "a")
        .join(filters.select(F.col("node").alias("b"), *[F.col(p).alias(f"other_{p}") for p in prefixes]), "b")
    )
    for p in prefixes:
        both = both.where(F.arrays_overlap(p, f"other_{p}"))
    left = materialize(narrow(both.select("a", "b"), n_pairs), "pairs")
    facing = left.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    # Distinct: a set stands twice where an id repeats with the same text.
    return facing.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("both"), settled(common).alias("common")).where(
        100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b").distinct()


def _may_be_similar(percent: int) -> Column:
    """Whether the parities of `a` and `b` leave room for a similar pair: sets of n and m tokens may differ by (100 - percent) * (n + m) /
    (100 + percent)."""
    apart = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def _with_partners(filters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The given sets without those that have too many tokens of their own for any partner, by all tokens below `NEXT_SHARE`.

    The low tokens alone say little about a set that shares a passage with others. Tokens nobody shares are counted, not gathered.
    """
    low, limit = (int(share * 2**64) for share in (LOW_SHARE, NEXT_SHARE))
    # Unsigned order of signed numbers: those from 2**63 on are negative.
    within = lambda x: (x >= F.lit(low)) | (x < F.lit(limit - 2**64))
    postings = sets.select("node", F.explode(F.filter("tokens", within)).alias("token"))
    shared = postings.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")
    # Twice where an id repeats with the same text: then all its tokens are met, counted as often.
    met = postings.join(shared, "token").groupBy("node").agg(F.count("*").alias("met_next"))
    sizes = sets.groupBy("node").agg(F.sum(F.size(F.filter("tokens", within))).alias("n_next"), F.first("parity").alias("parity"))
    alone = F.col("low_alone") + F.col("n_next") - F.coalesce("met_next", F.lit(0))
    return filters.join(sizes, "node").join(met, "node", "left").where(alone < _prefix_size(F.col("n_shingles"), percent)).select(
        "node", "n_shingles", "rank", "parity", "prefix_0")


def _size_class(n: Column) -> Column:
    return F.when(n <= EXACT_SIZES, n).otherwise(EXACT_SIZES + F.floor(F.log(n / EXACT_SIZES) / math.log(SIZE_STEP))).cast("int")


def _least_size(size_class: Column) -> Column:
    """A size that no set of the class is below."""
    return F.when(size_class <= EXACT_SIZES, size_class).otherwise(
        F.floor(EXACT_SIZES * F.pow(F.lit(SIZE_STEP), size_class - EXACT_SIZES)) - 1).cast("int")


def _open_buckets(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Buckets of the given sets (`node`, `n_shingles`, `component`, `parity`) in which every similar pair of different components meets.

    The order of a set's tokens puts those that only one component holds first: no pair looked for shares them, so they fill up prefixes
    without being posted. The others follow by rising frequency. Similar sets of n and m tokens share at least percent * (n + m) /
    (100 + percent), so prefixes get shorter the larger the partner: a bucket is a token and the size classes of both sides (`small`,
    `large`). A near copy with too many tokens of its own for any partner posts none, however many other near copies there are.

    Returns the bucket, the columns of the sets, `size_class` and `left` (how many tokens are left in the order, with this one).
    """
    postings = sets.select("node", F.explode("tokens").alias("token")).join(nodes.select("node", "component"), "node")
    shared = postings.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("df")).where("low <> high")
    found = postings.select("node", "token").join(shared.select("token", "df"), "token").groupBy("node").agg(
        F.sort_array(F.collect_set(F.struct("df", "token"))).alias("found"))
    n, left = F.col("n_shingles"), F.size("found")
    least = F.ceil(n * percent / 100).cast("int")
    # Tokens of the order that a partner of `size` tokens may begin to meet the set at, those of one component taken off.
    posts = lambda size: n - F.ceil((n + size) * percent / (100 + percent)).cast("int") + 1 - (n - left)

    def posted(partner: Column) -> Column:
        return F.transform(
            F.slice("found", F.lit(1), F.greatest(F.lit(0), posts(F.greatest(_least_size(partner), least)))),
            lambda x, i: F.struct(
                x["token"].alias("token"), F.least("size_class", partner).alias("small"), F.greatest("size_class", partner).alias("large"),
                (left - i).alias("left")))

    partners = F.sequence(_size_class(least), _size_class(F.floor(n * 100 / percent)))
    return (
        found.join(nodes, "node").where(posts(least) > 0).withColumn("size_class", _size_class(n))
        .select("node", "n_shingles", "component", "parity", "size_class", F.explode(F.flatten(F.transform(partners, posted))).alias("x"))
        .select("x.token", "x.small", "x.large", "node", "n_shingles", "component", "parity", "size_class", "x.left")
    )


def _split(buckets: DataFrame, key: list[str]) -> DataFrame:
    """Those of the buckets that hold several components, and both size classes if they are of two."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("component", "size_class") if c in buckets.columns for name, f in (("low", F.min), ("high", F.max))]
    split = buckets.groupBy(*key).agg(*ends).where("low_component <> high_component")
    if "size_class" in buckets.columns:
        split = split.where("small = large or low_size_class <> high_size_class")
    split = split.select(*key)
    return buckets.join(split, key)


def _links(filters: DataFrame, classes: DataFrame, content: DataFrame, width: int, percent: int, spare: int = 4, turns: int = 3) -> DataFrame:
    """Enough links between different sets to join every two similar sets, directly or by way of others.

    Sets that share a first-order prefix token form a bucket. First every set of a bucket is compared with one central set; this joins
    groups of near copies without comparing all their pairs. Pairs whose parities are too far apart are never made. Sets whose buckets still hold several components go on, with all their tokens,
    to the narrower buckets of `_open_buckets`. There all pairs that are in different components are compared, so that no similar pair
    stays apart. If those pairs would outnumber the postings by more than `spare`, other central sets are tried first, another in every
    bucket, in `turns` turns altogether.
    """
    spark = filters.sparkSession
    key, sets = ["token"], _whole_sets(filters.select("node"), classes, content, width)
    partners = materialize(_with_partners(filters, sets, percent), "partners")
    known = partners.select("node", "n_shingles", "rank", "parity", F.explode("prefix_0").alias("token"), F.col("node").alias("component"))
    known = materialize(_split(known, key), "buckets")
    release(partners)
    links, tried, linked = [], [], 0
    for turn in range(turns + 1):
        if turn:
            found = connected_components(_all(links)).select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = materialize(narrow(found, 2 * linked), "components")
            # From here on the components stand for the links they were made of.
            release(*links)
            links, buckets = [found], known
            known = buckets.drop("component").join(found.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn(
                "component", F.coalesce("component", "node"))
            nodes = materialize(narrow(_split(known, key).select("node", "n_shingles", "component", "parity").distinct(), rows), "nodes")
            key = ["token", "small", "large"]
            known = materialize(_split(_open_buckets(nodes, sets, percent), key), "buckets")
            release(buckets, nodes)
        sizes = known.groupBy(*key, "component").agg(F.count("*").alias("n")).groupBy(*key).agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        open_pairs, rows = sizes.agg(
            F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not open_pairs:
            break
        one = known.withColumnsRenamed({"node": "a", "n_shingles": "n_a", "component": "c_a", "parity": "parity_a", "size_class": "k_a", "left": "left_a"})
        last = turn == turns or turn > 0 and open_pairs <= spare * rows
        if last:
            other = known.withColumnsRenamed({"node": "b", "n_shingles": "n_b", "component": "c_b", "parity": "parity_b", "size_class": "k_b", "left": "left_b"})
            share = F.least("left_a", "left_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
            candidates = one.join(other, key).where("a < b and c_a <> c_b and (small = large or k_a <> k_b)").where(share)
        else:
            rank = F.col("rank") if turn == 0 else F.xxhash64("node", "token", F.lit(turn)).cast("double")
            centre = known.groupBy(*key).agg(F.min(F.struct(rank, "node", "n_shingles", "component", "parity")).alias("centre")).select(
                *key, F.col("centre.node").alias("b"), F.col("centre.n_shingles").alias("n_b"), F.col("centre.component").alias("c_b"),
                F.col("centre.parity").alias("parity_b"))
            candidates = one.join(centre, key).where("c_a <> c_b")
        candidates = candidates.where(_alike_in_size("n_a", "n_b", percent) & _may_be_similar(percent)).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        for earlier in tried:
            candidates = candidates.join(earlier, ["a", "b"], "left_anti")
        candidates = materialize(narrow(candidates, open_pairs if last else rows), "candidates")
        tried.append(candidates)
        pairs = candidates.count()
        links.append(materialize(narrow(_similar(candidates, pairs, filters, sets, percent), pairs), "similar"))
        linked += pairs
        if last:
            break
    release(sets, known, *tried)
    return _all(links) if links else spark.createDataFrame([], "a long, b long")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def near_duplicates(content: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups content rows whose word-shingle sets are linked by a Jaccard similarity of at least `percent` / 100.

    A summary's tokens are its distinct runs of `width` words (A-Z lower-cased, words parted by ASCII blanks); a shorter one has a single
    token, one without words none and no partner. Rows with equal sets are one node. Two similar sets share a prefix token under every
    global order of the tokens: the first order, by rising document frequency, gives the candidates, which must meet under the
    other orders too before whole sets are compared exactly. Every similar pair of different sets ends in one component, and
    components are joined by links only.

    Returns `content_id`, `n_shingles`, `component_id` (smallest id of the component) and `set_hash` for each row. Null ids get a
    null component and link with nothing; null summaries are empty; repeated rows repeat; rows of one id with different texts are
    nodes of their own; no rows give no rows; other columns are not returned.
    """
    if width > len(_PLACES):
        raise ValueError("shingle too wide")
    rows = content.select("content_id", text().alias("summary"))
    tokens = materialize(_token_table(rows, width, percent), "tokens")
    named = tokens.where(F.col("content_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialize(
        named.groupBy(F.col("set_hash").alias("node"), "n_shingles", "n_low").agg(F.min("content_id").alias("first_id")), "classes")
    filters = _filters(named, classes, percent)
    links = _links(filters, classes, rows, width, percent)
    release(filters)
    components = connected_components(links)
    smallest = (
        classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    ids = smallest.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = smallest.join(ids, "component").select(F.col("node").alias("set_hash"), "component_id")
    return (
        tokens.select("content_id", "n_shingles", "set_hash")
        .join(of_class, "set_hash", "left")
        .select(
            "content_id", F.col("n_shingles").cast("long").alias("n_shingles"),
            F.when(F.col("n_shingles") == 0, F.col("content_id")).when(F.col("content_id").isNotNull(), F.col("component_id")).alias("component_id"),
            "set_hash",
        )
    )
