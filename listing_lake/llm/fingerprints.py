"""I-Match fingerprints of content texts: hashes of the terms of a document-frequency band, over random subsets of the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.llm.common import number_rows, text
from listing_lake.session import materialize

# Two random divisions of the lexicon; each part is a subset with a hash of its own. Small parts survive small edits of long
# texts, large ones say something about short texts.
DIVISIONS = ((128, 0), (32, 7))
EMPTY = -1
# In every place of a text without any term.
NO_TERMS = 42
# A lexicon of more terms is joined by a shuffle in place of a broadcast.
BROADCAST_TERMS = 2_000_000
# Stands in every row's terms and in the lexicon, so that rows without a term of the band stay.
_ANCHOR = -6067093571209137091


def term_hashes(value: Column) -> Column:
    """Hashes of the distinct terms (runs of letters and digits, in lower case) of a text."""
    terms = F.array_remove(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(content: DataFrame, least_share: float = 0.0005, most_share: float = 0.05) -> DataFrame:
    """Terms (`term`, their hash) that between `least_share` and `most_share` of all distinct texts hold, and at least two do.

    These are the terms of an inverse document frequency between log(1 / most_share) and log(1 / least_share). Counts are taken over
    all rows, a text that repeats counting once. The lexicon has at most (mean number of distinct terms of a text) / least_share
    terms, however many rows there are. An empty table has an empty lexicon.
    """
    texts = content.select(text().alias("summary")).distinct()
    terms = F.concat(F.array(F.lit(_ANCHOR)), term_hashes(F.col("summary")))
    counted = materialize(texts.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    # The anchor stands once in every text.
    total = (counted.where(F.col("term") == _ANCHOR).first() or {"df": 0})["df"]
    return counted.where((F.col("term") != _ANCHOR) & (F.col("df") >= max(2.0, least_share * total)) & (F.col("df") <= max(2.0, most_share * total))).select("term")


def _codes(terms: Column, others: Column, parts: int, shift: int) -> Column:
    """A 16-bit hash of the sorted terms of each part, of the others where it has none, `EMPTY` for a part without either."""
    code = lambda h: h.bitwiseAND(F.lit(0xFFFF)).cast("int")
    place = lambda out: lambda t: F.struct(F.pmod(F.shiftright(t, shift), F.lit(parts)).alias("part"), F.lit(out).alias("out"), t.alias("term"))
    # Not array_sort, which calls a comparing expression per pair.
    keyed = F.sort_array(F.concat(F.transform(terms, place(0)), F.transform(others, place(1))))
    start = F.struct(F.lit(-1).alias("part"), F.lit(0).alias("out"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<int>").alias("done"))

    def closed(state: Column, to: Column) -> Column:
        """The codes up to, but not including, part `to`."""
        own = F.when(state["part"] >= 0, F.array(code(state["hash"]))).otherwise(F.array().cast("array<int>"))
        gap = F.array_repeat(F.lit(EMPTY), to - state["part"] - 1)
        return F.concat(state["done"], own, gap)

    def step(state: Column, x: Column) -> Column:
        same = x["part"] == state["part"]
        opened = F.struct(
            x["part"].alias("part"), F.when(same, state["out"]).otherwise(x["out"]).alias("out"),
            F.xxhash64(F.when(same, state["hash"]).otherwise(F.lit(0).cast("long")), x["term"]).alias("hash"),
            F.when(same, state["done"]).otherwise(closed(state, x["part"])).alias("done"))
        return F.when(same & (x["out"] != state["out"]), state).otherwise(opened)

    return F.aggregate(keyed, start, step, lambda state: closed(state, F.lit(parts)))


def _fingerprint(terms: Column, own: Column) -> Column:
    """Codes of all subsets: of the terms of the band, and of the row's other terms in subsets without one of the band.

    So a text without terms of the band has the codes of its own, and an edit that brings in such terms changes their subsets only.
    """
    codes = F.concat(*[_codes(terms, F.array_except(own, terms), parts, shift) for parts, shift in DIVISIONS])
    places = sum(parts for parts, _ in DIVISIONS)
    return F.when(F.size(own) == 0, F.array_repeat(F.lit(NO_TERMS), places)).otherwise(codes)


def as_text(codes: Column) -> Column:
    """Four hexadecimal digits per subset, dashes for an empty one."""
    return F.array_join(F.transform(codes, lambda c: F.when(c == EMPTY, "----").otherwise(F.lpad(F.lower(F.hex(c)), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either row, 0 to 1."""
    tally = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, 1001).otherwise(1)),
        F.lit(0), lambda total, x: total + x)
    seen = F.pmod(tally, F.lit(1000))
    return F.when(seen == 0, 0.0).otherwise(F.floor(tally / 1000) / F.greatest(seen, F.lit(1))).cast("double")


def fingerprint_columns(rows: DataFrame, lexicon_terms: DataFrame, *names: str) -> DataFrame:
    """Replaces each named text column by its codes (`array<int>`); the other columns stay.

    The terms of a row are exploded, met with the lexicon and gathered again per row, already partly before the shuffle, so that its
    terms travel as two short arrays, all and those of the band. Rows that are already dealt by `content_id`, as after a join on it, are
    gathered where they are. A null text is empty; equal texts get equal codes; no rows give no rows.
    """
    terms = materialize(lexicon_terms, "lexicon")
    terms = terms.unionByName(terms.sparkSession.createDataFrame([(_ANCHOR,)], "term long"))
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    others = [c for c in rows.columns if c not in names]
    short = lambda t: t.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    key = F.col("content_id") if "content_id" in others else F.lit(None).cast("long")
    hashed = rows.select(
        key.alias("key"), F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"),
        *[term_hashes(F.coalesce(F.col(n), F.lit(""))).alias(n) for n in names],
    ).withColumns({f"own_{n}": F.array_distinct(F.transform(n, short)) for n in names})
    tag_as = lambda i: lambda t: F.struct(F.lit(i).alias("tag"), t.alias("term"))
    tagged = F.concat(F.array(F.struct(F.lit(-1).alias("tag"), F.lit(_ANCHOR).alias("term"))), *[
        F.transform(n, tag_as(i)) for i, n in enumerate(names)])
    kept = ["row", "others", *[f"own_{n}" for n in names]]
    gathered = (
        hashed.select("key", *kept, F.explode(tagged).alias("x"))
        .select("key", "row", "x.tag", "x.term", F.when(F.col("x.tag") == -1, F.struct(*kept[1:])).alias("head"))
        .join(terms, "term")
        .groupBy("key", "row")
        .agg(
            F.first("head", ignorenulls=True).alias("head"),
            *[F.collect_list(F.when(F.col("tag") == i, short(F.col("term")))).alias(n) for i, n in enumerate(names)],
        )
    )
    return gathered.select(
        *[F.col("head.others").getField(c).alias(c) for c in others],
        *[_fingerprint(F.array_distinct(n), F.col(f"head.own_{n}")).alias(n) for n in names],
    )


def fingerprint_content(content: DataFrame, lexicon_terms: DataFrame) -> DataFrame:
    """`content_id` and `codes` (`array<int>`, see `as_text` and `likeness`) of every content row; other columns are not returned.

    Equal summaries get equal codes, nulls and empty texts those of a text without terms, and repeated rows repeat. Texts are read
    whole. No rows give no rows.
    """
    return fingerprint_columns(content.select("content_id", text().alias("codes")), lexicon_terms, "codes")


def splice_next(content: DataFrame) -> DataFrame:
    """Every content row with an edited text: its last third (rounded down, in code points) gives way to the head of the next row.

    The next row is the one with the next smaller id, the largest for the smallest. Returns `content_id`, `summary`, `n_chars`,
    `edited` and `next_id`. Ids should be distinct and not null, as they are in the content table; rows of one id each get the head
    of every row that precedes that id, and rows without an id are left out. Each text is shuffled once, by id.
    """
    rows = content.where(F.col("content_id").isNotNull()).select("content_id", text().alias("summary"))
    places, total = number_rows(rows.select("content_id", F.length("summary").cast("long").alias("n_chars")), "content_id", "n_chars")
    giver = places.select(F.col("content_id").alias("next_id"), F.pmod(F.col("row_number") + 1, F.lit(max(1, total))).alias("row_number"))
    taker = places.select("content_id", "n_chars", "row_number")
    plan = giver.join(taker, "row_number").select("next_id", "content_id", "n_chars")
    heads = (
        rows.withColumnRenamed("content_id", "next_id").join(plan, "next_id")
        .select("content_id", "next_id", "n_chars", F.substring("summary", F.lit(1), F.expr("int(n_chars div 3)")).alias("head"))
    )
    # Written, so that the texts' first shuffle is gone before the second begins.
    heads = materialize(heads, "heads")
    return rows.join(heads, "content_id").select(
        "content_id", "summary", "n_chars",
        F.concat(F.substring("summary", F.lit(1), F.expr("int(n_chars - n_chars div 3)")), "head").alias("edited"), "next_id")
