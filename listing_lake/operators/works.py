"""Titles joined with the dictionary of works: a seeded multi-pattern join."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from listing_lake.functions.text import fold_title, strip
from listing_lake.session import materialize

# --- fixed values: must equal the stored data's rules -------------------------------------------
MIN_KEYWORD = 2
# ------------------------------------------------------------------------------------------------

# A seed with more than one in so many of the (text, seed) rows that some keyword can answer is dealt to several tasks.
HOT_SHARE = 1_000

_RUN = re.compile(r"[a-z0-9]+")
_WIDE = re.compile(r"[^\x00-\x7f]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def alias_array(aliases: Column, is_array: bool) -> Column:
    """Aliases come as a list or as one comma- or newline-separated text."""
    return aliases if is_array else F.split(aliases, r"[,\n]")


def work_keywords(works: DataFrame) -> DataFrame:
    """(work_ord, work, norm_name, kw_ord, keyword, norm): names and aliases, first spelling of a form kept.

    Entries repeating a name merge under the first spelling and place.
    """
    rows = works.select(
        F.col("ord"), strip(F.col("name")).alias("name"),
        F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "raw"),
    ).filter(F.col("name") != "")
    rows = rows.select(
        "ord", "name", "pos", strip(F.col("raw")).alias("keyword"), fold_title(F.col("name")).alias("norm_name"),
    ).filter(F.col("keyword") != "").withColumn("norm", fold_title(F.col("keyword")))
    names = rows.groupBy("norm_name").agg(F.min("ord").alias("work_ord"), F.min_by("name", "ord").alias("work"))
    words = rows.groupBy("norm_name", "norm").agg(F.min(F.struct("ord", "pos", "keyword")).alias("_k"))
    return words.join(names, "norm_name").select(
        "work_ord", "work", "norm_name", F.struct("_k.ord", "_k.pos").alias("kw_ord"), F.col("_k.keyword").alias("keyword"), "norm",
    )


def _ascii_seeds(text: str) -> list[str]:
    return ["w:" + run for run in set(_RUN.findall(text))] + ["m:" + mark for mark in _MARKS if mark in text]


def _wide_seeds(text: str) -> list[str]:
    if text.isascii():
        return []
    spans = ((max(run.start() - 1, 0), min(run.end(), len(text) - 1)) for run in _WIDE.finditer(text))
    return ["p:" + pair for pair in {text[at:at + 2] for start, end in spans for at in range(start, end)}]


@F.pandas_udf(ArrayType(StringType()))
def _keyword_seeds(norms: pd.Series) -> pd.Series:
    return norms.map(lambda k: None if k is None else _ascii_seeds(k) if k.isascii() else _wide_seeds(k))


@F.pandas_udf(ArrayType(StringType()))
def _text_seeds(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _ascii_seeds(t) + _wide_seeds(t))


def _stands(text: str, keyword: str) -> bool:
    """Whether a text holds a keyword, an ASCII one as whole words. The text is known to hold one of the keyword's seeds."""
    if not keyword.isascii():
        return keyword in text
    if _RUN.fullmatch(keyword):
        # A lone run is its own and only seed.
        return True
    at = text.find(keyword)
    while at >= 0:
        end = at + len(keyword)
        if (at == 0 or text[at - 1] not in _ALNUM) and (end == len(text) or text[end] not in _ALNUM):
            return True
        at = text.find(keyword, at + 1)
    return False


@F.pandas_udf(ArrayType(BooleanType()))
def _held(texts: pd.Series, candidates: pd.Series) -> pd.Series:
    return pd.Series([[t is not None and _stands(t, k) for k in found] for t, found in zip(texts, candidates)])


def keyword_seeds(keywords: DataFrame) -> DataFrame:
    """Adds `seeds`, everything short that a text must hold if it holds the keyword; `match_pairs` goes by the rarest of them.

    ASCII keywords match whole words only, so their runs of letters and digits are whole runs of the text, and their punctuation marks
    stand in it. Others have pairs of characters with a non-ASCII one. Keywords below two characters never match.
    """
    return keywords.filter(F.length("norm") >= MIN_KEYWORD).withColumn("seeds", _keyword_seeds(F.col("norm")))


def text_seeds(text: Column) -> Column:
    """Distinct seeds a normalised text can answer to."""
    return _text_seeds(text)


def _seeded(keywords: DataFrame) -> DataFrame:
    """A row per keyword and seed."""
    return keyword_seeds(keywords).select("work_ord", "work", "norm_name", "norm", F.explode("seeds").alias("seed"))


def seed_hits(items: DataFrame, seeded: DataFrame, text: str, *keep: str) -> DataFrame:
    """(*keep, seed): the seeds of every text that some keyword has. All others stay in the task that read the text."""
    return items.select(*keep, F.explode(text_seeds(F.col(text))).alias("seed")).join(seeded.select("seed").distinct(), "seed", "left_semi")


def _place(seeded: DataFrame, hits: DataFrame) -> DataFrame:
    counts = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    found = (
        seeded.join(counts, "seed", "left")
        .groupBy("norm_name", "norm")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "seed")).alias("rarest"), F.first(F.struct("work_ord", "work")).alias("k"))
        .filter("rarest.n > 0")
        .select("rarest.seed", "rarest.n", "k.work_ord", "k.work", "norm_name", "norm")
    )
    share = F.ceil(F.col("n") * HOT_SHARE / hits.agg(F.count(F.lit(1))).scalar())
    return found.withColumn("parts", F.greatest(F.lit(1), share).cast("int")).drop("n")


def rarest_seeds(keywords: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """Every keyword under the seed that the fewest texts hold, and `parts`, the tasks that the seed's rows are dealt to.

    Seeds are counted over all texts. A keyword with a seed that no text holds matches nothing and is left out. A seed that stands for
    more than one in `HOT_SHARE` of the hits is hot and has several parts; so there are fewer than `HOT_SHARE` hot ones, whatever the
    tables hold.
    """
    seeded = materialize(_seeded(keywords), "keyword_seeds")
    return _place(seeded, materialize(seed_hits(items, seeded, text), "seed_hits"))


def match_pairs(items: DataFrame, keywords: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item, work_ord, work, norm_name) of every work whose keyword the text holds.

    `text` is already normalised. Texts are read once for their seeds, of which only those of the dictionary go on. Texts and keywords
    meet on bare seeds, each keyword on its rarest one; rows of a hot seed are dealt to several tasks, to each of which its keywords are
    copied. The text joins only the candidate keywords of its own item, where they are verified; their works follow. Nothing is
    collected, and the plan is the same for any dictionary. Items without an id match nothing.
    """
    items = items.filter(F.col(item_id).isNotNull())
    seeded = materialize(_seeded(keywords), "keyword_seeds")
    hits = materialize(seed_hits(items, seeded, text, item_id), "seed_hits")
    placed = materialize(_place(seeded, hits), "placed_keywords")
    probes = (
        # Fewer than HOT_SHARE rows, see rarest_seeds.
        hits.join(F.broadcast(placed.filter("parts > 1").select("seed", "parts").distinct()), "seed", "left")
        .select(item_id, "seed", F.coalesce(F.pmod(F.xxhash64(item_id), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    )
    copies = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # Works that share a spelling share its seed and its parts.
    spellings = copies.select("seed", "part", "norm").distinct()
    candidates = probes.join(spellings, ["seed", "part"]).groupBy(item_id).agg(F.collect_set(F.struct("norm", "part")).alias("candidates"))
    found = (
        items.select(item_id, F.col(text).alias("_t")).join(candidates, item_id)
        .select(item_id, "candidates", _held(F.col("_t"), F.col("candidates.norm")).alias("held"))
        .select(item_id, F.explode(F.filter("candidates", lambda _, at: F.get("held", at))).alias("k"))
        .select(item_id, "k.norm", "k.part")
    )
    return found.join(copies, ["norm", "part"]).select(item_id, "work_ord", "work", "norm_name").distinct()


def match_works(items: DataFrame, keywords: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, works): names of the matched works in dictionary order. Unmatched items are absent."""
    pairs = match_pairs(items, keywords, item_id, text)
    # At most one entry per work of the dictionary, so the list is bounded by the dictionary.
    ordered = F.array_sort(F.collect_set(F.struct("work_ord", "work")))
    return pairs.groupBy(item_id).agg(F.transform(ordered, lambda w: w["work"]).alias("works"))


def with_works(
    items: DataFrame, keywords: DataFrame, item_id: str = "content_id", title: str = "title", title_ko: str = "titleKo",
) -> DataFrame:
    """Adds `works` to every item; empty when none matches."""
    text = F.concat_ws(" ", F.col(title), F.col(title_ko)) if title_ko in items.columns else F.col(title)
    texts = items.select(item_id, fold_title(F.coalesce(text, F.lit(""))).alias("_text"))
    found = match_works(texts, keywords, item_id, "_text")
    return items.join(found, item_id, "left").withColumn(
        "works", F.coalesce("works", F.array().cast("array<string>")))


def visible_aliases(items: DataFrame, works: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """(work_ord, name, aliases) of the works that some visible item matched."""
    words = keywords if keywords is not None else work_keywords(works)
    seen = items.select(F.explode("works").alias("work")).distinct()
    return (
        words.join(seen, "work", "left_semi")
        .groupBy("work_ord", "work")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("kw_ord", "keyword"))), lambda k: k["keyword"]).alias("aliases"))
        .withColumnRenamed("work", "name")
    )


def coverage(items: DataFrame) -> DataFrame:
    """total and unclassified counts of items carrying `works`."""
    return items.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("works") == 0).alias("unclassified"),
    )


def unmatched(items: DataFrame) -> DataFrame:
    return items.filter(F.size("works") == 0)
