"""Whitespace, title normalisation and letter-script expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# What Python's str.split() and str.strip() treat as white space.
SPACE = r"[\s\x1c-\x1f]"
# The same as a list and as a class, which cost far less than a pattern with Unicode classes.
_SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE = r"[\x20\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# What Python's str.splitlines() splits on.
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LETTERS = r"[A-Za-zÀ-ɏ가-힣぀-ヿ㐀-鿿]"
_HANGUL = r"[가-힣]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value computed once.

    A column used twice is written twice into the plan, which multiplies when such expressions nest. A lambda over a
    one-element array names the value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are computed once, also when a filter follows: it would be moved below them with a copy of their expressions,
    but not below an exploded array."""
    made = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.explode(F.array(made)).alias("_once")).select(*df.columns, *[F.col(f"_once.{name}").alias(name) for name in values])


def extract(text: Column, pattern: Column, group: int) -> Column:
    """`regexp_extract` with a pattern that is itself a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def found(text: Column, pattern: Column) -> Column:
    """Whether a pattern column occurs in the text.

    Unlike `rlike`, this keeps the last compiled pattern, which pays when one pattern meets many rows.
    """
    return F.regexp_instr(text, pattern) > 0


def squish(c: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(c, f"{_SPACE}+", " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_SPACES))


def present(c: Column) -> Column:
    """True for a non-null, non-empty string."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def _folded(s: pd.Series, lower: Callable[[str], str]) -> pd.Series:
    # Python's split() knows the same white space as `SPACE`.
    return s.map(lambda v: None if v is None else " ".join(lower(unicodedata.normalize("NFKC", v)).replace(":", " ").split()))


@F.pandas_udf(StringType())
def _fold_title(s: pd.Series) -> pd.Series:
    return _folded(s, str.casefold)


@F.pandas_udf(StringType())
def _fold_search(s: pd.Series) -> pd.Series:
    return _folded(s, str.lower)


def fold_title(c: Column) -> Column:
    """NFKC, case fold, colon as a blank, blanks collapsed.

    One pass in Python: patterns over whole texts cost the JVM many times as much.
    """
    return _fold_title(c)


def fold_search(c: Column) -> Column:
    """The search-box form: as `fold_title` with lower case instead of case folding."""
    return _fold_search(c)


def hangul_share(c: Column) -> Column:
    """Share of Hangul among the letters of known scripts; null when there is no letter."""
    return let(
        F.regexp_count(c, F.lit(_LETTERS)),
        lambda letters: F.when(letters > 0, F.regexp_count(c, F.lit(_HANGUL)) / letters),
    )


def needs_translation(c: Column) -> Column:
    return F.coalesce(hangul_share(c) < 0.5, F.lit(False))


def utf8_limit(c: Column, max_bytes: int = 500) -> Column:
    """Cut to `max_bytes` bytes on a character boundary and drop trailing blanks."""
    whole = F.octet_length(c) <= max_bytes
    cut = F.make_valid_utf8(F.substring(c.cast("binary"), 1, max_bytes).cast("string"))
    return F.when(whole, c).otherwise(rstrip(F.regexp_replace(cut, "�$", "")))
