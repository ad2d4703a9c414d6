"""Reproducible shuffle of the content table into shards of equal row counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from listing_lake.llm.common import number_rows, text

ROUNDS = 6


def _sides(total: int) -> tuple[int, int]:
    """Two factors whose product is the least rectangle over the row numbers."""
    left = max(1, int(np.ceil(np.sqrt(total))))
    return left, max(1, -(-total // left))


def _mix(value: np.ndarray, key: int) -> np.ndarray:
    """The round function: a 64-bit avalanche of one half and the key of the round."""
    x = value.astype(np.uint64) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed * ROUNDS + r + 1], dtype=np.uint64), 0x9E3779B97F4A7C15)[0]) for r in range(ROUNDS)]


def _round_trip(position: np.ndarray, total: int, seed: int, back: bool) -> np.ndarray:
    """One pass of the network over the rectangle: halves are added in turn, modulo their side."""
    a, b = (np.uint64(s) for s in _sides(total))
    left, right = position // b, position % b
    keys = _keys(seed)
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if r % 2 == 0:
            step = _mix(right, keys[r]) % a
            left = (left + (a - step if back else step)) % a
        else:
            step = _mix(left, keys[r]) % b
            right = (right + (b - step if back else step)) % b
    return left * b + right


def permute(position: np.ndarray, total: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The place of each row number after the shuffle; `back` gives the row number of each place.

    A Feistel network permutes the rectangle of `_sides`, which has fewer than sqrt(total) + 1 numbers too many; a number that
    leaves the table walks on along its cycle until it is back inside, so that the numbers below `total` are permuted among
    themselves.
    """
    out = _round_trip(np.asarray(position, dtype=np.uint64), total, seed, back)
    outside = out >= np.uint64(total)
    while outside.any():
        out[outside] = _round_trip(out[outside], total, seed, back)
        outside = out >= np.uint64(total)
    return out.astype(np.int64)


def locate(row_number: int, total: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number, without reading any table."""
    place = int(permute(np.array([row_number]), total, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int:
    """The row number that lies in a slot: the inverse of `locate`."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= place < total):
        raise ValueError("no such slot")
    return int(permute(np.array([place]), total, seed, back=True)[0])


def shard_content(content: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Deals all content rows to shards of equal row counts, in a reproducible random order.

    Rows are numbered by (`content_id`, checksum, size), the number is permuted by `permute`, and place p lies in shard
    p mod `shards` at slot p div `shards`: row counts differ by one at most, slots have no gap, and any slot can be computed
    (`locate`, `row_at`). The law is `rows`: neither sizes nor a new shard count are honoured.

    Returns `content_id`, `size` (UTF-8 bytes + 1), `text_crc32`, `row_number`, `shard`, `slot`. A null id sorts first; a null
    summary has size 1 and the checksum of an empty text; repeated rows get a slot each; an empty table gives no rows; other
    columns are not returned.
    """
    rows = content.select(
        "content_id",
        (F.octet_length(text()) + 1).cast("long").alias("size"),
        F.crc32(text().cast("binary")).cast("long").alias("text_crc32"),
    )
    numbered, total = number_rows(rows, "content_id", "text_crc32", "size")

    @pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), total, seed))

    return (
        numbered.withColumn("_to", place("row_number"))
        .withColumn("shard", F.pmod("_to", F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"_to div {int(shards)}"))
        .drop("_to")
    )
