"""Lines that many content rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.llm.common import BLANKS, lower_ascii, pack


def _lines(value: Column) -> Column:
    return F.split(value, "\n")


def line_keys(value: Column, min_chars: int) -> Column:
    """A hash per line of the text, null for a line whose key is too short to count."""
    def key(line: Column) -> Column:
        bare = lower_ascii(F.trim(line, F.lit(BLANKS)))
        return F.when(F.length(bare) >= min_chars, F.xxhash64(bare))

    return F.transform(_lines(value), key)


def drop_shared_lines(content: DataFrame, min_chars: int = 20, min_rows: int = 3) -> DataFrame:
    """Removes lines that stand in at least `min_rows` different content rows, except in the row with the largest id.

    A line's key is the line without ASCII blanks at its ends and with A-Z in lower case; keys shorter than `min_chars` code
    points are never removed. Keys are exploded and hashed, each hash counts its distinct ids in two steps (per hash and id, then per
    hash), and the hashes found go back only to the rows that lose them, as line positions. The other lines are put together again by
    position.

    Adds `n_lines` (before), `n_dropped`, and replaces `summary` by what is left. A null or empty summary is one empty line.
    Rows without an id neither count nor lose lines. Rows that share an id are one row of the count, and each loses its own
    lines. No rows give no rows.
    """
    rows, others = pack(content, "n_lines", "n_dropped")
    # The text's own hash tells rows of one id apart.
    rows = rows.withColumn("version", F.xxhash64("summary"))
    found = (
        rows.where(F.col("content_id").isNotNull())
        .select("content_id", "version", F.posexplode(line_keys(F.col("summary"), min_chars)).alias("line_pos", "line_hash"))
        .where(F.col("line_hash").isNotNull())
    )
    shared = (
        found.groupBy("line_hash", "content_id").agg(F.lit(1).alias("one"))
        .groupBy("line_hash").agg(F.count("*").alias("n_rows"), F.max("content_id").alias("kept_in"))
        .where(F.col("n_rows") >= min_rows)
        .select("line_hash", "kept_in")
    )
    # A hash of a third of all rows is split by the skew join; its rows only pass through.
    lost = (
        found.join(shared, "line_hash")
        .where(F.col("content_id") != F.col("kept_in"))
        .groupBy("content_id", "version")
        .agg(F.collect_set("line_pos").alias("lost"))
    )
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost")), lambda i: F.get(F.col("lines"), i)
    )
    return (
        rows.join(lost, ["content_id", "version"], "left")
        .withColumn("lines", _lines(F.col("summary")))
        .select(
            "content_id",
            F.when(F.col("lost").isNull(), F.col("summary")).otherwise(F.array_join(kept, "\n")).alias("summary"),
            *others,
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        )
    )
