"""Helpers of the training-data operators.

The operators work on content rows: `content_id` names the row, `summary` is its text. Only these columns are read unless a
docstring says otherwise. Operators that add columns keep the other columns of a row; a column of the same name as an added one
is replaced. A null `summary` counts as an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from listing_lake.session import materialize

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CONTENT = StructType([StructField("content_id", LongType()), StructField("summary", StringType())])


def as_content(documents: DataFrame) -> DataFrame:
    """The given documents as content rows."""
    return documents.select(F.col("doc_id").alias("content_id"), F.col("text").alias("summary"))


def text(name: str = "summary") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(value: Column) -> Column:
    """Runs of anything but ASCII blanks, in order."""
    return F.array_remove(F.split(value, BLANK_RUN), "")


def count_of(value: Column, characters: str) -> Column:
    """How many of the given ASCII characters a text holds."""
    those = "".join(f"\\x{ord(c):02X}" for c in characters)
    return F.length(F.regexp_replace(value, f"[^{those}]+", "")).cast("long")


def lower_ascii(value: Column) -> Column:
    """A-Z in lower case, other letters as they are; ASCII texts take the fast way."""
    return F.when(F.octet_length(value) == F.length(value), F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(value: Column) -> Column:
    """The value as it is, in a form that filters are not pushed through: else a filter on it would compute it anew, once per use."""
    return F.when(F.spark_partition_id() >= 0, value)


def pack(content: DataFrame, *added: str) -> tuple[DataFrame, list[Column]]:
    """Id, text and the remaining columns as one struct `others`, and the columns that unpack it again.

    Whatever names the table uses, they cannot meet those of an operator in between; columns named as one of `added` are left out.
    """
    taken = {"content_id", "summary", *added}
    others = [c for c in content.columns if c.lower() not in taken]
    struct = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    packed = content.select("content_id", text().alias("summary"), struct.alias("others"))
    return packed, [F.col("others").getField(c).alias(c) for c in others]


def number_rows(rows: DataFrame, *order: str, name: str = "row_number") -> tuple[DataFrame, int]:
    """The rows with their gapless place from 0 in the given order, and their number.

    Ranges of the order go to tasks, each row knows its place within its range, and only the counts of the ranges are
    gathered (one number per task). No task sees more than its range; rows equal in the whole order may swap places.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    width = 1 << 33
    sizes = placed.groupBy(F.shiftright("_place", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()
    starts, total = [], 0
    for part in sizes:
        starts.append((part["range"], total))
        total += part["n"]
    before = spark.createDataFrame(starts or [(0, 0)], "_range long, _before long")
    numbered = (
        placed.withColumn("_range", F.shiftright("_place", 33))
        .join(F.broadcast(before), "_range")
        .withColumn(name, F.col("_before") + F.pmod(F.col("_place"), F.lit(width)))
        .drop("_range", "_before", "_place")
    )
    return numbered, total
