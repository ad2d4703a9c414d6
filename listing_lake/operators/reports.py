"""Run reports and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# --- fixed values: must equal the stored data's rules -------------------------------------------
SOURCE_TYPES = ("rss", "html", "json_api", "local_browser", "figurefarm")
COUNTS = ("processed", "inserted", "existing", "updated", "failed")
DISABLED_REASON = "비활성화"
MANUAL_REASON = "수동 전용"
TYPE_REASON = "지원하지 않는 수집 방식: "
TOTAL = "TOTAL"
SHOWN_ERRORS = 2
# ------------------------------------------------------------------------------------------------


def is_manual(manual_only: Column, local_only: Column) -> Column:
    return F.coalesce(manual_only, F.lit(False)) | F.coalesce(local_only, F.lit(False))


def split_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(automatic, manual)."""
    manual = is_manual(F.col("manual_only"), F.col("local_only"))
    return sources.filter(~manual), sources.filter(manual)


def eligibility(sources: DataFrame, allow_manual: bool = False) -> DataFrame:
    """Adds `skip_reason`, null for a source that runs, and `counts_as_failed`."""
    unknown = ~F.coalesce(F.col("type").isin(*SOURCE_TYPES), F.lit(False))
    manual = is_manual(F.col("manual_only"), F.col("local_only")) & F.lit(not allow_manual)
    enabled = F.coalesce("enabled", F.lit(True))
    reason = (
        F.when(~enabled, F.lit(DISABLED_REASON)).when(manual, F.lit(MANUAL_REASON))
        .when(unknown, F.concat(F.lit(TYPE_REASON), F.coalesce("type", F.lit("None"))))
    )
    return sources.withColumn("skip_reason", reason).withColumn(
        "counts_as_failed", enabled & ~manual & unknown)


def run_report(rows: DataFrame, group: str = "source") -> DataFrame:
    """Counters per source and in total.

    `rows` has one row per processed item with 0/1 columns inserted, existing, updated and failed.
    """
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in COUNTS[1:]]
    return rows.rollup(group).agg(F.count(F.lit(1)).alias("processed"), F.grouping(group).alias("_g"), *sums).select(
        F.when(F.col("_g") == 1, F.lit(TOTAL)).otherwise(F.col(group)).alias(group), *COUNTS)


def error_summary(errors: DataFrame, group: str = "source", message: str = "message", order: str = "seq") -> DataFrame:
    """(group, note): the run's reason when there is one, else the first two messages and how many more.

    Two rows per group survive the map side, so the messages of a group are never gathered.
    """
    by_group = Window.partitionBy(group).orderBy(order)
    first = errors.withColumn("_n", F.row_number().over(by_group)).filter(F.col("_n") <= SHOWN_ERRORS)
    shown = first.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", message))), lambda x: x[message]), "; ").alias("shown"),
        F.count(F.lit(1)).alias("n_shown"),
    )
    reason = F.max("reason") if "reason" in errors.columns else F.lit(None).cast("string")
    totals = errors.groupBy(group).agg(F.count(F.lit(1)).alias("n"), reason.alias("reason"))
    more = F.col("n") - F.col("n_shown")
    text = F.when(more > 0, F.concat("shown", F.lit(" 외 "), more.cast("string"), F.lit("건"))).otherwise(F.col("shown"))
    blank = F.col("reason").isNull() | (F.col("reason") == "")
    return totals.join(shown, group).select(group, F.when(blank, text).otherwise(F.col("reason")).alias("note"))
