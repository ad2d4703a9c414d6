"""The queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from listing_lake.session import configure, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Every time-dependent query looks at the tables from this moment.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    if name in ("pages", "documents"):
        # Few rows with much work each.
        df = spread(df)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


# --- SQL pieces shared by the oracles -----------------------------------------------------------
TRACKING_SQL = (
    "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','utm_source_platform',"
    "'utm_creative_format','utm_marketing_tactic','fbclid','gclid','dclid','msclkid')"
)


def norm_sql(url: str) -> str:
    """A normalised http(s) URL of an absolute link, for hosts without a shop rule; null for anything else."""
    kept = (
        f"array_to_string(list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), "
        f"lambda x: lower(url_decode(split_part(x, '=', 1))) NOT IN {TRACKING_SQL}), '&')"
    )
    return (
        f"(CASE WHEN regexp_matches({url}, '^https?://[^/?#@]+') THEN regexp_extract({url}, '^https?://') || "
        f"lower(regexp_extract({url}, '^https?://([^/?#]*)', 1)) || regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1) || "
        f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END)"
    )


def squish_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


HOST_SQL = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
