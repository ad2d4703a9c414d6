"""Streams over the tables' files, each run until its input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from listing_lake.operators import snapshots
from listing_lake.plans.registry import HOST_SQL, NOW, norm_sql, query
from listing_lake.session import configure, shared_dir
from listing_lake.functions import urls
from listing_lake.streaming import streams


def _stream(spark, sf: str, name: str) -> DataFrame:
    configure(spark)
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    rows = streams.read_stream(spark, sf, schema, f"{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _collect(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run the stream into a table of the shared folder and read it."""
    folder = _folder(spark, name)
    streams.run_available(stream, f"{folder}/checkpoint", streams.to_parquet(f"{folder}/out"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_daily_intake", """
WITH d AS (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS k, event_type FROM events)
SELECT strftime(k, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM d WHERE CAST(k AS TIMESTAMP) + INTERVAL 15 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2""")
def stream_daily_intake(spark, sf):
    return _collect(spark, streams.daily_intake(_stream(spark, sf, "events"), [F.col("event_type")], "ts", "2 hours"), "daily")


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    first = streams.first_seen_stream(_stream(spark, sf, "events"), ["user_id", "event_type"], "ts", "31 days")
    return _collect(spark, first.select("user_id", "event_type"), "first-seen")


@query("stream_refresh_due", """
WITH l AS (SELECT user_id, epoch_us(max(ts)) // 1000 AS last FROM events GROUP BY user_id)
SELECT user_id, last + 6 * 3600000 AS due_ms FROM l WHERE last + 6 * 3600000 < (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)""")
def stream_refresh_due(spark, sf):
    due = streams.refresh_due(_stream(spark, sf, "events"), "user_id", "ts", 6, "1 hour")
    return _collect(spark, due, "due").select("user_id", F.unix_millis("due_at").alias("due_ms"))


@query("stream_upsert", f"""
SELECT CASE WHEN length({HOST_SQL}) % 2 = 0 THEN 'GOODS:' ELSE 'ANIME:' END || sha256({norm_sql("url")}) AS content_id, 'NEW' AS status, max(page_id) AS price FROM pages GROUP BY 1""")
def stream_upsert(spark, sf):
    pages = _stream(spark, sf, "pages")
    host = urls.parts(F.col("url")).host
    rows = pages.select(
        F.col("page_id").alias("seq"), "url", F.lit("t").alias("title"), F.when(F.length(host) % 2 == 0, "GOODS").otherwise("ANIME").alias("category"),
        F.col("page_id").alias("price"))
    folder = _folder(spark, "upsert")
    streams.upsert_stream(rows, f"{folder}/content", f"{folder}/checkpoint", lambda: NOW, ["seq"], n_buckets=8)
    return snapshots.read_content(spark, f"{folder}/content").select("content_id", "status", "price")


@query("stream_upsert_two_sources", f"""
WITH p AS (SELECT page_id, {norm_sql("url")} AS u FROM pages),
g AS (SELECT u, min(page_id) FILTER (WHERE page_id % 2 = 0) AS even_id, min(page_id) AS first_id, max(page_id) AS last_id FROM p GROUP BY u)
SELECT CASE WHEN even_id IS NULL THEN 'ANIME:' ELSE 'GOODS:' END || sha256(u) AS content_id,
 CASE WHEN even_id IS NULL THEN 'b ' || first_id ELSE 'a ' || even_id END AS title, last_id + 1000 AS price FROM g""")
def stream_upsert_two_sources(spark, sf):
    """Two streams into one table: the second adds its own pages and renews the prices of the first's; a restart changes nothing."""
    pages, folder, number = _stream(spark, sf, "pages"), _folder(spark, "upsert-two"), F.col("page_id").cast("string")
    first = pages.filter("page_id % 2 = 0").select(
        F.col("page_id").alias("seq"), "url", F.concat(F.lit("a "), number).alias("title"), F.lit("GOODS").alias("category"), F.col("page_id").alias("price"))
    second = pages.select(
        F.col("page_id").alias("seq"), "url", F.concat(F.lit("b "), number).alias("title"), F.lit("ANIME").alias("category"),
        (F.col("page_id") + 1000).alias("price"))
    for rows, checkpoint in ((first, "first"), (second, "second"), (first, "first")):
        streams.upsert_stream(rows, f"{folder}/content", f"{folder}/{checkpoint}", lambda: NOW, ["seq"], n_buckets=8)
    return snapshots.read_content(spark, f"{folder}/content").select("content_id", "title", "price")
