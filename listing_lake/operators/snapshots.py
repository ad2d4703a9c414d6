"""The stored content table: hash buckets that are written anew only where they change, and commits that never overwrite each other.

A table is a folder: `data/<generation>/bucket=<n>` holds the rows of one bucket as one writer left them, and `_commits/<version>.json`
names the generation of every bucket. A row's bucket comes from its normalised URL, so all documents of a URL lie together and a
merge is a join within buckets. Files are never changed: a writer puts new generations of the buckets it touches beside the old
ones and then tries to create the next version's file, which succeeds for one writer only.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import datetime
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listing_lake.functions import urls
from listing_lake.operators import store
from listing_lake.session import materialize

BUCKETS = 64
# Rows are stored with the URL they are known by, and the key that deals them to buckets: that URL, else their own id.
STORED = {**store.CONTENT, "url_norm": "string", "row_key": "string"}
STORED_DDL = ", ".join(f"`{name}` {kind}" for name, kind in STORED.items())


@dataclass(frozen=True)
class Version:
    """One state of a table: the folder of every non-empty bucket, and the last batch of every stream that wrote to it."""

    number: int = -1
    n_buckets: int = BUCKETS
    folders: dict[int, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"version": self.number, "n_buckets": self.n_buckets, "folders": self.folders, "streams": self.streams})

    @staticmethod
    def from_json(text: str) -> Version:
        raw = json.loads(text)
        return Version(raw["version"], raw["n_buckets"], {int(b): f for b, f in raw["folders"].items()}, raw["streams"])

    def changed_since(self, older: Version) -> set[int]:
        return {b for b in self.folders.keys() | older.folders.keys() if self.folders.get(b) != older.folders.get(b)}


# --- files --------------------------------------------------------------------------------------
def _path(spark: SparkSession, path: str):
    """(file system, path) of a location in any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, where = _path(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def _read(spark: SparkSession, path: str) -> str:
    files, where = _path(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _path(spark, path)
    files.delete(where, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text, unless it exists; says whether this call made it.

    The text goes to a file of its own, which then takes the name by a rename that refuses an existing target: one atomic step on HDFS
    and stores like it. The local file system's rename would replace the target, so there a hard link takes the name.
    """
    files, target = _path(spark, path)
    files.mkdirs(target.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    scheme = files.makeQualified(target).toUri().getScheme()
    try:
        if scheme == "file":
            os.link(_local(files, draft), _local(files, target))
        else:
            fs = spark._jvm.org.apache.hadoop.fs
            options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
            options[0] = fs.Options.Rename.NONE
            fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        files.delete(draft, False)


def _local(files, where) -> str:
    return unquote(urlsplit(files.makeQualified(where).toUri().toString()).path)


# --- versions -----------------------------------------------------------------------------------
def _commit_path(root: str, number: int) -> str:
    return f"{root}/_commits/{number:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-len(".json")]) for n in _names(spark, f"{root}/_commits") if n.endswith(".json") and not n.startswith(".")]


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version of the table, by default the latest; a table that does not exist is empty."""
    if number is None:
        known = versions(spark, root)
        if not known:
            return Version()
        number = known[-1]
    return Version.from_json(_read(spark, _commit_path(root, number)))


def publish(spark: SparkSession, root: str, version: Version) -> bool:
    """Make this the table's state, unless another writer already made a version of that number."""
    return create_once(spark, _commit_path(root, version.number), version.to_json())


def read_content(spark: SparkSession, root: str, category: str | None = None, version: int | None = None) -> DataFrame:
    """The content of the latest or the given version; rows of a category lie together in every bucket, so others are mostly skipped."""
    state = read_version(spark, root, version)
    if not state.folders:
        return spark.createDataFrame([], store.CONTENT_DDL)
    folders = [f"{root}/data/{state.folders[b]}" for b in sorted(state.folders)]
    rows = store.conform(spark.read.schema(STORED_DDL).parquet(*folders))
    return rows.filter(F.col("storage_category") == category) if category else rows


# --- buckets ------------------------------------------------------------------------------------
def with_keys(content: DataFrame) -> DataFrame:
    """Content rows as they are stored."""
    keyed = store.conform(content).withColumn("url_norm", urls.normalize_url(F.col("url")))
    return keyed.withColumn("row_key", F.coalesce("url_norm", "content_id"))


def bucket_of(key: Column, n_buckets: int) -> Column:
    """The bucket Spark's own bucketed scan and shuffle by `row_key` expect."""
    return F.pmod(F.hash(key), F.lit(n_buckets))


def _write_buckets(rows: DataFrame, root: str, n_buckets: int) -> dict[int, str]:
    """Write rows as a new generation and return the folder of every bucket that got rows."""
    spark, generation = rows.sparkSession, uuid.uuid4().hex
    table = f"listing_lake_{generation}"
    try:
        (
            rows.withColumn("bucket", bucket_of(F.col("row_key"), n_buckets)).select(*STORED, "bucket")
            .write.format("parquet").partitionBy("bucket").bucketBy(n_buckets, "row_key").sortBy("storage_category", "row_key")
            .option("path", f"{root}/data/{generation}").saveAsTable(table)
        )
    finally:
        # The table only carries the bucketing of the writer; its files stay.
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    found = [n for n in _names(spark, f"{root}/data/{generation}") if n.startswith("bucket=")]
    return {int(n[len("bucket="):]): f"{generation}/{n}" for n in found}


@contextmanager
def open_buckets(spark: SparkSession, root: str, state: Version, buckets: list[int]) -> Iterator[DataFrame]:
    """Some buckets of a version as a bucketed table: joins and groupings by `row_key` need no shuffle of it.

    The table lives in the session's catalog while the block runs; its partitions are the folders the version names.
    """
    table = f"listing_lake_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} ({STORED_DDL}, bucket int) USING parquet PARTITIONED BY (bucket) "
        f"CLUSTERED BY (row_key) SORTED BY (storage_category, row_key) INTO {state.n_buckets} BUCKETS LOCATION '{root}/data/_none'")
    try:
        live = [b for b in sorted(buckets) if b in state.folders]
        for at in range(0, len(live), 500):
            parts = " ".join(f"PARTITION (bucket={b}) LOCATION '{root}/data/{state.folders[b]}'" for b in live[at:at + 500])
            spark.sql(f"ALTER TABLE {table} ADD {parts}")
        yield spark.table(table).drop("bucket")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


# --- writers ------------------------------------------------------------------------------------
class Conflict(Exception):
    """Other writers kept committing to the same buckets."""


def _commit(
    spark: SparkSession, root: str, attempt: Callable[[Version], tuple[set[int], dict[int, str]] | None], attempts: int,
    stream: str | None = None, batch_id: int | None = None, n_buckets: int = BUCKETS,
) -> bool:
    """Run `attempt` on the latest version until its result is published; false if the batch is in already.

    `attempt` returns the buckets it depends on and the folders that replace them. Where another writer was faster but touched
    other buckets only, the same folders are published on top of its version; else they are deleted and the work is done anew.
    """
    for _ in range(attempts):
        base = read_version(spark, root)
        if base.number < 0:
            # The first version fixes the number of buckets; losing this race is fine.
            publish(spark, root, Version(0, n_buckets))
            base = read_version(spark, root)
        if stream is not None and base.streams.get(stream, -1) >= batch_id:
            return False
        touched, folders = attempt(base)
        state = base
        while True:
            streams = state.streams | ({stream: batch_id} if stream is not None else {})
            kept = {b: f for b, f in state.folders.items() if b not in touched}
            if publish(spark, root, replace(state, number=state.number + 1, folders=kept | folders, streams=streams)):
                return True
            state = read_version(spark, root)
            again = stream is not None and state.streams.get(stream, -1) >= batch_id
            if again or state.changed_since(base) & touched:
                break
        for generation in {f.split("/")[0] for f in folders.values()}:
            _delete(spark, f"{root}/data/{generation}")
    raise Conflict(f"{root}: no commit in {attempts} attempts")


def write_content(content: DataFrame, root: str, n_buckets: int = BUCKETS, attempts: int = 5) -> None:
    """Replace the whole table, for a first load or a rewrite; the rows are shuffled once, to their buckets."""
    spark = content.sparkSession

    def attempt(base: Version) -> tuple[set[int], dict[int, str]]:
        rows = with_keys(content).repartition(base.n_buckets, "row_key")
        return set(range(base.n_buckets)), _write_buckets(rows, root, base.n_buckets)

    _commit(spark, root, attempt, attempts, n_buckets=n_buckets)


def merged_rows(stored: DataFrame, result: DataFrame, now: Column) -> DataFrame:
    """Stored rows with the changes of `store.outcome` applied, and the rows it adds.

    `stored` is bucketed by `row_key` and stays where it is: only the changes, one row per URL, are dealt to its buckets.
    """
    names = [f.name for f in result.schema["product"].dataType.fields]
    changes = result.filter("content_id is not null").select(
        F.col("url_norm").alias("row_key"), F.struct(F.col("content_id").alias("target"), "product").alias("_change"))
    mine = F.col("_change.target") == F.col("content_id")
    updated = stored.join(changes, "row_key", "left").withColumns(
        {name: F.coalesce(F.when(mine, F.col(f"_change.product.{name}")), F.col(name)) for name in names})
    added = with_keys(store.inserted_rows(result, now))
    return updated.select(*STORED).unionByName(added.select(*STORED))


def merge(
    spark: SparkSession, root: str, candidates: DataFrame, now: datetime, seq: list[str], stream: str | None = None, batch_id: int | None = None,
    n_buckets: int = BUCKETS, attempts: int = 5,
) -> DataFrame | None:
    """Merge candidates into the table, writing only the buckets that change; returns the outcome per URL, or None for a known batch.

    The rules are those of `store.merge_content`. A batch named by `stream` and `batch_id` is merged once, however often it is given.
    """
    staged = materialize(store.stage(candidates, seq), "staged")
    moment = F.lit(now).cast("timestamp")
    found: dict[str, DataFrame] = {}

    def attempt(base: Version) -> tuple[set[int], dict[int, str]]:
        where = bucket_of(F.col("url_norm"), base.n_buckets)
        asked = [r[0] for r in staged.select(where.alias("b")).distinct().collect()]
        with open_buckets(spark, root, base, asked) as stored:
            targets = store.pick_canonical(stored.filter("url_norm is not null").select("content_id", "doc_id", F.col("row_key").alias("url_norm")))
            found["result"] = result = materialize(store.outcome(staged, targets), "outcome")
            changed = [r[0] for r in result.filter("inserted > 0 or updated > 0").select(where.alias("b")).distinct().collect()]
        # What is read decides what is written, so all buckets asked count as touched; those that do not change keep their folders.
        kept = {b: base.folders[b] for b in asked if b not in changed and b in base.folders}
        if not changed:
            return set(asked), kept
        hit = result.withColumn("_bucket", where).filter(F.col("_bucket").isin(changed)).drop("_bucket")
        with open_buckets(spark, root, base, changed) as stored:
            return set(asked), kept | _write_buckets(merged_rows(stored, hit, moment), root, base.n_buckets)

    return found["result"] if _commit(spark, root, attempt, attempts, stream, batch_id, n_buckets) else None


def rewrite(spark: SparkSession, root: str, hit: Column, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> None:
    """Apply `change` to the buckets that hold a row with `hit`, as for a purge or a backfill. `change` keeps URLs and ids."""
    def attempt(base: Version) -> tuple[set[int], dict[int, str]]:
        with open_buckets(spark, root, base, list(base.folders)) as stored:
            found = [r[0] for r in stored.filter(hit).select(bucket_of(F.col("row_key"), base.n_buckets).alias("b")).distinct().collect()]
        if not found:
            return set(), {}
        with open_buckets(spark, root, base, found) as stored:
            return set(found), _write_buckets(change(stored).select(*STORED), root, base.n_buckets)

    _commit(spark, root, attempt, attempts)


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Delete versions before the last `keep` and the folders only they name; returns how many folders went.

    Generations that no version names may belong to a writer at work and stay; a writer removes its own when it loses.
    """
    known = versions(spark, root)
    old, live = known[:-keep], known[-keep:]
    used = {f for v in live for f in read_version(spark, root, v).folders.values()}
    gone = {f for v in old for f in read_version(spark, root, v).folders.values()} - used
    for folder in sorted(gone):
        _delete(spark, f"{root}/data/{folder}")
    for v in old:
        _delete(spark, _commit_path(root, v))
    return len(gone)
