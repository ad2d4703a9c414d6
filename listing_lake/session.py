"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings: results depend on the first two, the rest bound task memory.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Korean page bytes need the wide Java charset list (x-windows-949).
    "spark.sql.legacy.javaCharsets": "true",
    # Bytes a charset cannot read become replacement marks instead of failing the job.
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Whole pages travel to the shredder, so the batch is bounded by bytes and by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Keys seen by streams need not fit in memory; state with timers asks for it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Lets Spark delete the shuffle files of a query when it ends, not when the driver's garbage is collected.
DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Largest driver-made table that may be broadcast without asking the optimiser.
BROADCAST_ROWS = 5_000

# Rows of a task when every row becomes a page or a card: a millisecond or so each.
PAGE_ROWS = 10_000

# Rows of a task when a row is a few numbers.
NARROW_ROWS = 100_000


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_listing_lake_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="listing_lake_src_")) / "listing_lake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._listing_lake_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere, and give its executors this package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("listing_lake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture per column operation costs more than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: `spark.checkpoint.dir` of the cluster.

    Only a local master may do without: it gets one temporary folder per application, kept beside the context because the setting
    cannot be changed in a running session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    if not getattr(context, "_listing_lake_dir", None):
        context._listing_lake_dir = tempfile.mkdtemp(prefix="listing_lake_")
    return context._listing_lake_dir


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """A freshly read table split over all cores when its files give fewer splits; many splits stay as they are.

    Rows that become pages or cards are few bytes with much work each: `task_rows` bounds how many meet in a task, so tasks grow in
    number with the table, not in length. Counting a freshly read table reads no column.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        tasks = max(tasks, -(-df.count() // task_rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write an intermediate result once to the shared folder and go on from the written table.

    Cuts the lineage for work that several later steps read, outlives lost executors and keeps column pruning. The shuffle files of
    the write go with it: nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DELETE_SHUFFLES, "false")
    spark.conf.set(DELETE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DELETE_SHUFFLES, before)
    written = spark.read.parquet(path)
    written._written_to = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete steps that `materialize` wrote, once everything made from them is written itself: a later read fails."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A result of at most about `rows` short rows in as many tasks as they need, however many partitions a shuffle has.

    Else a step of a few rows is written as one small file per shuffle partition.
    """
    return df.coalesce(max(1, -(-int(rows) // NARROW_ROWS)))


def small_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A driver-made dimension, marked for broadcast only while its row count is small."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
