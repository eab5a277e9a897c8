"""SparkSession construction and session-level helpers.

The library never creates a session on its own inside operators; callers
pass one in.  ``build_session`` is for tests, the benchmark and scripts.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# the checkpoint folder in use, by application
_LOCAL_DIRS: dict[str, str] = {}
# how often an application's tables were dropped
_DROPS: dict[str, int] = {}
# applications whose executors have been sent the package
_SHIPPED: set[str] = set()
# rows a task sorts or joins, where a shuffle's tasks follow the input
SHUFFLE_ROWS = 500_000
# least size of a scan's split (Spark's cost of opening a file), where splits follow the rows
SPLIT_BYTES = 4 << 20

# Settings every job relies on.  Decimal and rounding semantics assume ANSI
# mode (Spark 4 default); the UTC zone makes timestamp -> date conversions of
# the driver tables match the DuckDB oracle.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of a DataFrame that is no longer referenced are removed
    # from the shared checkpoint folder instead of accumulating there
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "loanlens", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder, set once per context.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant
    folder and is used as is; a cluster session without it is an error.
    Only a local-mode session without it (tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(sc.applicationId)
    if not current:
        current = sc.getCheckpointDir()
    if not current:
        if sc.master != "local" and not sc.master.startswith("local["):
            # a machine-local folder would not survive the loss of a node
            raise RuntimeError("set spark.checkpoint.dir to a shared, fault-tolerant folder")
        current = tempfile.mkdtemp(prefix="loanlens-ckpt-")
    _LOCAL_DIRS[sc.applicationId] = current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def table_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the shared
    checkpoint folder.  ``drop_tables`` removes it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/loanlens-tables/{spark.sparkContext.applicationId}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint (a lost executor re-reads the files),
    but the readers keep column pruning and filter pushdown."""
    spark = df.sparkSession
    path = f"{table_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table ``store`` wrote for this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    app = spark.sparkContext.applicationId
    _DROPS[app] = _DROPS.get(app, 0) + 1


def drops(spark: SparkSession) -> int:
    """How often ``drop_tables`` ran; tables stored before are gone."""
    return _DROPS.get(spark.sparkContext.applicationId, 0)


def shuffle_tasks(spark: SparkSession, rows: int) -> int | None:
    """The tasks a shuffle of ``rows`` rows needs at ``SHUFFLE_ROWS`` each; None
    where those that the session plans anyway suffice.  A session's partitions
    are a fixed number, and small ones are merged down to the cores, so that
    without this a task's rows, and what it holds of them, grow with the input."""
    needed = -(-rows // SHUFFLE_ROWS)
    planned = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return needed if needed > planned else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over ``tasks`` partitions, which are not merged; as it is without a number."""
    return df.repartition(tasks, *keys) if tasks else df


def bounded_scans(spark: SparkSession, tables: list[tuple[DataFrame, int]]) -> None:
    """Lower the session's split size until a task reads about ``SHUFFLE_ROWS`` rows
    of each of these file tables (with their row counts); a row group is not split.

    A task that writes a shuffle of more partitions than
    ``spark.shuffle.sort.bypassMergeThreshold`` holds the rows of its split, and
    splits grow with the files up to ``spark.sql.files.maxPartitionBytes``."""
    sc = spark.sparkContext
    conf, jvm = sc._jsc.hadoopConfiguration(), sc._jvm
    for table, rows in tables:
        if rows > SHUFFLE_ROWS:
            paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in table.inputFiles()]
            length = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
            _lower(spark, "spark.sql.files.maxPartitionBytes", max(SPLIT_BYTES, length * SHUFFLE_ROWS // rows))


def _lower(spark: SparkSession, key: str, most: int) -> None:
    """Set a size or number to ``most`` where the session's own is higher or none."""
    text = str(spark.conf.get(key)).lower().removesuffix("b") or "0"
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    now = int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def small_arrow_batches(spark: SparkSession, megabytes: int = 8, records: int = 2000) -> None:
    """Hand rows to Python in batches of at most this size (the session's own
    limits where they are lower): with Spark's 64 MB a task holds several
    hundred MB of batches on both sides when rows are long."""
    _lower(spark, "spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)
    _lower(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", records)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loanlens-zip-"), "loanlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("loanlens", os.path.relpath(path, root)))
    sc.addPyFile(archive)          # served by the driver, so no shared folder is needed
    _SHIPPED.add(sc.applicationId)
