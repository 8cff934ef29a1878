"""Session settings, shared scratch folder and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarrylog", cores: str = "8", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRYLOG_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares between executors.

    ``spark.checkpoint.dir`` names it. A machine-local folder is made only for
    a local master, where driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="quarrylog-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so a lost executor costs no re-run.

    A written table (not a checkpointed RDD) keeps column pruning and file
    statistics for whatever reads it next.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Shuffle files go when the statement has ended; workers get rows with packed columns in smaller batches.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """For plans that are run once, inside: little is kept of them."""
    before = {key: spark.conf.get(key) for key in LEAN}
    try:
        for key, value in LEAN.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``cut_lineage`` for a plan that is run this once; and what removes the files, when nothing reads them any more."""
    spark = df.sparkSession
    path = new_shared_path(spark, "cut")
    with lean(spark):
        df.write.parquet(path)

    def forget() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), forget


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written once in buckets of ``key``, so that joins on it move only the other side; and what takes the table out of the catalog.

    ``df`` should be dealt out by ``repartition(buckets, key)`` already: a bucket is then one file.
    """
    spark = df.sparkSession
    name = f"quarrylog_bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", new_shared_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE {name}")


#: State on disk; without preallocated files, of which every state partition would hold several megabytes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state on disk; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    for key, value in STATE.items():
        own.conf.set(key, value)
    return own
