"""Session settings, shared storage and size-checked hand-overs to the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: largest row count a side may have to be shipped to every task
BROADCAST_ROWS = 10_000

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # rows can be whole pictures: keep the batches handed to Python small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "tilequery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    It is what the cluster names in ``spark.checkpoint.dir``. Only a local-mode
    session without that setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="tilequery-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored table.

    Cuts the lineage of iterative jobs and fixes values that several later jobs
    must agree on; a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path for an intermediate table of this application."""
    return f"{_scratch(spark)}/{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tilequery-{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed any more."""
    discard(spark, _scratch(spark))


def discard(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect rows whose number must not exceed ``limit``; more is an error."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows (reads no more than ``limit + 1``)."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; a larger side keeps the shuffle join."""
    return F.broadcast(df) if is_small(df, limit) else df


def inline_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a side once; when it has at most ``limit`` rows, go on with a broadcast copy.

    Larger results stay distributed and join by shuffle.
    """
    rows = df.take(limit + 1)
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
