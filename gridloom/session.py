"""Session helpers: a builder for local runs, UTC pinning and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gridloom", master: str | None = None, shuffle_partitions: int | None = None, quiet: bool = False) -> SparkSession:
    """A session with the settings the operators are written for; a cluster supplies its own sizes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
    )
    if master:
        builder = builder.master(master)
    if quiet:
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Wall-clock arithmetic assumes a session zone without daylight saving."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is made only where it is unset and the master local."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gridloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application staged; call it when no frame built from it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), rows_a_file: int = 0) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage for frames that several jobs read (fits, sweeps), survives the loss of an executor and lets
    each reader prune columns and push filters. Rows of megabytes need few ``rows_a_file``: a reader holds thousands
    of rows of a file at once.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
