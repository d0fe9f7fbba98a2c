"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "textguard", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or create) a session with the settings the operators assume.

    On a cluster the master and most settings come from spark-submit; the values here
    only fill in what is unset. The UI stays off: nothing here needs a web server.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # Local mode runs everything in the driver JVM.
            builder = builder.config("spark.driver.memory", os.environ.get("TEXTGUARD_DRIVER_MEMORY", "8g"))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session (set by the cluster). Only when it
    is unset - local runs and tests - a private folder is created and registered.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if conf:
        if not current:
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="textguard-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, for clusters on which it is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_textguard_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="textguard-package-")  # read by the driver only: Spark serves the file to executors
    archive = shutil.make_archive(os.path.join(folder, "textguard"), "zip", os.path.dirname(package), os.path.basename(package))
    sc.addPyFile(archive)
    sc._textguard_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: what it drew or computed stays fixed."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
