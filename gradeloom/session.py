"""Session set-up and the shared folder for written intermediates."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"
SHIPPED = "spark.gradeloom.shipped"
_SHIPPING = threading.Lock()  # fits run in threads, and a file is added once only


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    with _SHIPPING:
        if spark.conf.get(SHIPPED, "") != app:
            root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
            folder = os.path.realpath(tempfile.mkdtemp(prefix="gradeloom-code-"))
            spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/gradeloom-code", "zip", root, "gradeloom"))
            spark.conf.set(SHIPPED, app)


def local_session(cores: int = 8, name: str = "gradeloom", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and measurements; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "4m")  # small files still keep all cores busy
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A session that names none gets a temporary folder only when it is local.
    """
    named = spark.conf.get(SHARED_DIR_KEY, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="gradeloom-")
    spark.conf.set(SHARED_DIR_KEY, made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path for one written table or one stream checkpoint."""
    return f"{shared_dir(spark)}/gradeloom/{label}-{uuid.uuid4().hex}"


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark resolves it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a table in shared storage.

    Ends the lineage where a result feeds several later steps: those read the
    table instead of repeating the work, also after executors are lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
