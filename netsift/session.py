"""Session helpers: what every job of this package expects from its Spark session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings a job may rely on; only set where the session has no explicit value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone (hour-of-day rules depend on it) and make sure AQE is on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Hand rows to Python a few megabytes at a time, unless the session says how many.

    By default a batch is 10,000 rows, whatever their length; of whole texts that is a buffer of tens of megabytes on
    both sides of every task, each way.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(megabytes << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: what the cluster names in ``spark.checkpoint.dir``.

    Where nothing is named, the warehouse folder is used, which driver and executors share as well. Everything goes
    into one folder of the application, which :func:`remove_intermediates` (also at exit) deletes.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.conf.get("spark.sql.warehouse.dir")
    own = f"{folder.rstrip('/')}/netsift-{sc.applicationId}"
    if own not in _used:
        _used.add(own)
        atexit.register(remove_intermediates, spark, own)
    return own


_used: set[str] = set()


def remove_intermediates(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the application's intermediate tables; results that still read them must be written before."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder or shared_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended first; the folder's name tells whose it was
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed or share the driver's working folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="netsift-"), "netsift.zip")  # the driver serves it from here
    with zipfile.ZipFile(target, "w") as out:
        for base, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.join("netsift", os.path.relpath(full, root)))
    sc.addPyFile(target)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a table into the shared folder and go on from there.

    Computed once, survives lost executors, and its size is known to the planner afterwards.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
