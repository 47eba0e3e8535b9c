"""Reading tables, and tables written between the stages of an operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a lookup table is broadcast. Every use counts the rows of a written table first; above it the join shuffles.
BROADCAST_ROWS = 200_000

_own_folder: str | None = None
_shipped: set[str] = set()
_kept: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application: their Python finds it wherever the driver's program was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="darkslide-package-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "darkslide.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, as in local tests, a temporary one."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="darkslide-")
        atexit.register(shutil.rmtree, _own_folder, True)
    return f"file://{_own_folder}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation, and its size is known.

    The tables of an application share a folder, which goes when the application ends: a DataFrame that is returned may read them until then.
    """
    spark = df.sparkSession
    ship(spark)
    folder = f"{shared_folder(spark)}/darkslide-{spark.sparkContext.applicationId}"
    if folder not in _kept:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(hadoop)
        system.deleteOnExit(hadoop)
        _kept.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a few small files would otherwise keep a stage of heavy work on a few of them."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_enough(rows: int) -> bool:
    return rows <= BROADCAST_ROWS
