"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may go without one and then gets a temporary folder."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or _own.get(sc.applicationId):
        return found.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="barloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _own[sc.applicationId] = made = "file://" + folder
    return made


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared folder; clear_written() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: made once, however often it is read, and safe from lost executors. It stays until clear_written()."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Delete what operators have written for this application. For the caller, once results that read it are used."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
