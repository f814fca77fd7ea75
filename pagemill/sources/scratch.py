"""Tables that cut lineage: written to the folder the cluster names for checkpoints, removed when they are superseded or at the end."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written and not removed, in order.
_written: dict[str, None] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one of this machine only where the session names none and is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "pagemill-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    place, fs = _file(spark, path)
    fs.deleteOnExit(place)
    _written[path] = None
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by written() that no later result reads."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path and path in _written:
            _delete(df.sparkSession, path)


def remove_written(spark: SparkSession) -> int:
    """Delete all tables that written() has made, once no result needs them any more; how many there were."""
    count = len(_written)
    for path in list(_written):
        _delete(spark, path)
    return count


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, fs = _file(spark, path)
    fs.delete(place, True)
    _written.pop(path, None)
