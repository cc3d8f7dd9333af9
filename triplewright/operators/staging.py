"""Written intermediate tables in the cluster's shared folder: lineage ends there.

All folders of a driver lie in one folder of its own below spark.checkpoint.dir. Operators drop what nothing reads any more;
results that are not yet read need their tables, so the rest goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Shared folder -> this driver's folder below it.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and all runs on one machine (tests), below a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        root = f"{tempfile.gettempdir()}/triplewright-shared"
    root = root.rstrip("/")
    if root not in _OWN:
        if not _OWN:
            atexit.register(_clear)
        _OWN[root] = f"{root}/triplewright-{uuid.uuid4().hex}"
    return f"{_OWN[root]}/{uuid.uuid4().hex}"


def _delete(jvm, configuration, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(configuration).delete(target, True)


def drop_path(spark: SparkSession, path: str) -> None:
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _clear() -> None:
    jvm = SparkContext._jvm
    for path in _OWN.values():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(jvm, jvm.org.apache.hadoop.conf.Configuration(), path)


def stage(df: DataFrame, path: str | None = None, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lost executors cost no rework of what is before it. by: a text column of few values; who asks for one of them reads its files alone."""
    path = path or shared_dir(df.sparkSession)
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
