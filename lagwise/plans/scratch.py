"""Tables written in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage: it survives the loss of any executor, is computed once however often
it is read, and is compressed and columnar, which a checkpointed RDD is not.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this run. Where the setting is absent one is made here, in local mode (tests) only: executors elsewhere could not read it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="lagwise-")
            spark.sparkContext.setCheckpointDir(base)
    if base.startswith("/"):
        base = "file://" + base
    path = f"{base.rstrip('/')}/lagwise-{_RUN}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is already gone at interpreter exit
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table; with ``by``, in one folder for each of that column's values."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
