"""Results between steps, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import AtomicType

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Without that setting a local master (tests) gets a temporary folder, and a cluster an error.

    Folders made here are deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        _made.append((spark, base))
    path = f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over as many tasks as the session has partitions, for work that is heavy for the bytes it reads: Spark would read small files and shuffles in one task."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *plain)


class Stage:
    """A stored DataFrame: its lineage is cut, so what was computed survives the loss of any executor."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, shared_dir(df.sparkSession)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once nothing reads them any more."""
        delete_path(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    return Stage(df).df
