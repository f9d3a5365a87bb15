"""Cutting the lineage of loops."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset: a local folder in local mode, else an error.

    On a cluster each machine would write to a folder of its own, and reads would miss rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridlark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint in shared_folder()."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


class Table:
    """A loop's table: Parquet files in shared_folder(), which go when a round replaces them, or with the driver."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, None
        self.replace(df)

    def _file(self) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def replace(self, df: DataFrame) -> None:
        """Write ``df``, which may read the table as it was, and let Spark drop the shuffle files of rounds before."""
        path, last = f"{shared_folder(self.spark)}/gridlark/{uuid.uuid4().hex}", self.path
        df.write.parquet(path)
        if last:
            self.remove()
        self.path, self.df = path, self.spark.read.schema(df.schema).parquet(path)
        system, at = self._file()
        system.deleteOnExit(at)

    def remove(self) -> None:
        system, at = self._file()
        system.delete(at, True)
