"""Tables in the folder that all machines share, used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset: a local folder in local mode, else an error.

    On a cluster each machine would write to its own folder, and what is read back would lack rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridlark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def partitions(spark: SparkSession, size: int, block_bytes: int, most: int = 1 << 16) -> tuple[int, int]:
    """(blocks, partitions) for ``size`` bytes of text: blocks of ``block_bytes`` at any size, in ``most`` partitions at most.

    A task that has several blocks works on one after the other, so its memory is that of one block.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, size // (2 * block_bytes)))
    return max(2 * parts, size // block_bytes), parts


def freed(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more; a small job makes it forget the last one."""
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    A lost executor costs later stages nothing but a new read. The files go when the driver ends.
    """
    return saved_at(df)[0]


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridlark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of saved_at() that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_and_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows of a table and the UTF-8 bytes of its texts, measured; plans only guess these after a join."""
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    return got["n"], got["b"] or 0
