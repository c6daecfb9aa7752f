"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where driver and tasks are one process (``local`` masters: tests, a laptop) and the
    setting is missing, a temporary folder is made; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir")
    if not path and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        path = sc._quarry_dir = getattr(sc, "_quarry_dir", None) or tempfile.mkdtemp(prefix="quarry-")
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    """Partitions for a keyed exchange: what the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_texts(docs: DataFrame) -> DataFrame:
    """Just ``doc_id`` (long) and ``text``; other columns, whatever their names, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Give memory that a worker has freed back to the system; a worker lives on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)
