"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import ship_package

__all__ = ["crc_class", "discard", "fresh", "saved", "shared_dir", "ship_package", "table", "text_or_empty", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; every executor must see it.

    Only a local session without the setting (tests) gets the warehouse folder
    instead, which the driver and its threads share; on a cluster the missing
    setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = spark.conf.get("spark.sql.warehouse.dir")
    return d.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the files.  Unlike
    ``checkpoint()`` the plan above runs once and the files are compressed and
    column-pruned on reading.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files behind ``saved`` tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_saved_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` is
    called so (in any case), for columns that live inside one operator only."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
        taken.add(n.lower())
    return out


def tidy() -> None:
    """Gives a Python worker's freed memory back to the system at the end of a task:
    workers live on from stage to stage, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def text_or_empty(col: str = "text"):
    """The text, '' where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_class(key, parts: int):
    """crc32 of the key written as text, modulo ``parts`` (a null key: -1)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(-1))
