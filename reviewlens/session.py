"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "reviewlens", extra: dict | None = None) -> SparkSession:
    """A session tuned for the review workloads.

    AQE is on so that joins against per-store statistics become broadcasts
    only when their runtime size is under the threshold (a checked size), and
    so that a store holding a large share of all rows is split by skew-join
    handling instead of landing in one task.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 200),
        "spark.driver.memory": "16g",
        # checkpointed intermediates are deleted once no DataFrame refers to them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A directory is only created here when the session names none (tests and
    local runs); on a cluster the setting must point at shared storage.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core confs may be read-only at runtime
            pass
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where one intermediate feeds many outputs of a batch job: the data is
    written once, and a lost executor re-reads it instead of recomputing the
    whole upstream plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per context).

    Functions are pickled by module name, so the workers must be able to
    import the package wherever the driver was started from.
    """
    sc = spark.sparkContext
    if getattr(sc, "_reviewlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    # the zip is the driver's own copy: addPyFile serves it to the executors
    out = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}_{sc.applicationId}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.join(name, os.path.relpath(p, root)))
    sc.addPyFile(out)
    sc._reviewlens_shipped = True


def balance(df: DataFrame) -> DataFrame:
    """Spread an under-split input over the available cores.

    A scan of a few large files (or one Parquet row group) yields fewer
    partitions than cores, and every per-row text step after it would run in
    that many tasks.  Only then is the input redistributed round-robin
    (deterministic: Spark sorts before a round-robin repartition).  Large
    inputs already have more splits than cores and pass through untouched,
    so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


# Largest per-store side table broadcast without a shuffle join (rows).  The
# side tables here carry a handful of numbers and short strings per row, so
# this caps a broadcast at roughly 100-200 MB.
BROADCAST_ROWS = 2_000_000


def store_count(df: DataFrame) -> int:
    """Number of distinct stores: one narrow aggregate over the ``slug`` column."""
    return df.select("slug").distinct().count()


def broadcast_if(side: DataFrame, rows_bound: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``side`` only when a proven upper bound of its rows is under ``limit``.

    Beyond the limit (or with no bound) the side is left to the planner: a
    shuffle join, with AQE's runtime broadcast and skew-join splitting.
    """
    from pyspark.sql import functions as F
    if rows_bound is not None and rows_bound <= limit:
        return F.broadcast(side)
    return side
