"""Result tables of analysis runs, seen whole or not at all.

A run writes every table below its own folder, ``<root>/<table>/run=<run>/slug=<slug>/``,
and the list of (table, store) pairs it decided to ``<root>/_runs/run=<run>/``.  Then
one file, ``<root>/_commits/<version>``, names the run; it is created exclusively,
so two writers never take one version.  A reader takes, for each store, the rows of
the newest committed run that decided it: before the commit it sees nothing of a
run, after it all tables.  A store that a run analysed without giving it rows has
none from then on, and stores that a run did not touch keep their older rows.

Every table is computed once: which stores it has is read from the names of the
folders written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.sources.files import file_system, read_partitioned

NO_STORE = ""                  # tables without a slug column are decided as a whole


def commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(version, run) of all committed runs, oldest first."""
    fs, p = file_system(spark, f"{root}/_commits")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted((int(v), run) for v, _, run in (n.partition("-") for n in names if n[0].isdigit()))


def _commit(spark: SparkSession, root: str, run: str) -> int:
    """Claims the next version: the marker file of a version is created by one writer only."""
    version = max([v for v, _ in commits(spark, root)], default=0) + 1
    while True:
        fs, claim = file_system(spark, f"{root}/_commits/.claims/{version:010d}")
        fs.mkdirs(claim.getParent())
        try:
            fs.create(claim, False).close()
            break
        except Exception:                            # noqa: BLE001 - taken by another writer, or a real error
            if not fs.exists(claim):
                raise
            version += 1
    fs.create(file_system(spark, f"{root}/_commits/{version:010d}-{run}")[1], False).close()
    return version


def _written(spark: SparkSession, path: str) -> list[str | None]:
    """The stores whose folders stand below ``path``."""
    fs, p = file_system(spark, path)
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    names = [unescape(n[5:]) for n in names if n.startswith("slug=")]
    return [None if n == "__HIVE_DEFAULT_PARTITION__" else n for n in names]


def write_results(tables: dict[str, DataFrame], root: str, fmt: str = "json",
                  stores: DataFrame | None = None, keep_old: bool = False) -> int:
    """Write the tables of one run and commit them together; returns the version.

    JSON output keeps non-ASCII text as is (UTF-8).  In each table the stores present are
    replaced; of the analysed ``stores``, those without rows lose their older ones.
    A failed run leaves folders that no reader sees.  Unless ``keep_old``, what this
    run replaced is deleted after the commit (``vacuum``).
    """
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    marks = []
    for name, df in tables.items():
        w = df.write.format(fmt)
        path = f"{root}/{name}/run={run}"
        if "slug" in df.columns:
            w.partitionBy("slug").save(path)
            marks += [(name, s) for s in _written(spark, path)]
        else:
            w.save(path)
            marks.append((name, NO_STORE))
    decided = spark.createDataFrame(marks, "name string, slug string")
    if stores is not None:
        names = [n for n, df in tables.items() if "slug" in df.columns]
        every = stores.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), F.col("slug").cast("string").alias("slug"))
        decided = decided.unionByName(every)
    decided.distinct().write.parquet(f"{root}/_runs/run={run}")
    version = _commit(spark, root, run)
    if not keep_old:
        vacuum(spark, root)
    return version


def _decided(spark: SparkSession, root: str, until: int | None = None) -> DataFrame | None:
    """(name, slug, version, run) of the committed runs; None before the first commit."""
    known = [(v, r) for v, r in commits(spark, root) if until is None or v <= until]
    if not known:
        return None
    rows = read_partitioned(spark, [f"{root}/_runs/run={r}" for _, r in known], f"{root}/_runs", "parquet", ("run", "slug"))
    versions = spark.createDataFrame(known, "version long, run string")
    return rows.join(F.broadcast(versions), "run")   # one row per run that vacuum has left


def read_results(spark: SparkSession, root: str, name: str, fmt: str = "json", version: int | None = None) -> DataFrame | None:
    """The rows of table ``name`` as of the newest commit (or ``version``); None if no
    committed run has rows of it."""
    decided = _decided(spark, root, version)
    if decided is None:
        return None
    newest = (decided.where(F.col("name") == name).groupBy("slug").agg(F.max_by("run", "version").alias("run")))
    runs = [r for _, r in commits(spark, root)]
    paths = [p for p in (f"{root}/{name}/run={r}" for r in runs) if file_system(spark, p)[0].exists(file_system(spark, p)[1])]
    has_rows = [p for p in paths if _written(spark, p)]
    if not has_rows and paths:
        flat = read_partitioned(spark, paths, f"{root}/{name}", fmt, ("run",))
        last = newest.where(F.col("slug") == NO_STORE).select("run")
        return flat.join(F.broadcast(last), "run", "left_semi").drop("run")      # one row
    if not has_rows:
        return None
    rows = read_partitioned(spark, has_rows, f"{root}/{name}", fmt, ("run", "slug"))
    newest = newest.select(F.col("slug").alias("_s"), F.col("run").alias("_r"))
    return rows.join(newest, F.col("slug").eqNullSafe(F.col("_s")) & (F.col("run") == F.col("_r")), "left_semi").drop("run")


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes the store folders that newer committed runs replaced, and runs of which nothing is
    left; returns how many.  Readers of older versions lose them."""
    decided = _decided(spark, root)
    if decided is None:
        return 0
    newest = decided.groupBy("name", "slug").agg(F.max("version").alias("newest"))
    newest = newest.select(F.col("name").alias("_n"), F.col("slug").alias("_s"), "newest")
    all_marks = decided.join(newest, (F.col("name") == F.col("_n")) & F.col("slug").eqNullSafe(F.col("_s")))
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    gone = 0
    for r in all_marks.where(F.col("version") < F.col("newest")).select("name", "slug", "run").toLocalIterator():
        part = "" if r.slug == NO_STORE else "/slug=" + ("__HIVE_DEFAULT_PARTITION__" if r.slug is None else escape(r.slug))
        fs, p = file_system(spark, f"{root}/{r.name}/run={r.run}{part}")
        gone += bool(fs.delete(p, True))
    alive = {r.run for r in all_marks.where(F.col("version") == F.col("newest")).select("run").distinct().toLocalIterator()}
    for version, run in commits(spark, root):        # a run without a newest mark has no folder left to read
        if run not in alive:
            names = {r.name for r in decided.where(F.col("run") == run).select("name").distinct().toLocalIterator()}
            for path in [f"{root}/_commits/{version:010d}-{run}", f"{root}/_runs/run={run}", *(f"{root}/{n}/run={run}" for n in names)]:
                fs, p = file_system(spark, path)
                fs.delete(p, True)
    return gone
