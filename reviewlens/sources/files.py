"""Review files in, tables of reviews out.

The original layout is one JSON array per store at ``<root>/<slug>/reviews.json``,
with two blanks of indentation.  Line ends cannot stand inside a JSON string, so the
line that closes one element and the line that opens the next are a record separator:
Spark's text source cuts such files there and splits large ones by byte ranges.  Files
without that indentation are one record each.  For large collections the partitioned
Parquet layout written by ``write_reviews`` is the one to use: it splits, prunes
partitions by ``slug`` and pushes filters into the scan.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_FIELDS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_translated", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("owner_reply", T.StringType()),
    T.StructField("photos", T.IntegerType()),
    T.StructField("date_abs", T.StringType()),
    T.StructField("timestamp_us", T.LongType()),
])
REVIEWS_COLUMNS = ["slug", "pos"] + [f.name for f in REVIEW_FIELDS.fields]
SLUG_FROM_PATH = r"([^/]+)/reviews\.json$"


ELEMENT_END = "\n  },\n  {"   # between two elements of an array indented by two
_OPEN, _CLOSE = r"^\s*\[\n  \{", r"\n  \}\n\]\s*\z"


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    """(path, block, n, opens, closes, rows): the records of all review files in file order;
    rows is null where a record is no review or no array of reviews."""
    raw = (spark.read.option("pathGlobFilter", "reviews.json").option("lineSep", ELEMENT_END)
           .text(os.path.join(root, "*"))
           .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("n")))
    opens, closes = F.col("value").rlike(_OPEN), F.col("value").rlike(_CLOSE)
    whole = F.ltrim("value").startswith("[") & ~opens
    fields = T.StructType([*REVIEW_FIELDS.fields, T.StructField("_bad", T.StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    body = F.regexp_replace(F.regexp_replace("value", _OPEN, ""), _CLOSE, "")
    one = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), fields, how)
    many = F.from_json("value", T.ArrayType(fields), how)
    rows = F.when(whole, F.when(~F.exists(many, lambda r: r.isNull() | r["_bad"].isNotNull()), many)) \
        .when(one["_bad"].isNull(), F.array(one))
    return raw.select("path", "block", "n", (opens | whole).alias("opens"), (closes | whole).alias("closes"), rows.alias("rows"))


def _slug_of(path: str = "path"):
    """The store's folder name, as it was written (the path is URL-encoded)."""
    name = F.regexp_extract(path, SLUG_FROM_PATH, 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def bad_review_files(spark: SparkSession, root: str) -> DataFrame:
    """(slug, path): the review files that are no review array: cut short, or with an
    element that does not parse (a rating that is no integer)."""
    per_file = _pieces(spark, root).groupBy("path").agg(
        F.count_if("opens").alias("opens"), F.count_if("closes").alias("closes"),
        F.count_if(F.col("rows").isNull()).alias("broken"))
    return (per_file.where((F.col("opens") != 1) | (F.col("closes") != 1) | (F.col("broken") > 0))
            .select(_slug_of().alias("slug"), "path"))


def read_reviews_json(spark: SparkSession, root: str, skip_bad: bool = False) -> DataFrame:
    """All ``<root>/<slug>/reviews.json`` files as one ``reviews`` table.

    ``pos`` is the index in the file's array; absent keys are NULL.  A file that is no
    review array fails the job instead of passing for an empty store; with ``skip_bad``
    it is left out, the other stores stay, and ``bad_review_files`` names it.  A large file
    is read by several tasks: records are numbered inside their block and shifted
    by the sizes of the file's earlier blocks, so no task holds a whole file.
    """
    pieces = _pieces(spark, root)
    bad = bad_review_files(spark, root).select("path")
    good = pieces.join(bad, "path", "left_anti").withColumn("size", F.size("rows"))
    sizes = good.groupBy("path", "block").agg(F.sum("size").alias("in_block"))
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", F.coalesce(F.sum("in_block").over(upto), F.lit(0)).alias("first"))
    inside = Window.partitionBy("path", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = (good.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["path", "block"])
            .select(_slug_of().alias("slug"), (F.col("first") + F.col("before")).alias("at"), F.posexplode("rows").alias("i", "r"))
            .select("slug", (F.col("at") + F.col("i")).cast("long").alias("pos"), *[f"r.{f.name}" for f in REVIEW_FIELDS.fields]))
    if skip_bad:
        return rows
    none = F.raise_error(F.concat(F.lit("no review array in "), F.col("path")))
    failing = bad.select(none.cast("string").alias("slug"), F.lit(0).cast("long").alias("pos"),
                         *[F.lit(None).cast(f.dataType).alias(f.name) for f in REVIEW_FIELDS.fields])
    return rows.unionByName(failing)


def list_stores(spark: SparkSession, root: str, skip_bad: bool = False) -> DataFrame:
    """(slug, reviews): every store directory with a ``reviews.json``, sorted by slug.

    An empty array counts 0.  Bad files fail the job or, with ``skip_bad``, are left out.
    """
    per_file = _pieces(spark, root).groupBy("path").agg(
        F.count_if("opens").alias("opens"), F.count_if("closes").alias("closes"),
        F.count_if(F.col("rows").isNull()).alias("broken"), F.sum(F.size("rows")).alias("reviews"))
    fine = (F.col("opens") == 1) & (F.col("closes") == 1) & (F.col("broken") == 0)
    if skip_bad:
        per_file = per_file.where(fine)
    count = F.when(fine, F.col("reviews")).otherwise(
        F.raise_error(F.concat(F.lit("no review array in "), F.col("path"))).cast("long"))
    return per_file.select(_slug_of().alias("slug"), count.alias("reviews")).where(F.col("slug") != "").orderBy("slug")


def store_counts(reviews: DataFrame) -> DataFrame:
    """(slug, reviews) from a ``reviews`` table, sorted by slug."""
    return reviews.groupBy("slug").agg(F.count("*").alias("reviews")).orderBy("slug")


RECORDS_PER_FILE = 1_000_000


def write_reviews(reviews: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write reviews partitioned by store; only the stores present are replaced.

    Rows are range-clustered by (slug, pos) first: a task writes few stores, a large store
    is spread over several tasks, and no file exceeds ``RECORDS_PER_FILE`` rows, so the
    number of files follows the data instead of tasks times stores.
    """
    (reviews.repartitionByRange("slug", "pos").sortWithinPartitions("slug", "pos")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .partitionBy("slug").format(fmt).save(path))


def merge_reviews(new: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add reviews to the table at ``path``; (slug, pos) is a review's identity.

    The stores of ``new`` are read, merged and staged beside the table, then
    their partitions are replaced, so a store keeps its older reviews and a
    replayed batch changes nothing.  NULL is a store like others.  A run that fails before
    the replacement leaves the table as it was; one that fails within it may have replaced
    some stores only, and running it again completes them.
    """
    spark = new.sparkSession
    rows = new.dropDuplicates(["slug", "pos"])
    fs, p = file_system(spark, path)
    if fs.exists(p):
        keys = rows.select(F.col("slug").alias("_s"), F.col("pos").alias("_p"))
        same_store = F.col("slug").eqNullSafe(F.col("_s"))
        old = read_reviews(spark, path, fmt)
        old = old.join(keys.select("_s").distinct(), same_store, "left_semi")
        old = old.join(keys, same_store & F.col("pos").eqNullSafe(F.col("_p")), "left_anti")
        rows = rows.unionByName(old.select(*rows.columns))
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:12]}"
    try:
        rows.write.format(fmt).save(staged)
        write_reviews(spark.read.schema(rows.schema).format(fmt).load(staged), path, fmt)
    finally:
        fs.delete(file_system(spark, staged)[1], True)


def read_reviews(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a table written by ``write_reviews``; ``slug`` is a string whatever it looks like."""
    return read_partitioned(spark, [path], path, fmt)


def read_partitioned(spark: SparkSession, paths: list[str], base: str, fmt: str, keys=("slug",)) -> DataFrame:
    """Folders below ``base`` whose partition columns ``keys`` are strings: left to itself, Spark
    would read the stores 007 and 7 as one number."""
    reader = spark.read.option("basePath", base).format(fmt)
    found = reader.load(paths).schema
    fixed = T.StructType([T.StructField(f.name, T.StringType()) if f.name in keys else f for f in found.fields])
    return spark.read.option("basePath", base).schema(fixed).format(fmt).load(paths)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, its path object) of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
