"""Readers, sinks and object-version resolution.

Cloud listing / download / upload become plain Spark reads and writes of
object-store URIs (the Hadoop connector does the transfer); choosing which
object to read is a DataFrame operation on a listing table.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATCH_GROUPS_SCHEMA = T.StructType([
    T.StructField("catch_name", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("interagency_code", T.StringType()),
])

CENSUS_SCHEMA = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("count", T.IntegerType()),
])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; empty fields are NULL.  A UTF-8
    byte-order mark at the start of the file is dropped by the reader."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("emptyValue", None).csv(path))


def read_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet (nested schemas kept; nested column pruning applies)."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwriting dataset sink; partition columns allow pruning on read."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def list_objects(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Object listing (name, updated) from file metadata only (no content read)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                     F.col("modificationTime").cast("timestamp_ntz").alias("updated"))


def split_object_name(listing: DataFrame) -> DataFrame:
    """``base__version__ext`` -> base_name, version, ext (missing parts NULL,
    extra parts ignored)."""
    parts = F.split(F.col("name"), "__")
    return listing.select("*", F.try_element_at(parts, F.lit(1)).alias("base_name"),
                          F.try_element_at(parts, F.lit(2)).alias("version"),
                          F.try_element_at(parts, F.lit(3)).alias("ext"))


def latest_version(listing: DataFrame, prefix: str, version: str = "latest", extension: str = "",
                   exact_match: bool = False) -> DataFrame:
    """Objects to read: names starting with ``prefix``, extension matching
    ``extension$``, optionally base name equal to ``prefix``; per (base, ext)
    the most recently updated (ties kept), or the given version.

    The per-(base, ext) maximum is a partial/final aggregate joined back, so a
    base with very many versions is not sorted in one task."""
    df = listing.where(F.col("name").startswith(prefix)).dropna(subset=["name", "updated"])
    df = split_object_name(df).where(F.col("ext").rlike(f"{extension}$"))
    if exact_match:
        df = df.where(F.col("base_name") == prefix)
    if version == "latest":
        mx = df.groupBy("base_name", "ext").agg(F.max("updated").alias("__mx"))
        df = df.join(mx, ["base_name", "ext"]).where(F.col("updated") == F.col("__mx")).drop("__mx")
    else:
        df = df.where(F.col("version") == version)
    return df.select("name", "base_name", "version", "ext", "updated")


def read_latest(spark: SparkSession, listing: DataFrame, root: str, prefix: str, **opts) -> DataFrame:
    """Resolve the latest object(s) and read them; only the chosen names reach the driver."""
    names = [r["name"] for r in latest_version(listing, prefix, **opts).select("name").collect()]
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    return read_table(spark, [f"{root.rstrip('/')}/{n}" for n in names])


MANIFEST = T.StructType([T.StructField("number", T.LongType()), T.StructField("name", T.StringType()),
                         T.StructField("folder", T.StringType()), T.StructField("updated", T.TimestampNTZType())])


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """All published entries; an entry that is being written (still empty or cut off) is not one."""
    path, fs = _file_system(spark, f"{root.rstrip('/')}/_manifest")
    if not fs.exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(f"{root.rstrip('/')}/_manifest").where("number IS NOT NULL AND folder IS NOT NULL")


def put_version(df: DataFrame, root: str, base: str, version: str, ext: str = "parquet") -> str:
    """Upload ``df`` as the object ``base__version__ext``; returns its folder.

    The data is written to a folder of its own that nothing refers to, and becomes
    visible as a whole by one small manifest entry.  An entry's number is claimed
    by creating its file, which fails if another writer was first (then the next
    number is tried).  A put that fails leaves no entry, and its folder is removed; one
    that is cut off leaves a folder that is never read.  Putting a name again
    replaces it; readers that hold the old folder keep it.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    folder = f"_data/{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{root}/{folder}")
    except Exception:
        path, fs = _file_system(spark, f"{root}/{folder}")
        fs.delete(path, True)
        raise
    last = _manifest(spark, root).agg(F.max("number").alias("n"), F.max("updated").alias("u")).first()
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    if last["u"] is not None:  # a later entry is later, whatever the clock says
        now = max(now, last["u"] + datetime.timedelta(microseconds=1))
    number = (last["n"] or 0) + 1
    while True:
        path, fs = _file_system(spark, f"{root}/_manifest/{number:012d}.json")
        try:
            out = fs.create(path, False)
            break
        except Py4JJavaError:
            if not fs.exists(path):
                raise
            number += 1
    entry = {"number": number, "name": f"{base}__{version}__{ext}", "folder": folder, "updated": now.isoformat(timespec="microseconds")}
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    return folder


def published(spark: SparkSession, root: str) -> DataFrame:
    """Listing (name, folder, updated) of the published objects; of a name put twice, the later entry."""
    return _manifest(spark, root).groupBy("name").agg(F.max_by(F.struct("folder", "updated"), "number").alias("e")).select("name", "e.*")


def read_published(spark: SparkSession, root: str, prefix: str, **opts) -> DataFrame:
    """Resolve the latest (or the named) version by the manifest and read it; one folder per base reaches the driver."""
    listing = published(spark, root)
    chosen = latest_version(listing, prefix, **opts).select("name").join(listing, "name").select("folder").collect()
    if not chosen:
        return spark.createDataFrame([], T.StructType([]))
    return read_table(spark, [f"{root.rstrip('/')}/{r['folder']}" for r in chosen])


def flatten_parts(model_parts: DataFrame, keep: str = "taxa") -> DataFrame:
    """Regional model output stored as (region, part, landing_period, grouped_taxa,
    catch): keep parts whose name contains ``keep``, rename the period column."""
    return (model_parts.where(F.col("part").contains(keep))
            .select("region", F.col("landing_period").alias("date_bin_start"), "grouped_taxa", "catch"))
