"""Images kept once by content: rows hold references, a table of blobs holds each content under its digest.

The store is a folder of Parquet files by the first two characters of the digest, so that saving and collecting touch only parts that
change. Saving appends what is not there yet: run again, or with executors lost, it writes nothing twice. Collecting
deletes what no row of a snapshot refers to; writers that save at the same time must be in the snapshot or wait.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions import text
from lonja.storage import stored

PREFIX = "image:"
_SCHEMA = "digest string, data string, part string"


def digest_of(img: Column) -> Column:
    """Digest of a valid image (a data url), else null."""
    return F.when(text.image_state(img) == "valid", F.sha2(F.trim(img), 256))


def referenced(rows: DataFrame, img: str = "img") -> DataFrame:
    """rows with references in place of valid images; anything else in the column stays as it is, null too."""
    digest = digest_of(F.col(img))
    return rows.withColumn(img, F.when(digest.isNotNull(), F.concat(F.lit(PREFIX), digest)).otherwise(F.col(img)))


def blobs(rows: DataFrame, img: str = "img") -> DataFrame:
    """(digest, data): each valid image once; equal contents are partial minima before they meet."""
    return rows.select(digest_of(F.col(img)).alias("digest"), F.trim(img).alias("data")).where("digest IS NOT NULL").groupBy("digest").agg(F.min("data").alias("data"))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(digest, data, part) of a store; empty where there is none yet."""
    try:
        return spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], _SCHEMA)


def save(rows: DataFrame, path: str, img: str = "img") -> DataFrame:
    """Writes the images of rows that the store does not have and returns the rows with references."""
    have = contents(rows.sparkSession, path).select("digest")
    new = stored(blobs(rows, img).join(have, "digest", "left_anti").withColumn("part", F.substring("digest", 1, 2)), "new-images")
    if not new.isEmpty():
        new.repartition("part").write.mode("append").partitionBy("part").parquet(path)
    return referenced(rows, img)


def loaded(rows: DataFrame, path: str, img: str = "img") -> DataFrame:
    """rows with images in place of references; a reference that the store does not have gives null."""
    have = contents(rows.sparkSession, path).select(F.concat(F.lit(PREFIX), "digest").alias("_ref"), "data").groupBy("_ref").agg(F.min("data").alias("_data"))
    out = rows.join(have, rows[img] == have["_ref"], "left")
    return out.withColumn(img, F.when(F.col(img).startswith(PREFIX), F.col("_data")).otherwise(F.col(img))).drop("_ref", "_data")


def unreferenced(rows: DataFrame, path: str, img: str = "img") -> DataFrame:
    """(digest) of the store that no row refers to."""
    used = rows.where(F.col(img).startswith(PREFIX)).select(F.substring(F.col(img), len(PREFIX) + 1, 64).alias("digest"))
    return contents(rows.sparkSession, path).select("digest").distinct().join(used, "digest", "left_anti")


def collect(rows: DataFrame, path: str, img: str = "img") -> int:
    """Deletes what no row refers to and returns how many contents that were. The parts concerned are written anew as a whole
    and replace the old ones only when all are written; a part with nothing left keeps no file."""
    spark = rows.sparkSession
    gone = stored(unreferenced(rows, path, img), "unreferenced")
    n = gone.count()
    if n:
        parts = gone.select(F.substring("digest", 1, 2).alias("part")).distinct()
        whole = contents(spark, path).join(parts, "part", "left_semi")
        kept = stored(whole.join(gone, "digest", "left_anti").select("digest", "data", "part"), "kept-images")
        kept.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        empty = [r["part"] for r in parts.join(kept.select("part").distinct(), "part", "left_anti").collect()]  # 256 parts at most
        context = spark.sparkContext
        for part in empty:
            folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return n
