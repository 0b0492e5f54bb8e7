"""A content-addressed page store with provenance, on Parquet."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions.address import content_hash

OBJECTS = "digest string, body string"
PROVENANCE = "url string, digest string, fetched_at timestamp, chars bigint, seq bigint"


class Store:
    """objects/ holds every body once, by digest; provenance/ says what was fetched where and when, and only grows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}") if there else self.spark.createDataFrame([], schema)

    def objects(self) -> DataFrame:
        return self._read("objects", OBJECTS)

    def provenance(self) -> DataFrame:
        return self._read("provenance", PROVENANCE)

    def put(self, pages: DataFrame) -> None:
        """Adds pages(url, body, fetched_at). Bodies already there aren't written again; provenance always is. Rows
        without a body are no fetch."""
        rows = pages.where("body is not null").withColumn("digest", content_hash(F.col("body")))
        new = rows.groupBy("digest").agg(F.any_value("body").alias("body")).join(self.objects().select("digest"), "digest", "left_anti")
        new.write.mode("append").parquet(f"{self.folder}/objects")
        # later puts are later in seq without asking what is there, so writers don't collide; within a put the time of
        # fetching decides
        seen = rows.select("url", "digest", "fetched_at", F.length("body").cast("bigint").alias("chars"), F.lit(time.time_ns()).cast("bigint").alias("seq"))
        seen.write.mode("append").parquet(f"{self.folder}/provenance")

    def get(self, digests: DataFrame) -> DataFrame:
        return self.objects().join(digests.select("digest").distinct(), "digest", "left_semi")

    def export(self) -> DataFrame:
        """(name, body): each object under the last address it was fetched from."""
        last = self.provenance().groupBy("digest").agg(F.max_by("url", F.struct("seq", "fetched_at", "url")).alias("name"))
        return self.objects().join(last, "digest").select("name", "body")


def _versions(spark: SparkSession, path: str):
    """The file system, the folder, and the names of its complete versions in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
    return fs, folder, [n[len("_done-") :] for n in names if n.startswith("_done-")]


def refresh(df: DataFrame, path: str, keep: int = 2) -> bool:
    """Replaces a table by df, and only if it has rows; whether it was replaced.

    Every version is a folder of its own; an empty file named after it, made in one call once all its rows are there,
    declares it the current one. Nothing is renamed or overwritten, so current() sees the old or the new table at any
    time, on an object store too. The last `keep` versions stay for readers that are still at them.
    """
    spark = df.sparkSession
    name = f"v{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    fs, folder, _ = _versions(spark, path)
    at = lambda n: spark._jvm.org.apache.hadoop.fs.Path(folder, n)
    if spark.read.parquet(f"{path.rstrip('/')}/{name}").isEmpty():
        fs.delete(at(name), True)
        return False
    fs.create(at(f"_done-{name}")).close()
    for old in _versions(spark, path)[2][:-keep]:
        fs.delete(at(f"_done-{old}"), False)
        fs.delete(at(old), True)
    return True


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that refresh() writes."""
    _, _, names = _versions(spark, path)
    if not names:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/{names[-1]}")
