"""Event streams: windowed counts with late data, and change events as snapshots arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import checkpoint_dir, table_path


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream."""
    path = table_path(d, "events")
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    df = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """Events and their sum of values per window and type; rows later than `late` behind the newest are dropped, and
    only so much state is kept."""
    timed = events.where("ts is not null").withWatermark("ts", late)
    agg = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All windows that are final now, through the stream, as a batch: for tests and backfills.

    Append mode into a Parquet sink: a window is written once, when the watermark has passed its end, and its state is
    dropped then; nothing is gathered on the driver. Called again with the same folder (of sink and checkpoint), it
    goes on where it stopped."""
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def new_alerts(snapshots: DataFrame, out: str, watch: DataFrame, checkpoint: str):
    """Starts a query that, whenever snapshot rows arrive, adds the alerts they bring to `out`/alerts.

    A batch writes its rows to `out`/rows/batch=<id> and its alerts to `out`/alerts/batch=<id>, replacing what a failed
    attempt at the same batch left there, so that nothing is there twice. Alerts are made of the snapshots that the
    batch brings or completes, and of the one delivered before the first of them (by taken_at), not of all so far.
    """
    from corroborate.operators.changefeed import alerts

    key = ["t_from", "t_to", "type", "name", "surface"]

    def kept(spark: SparkSession, part: str, batch: int, schema) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{part}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
        rows = spark.read.parquet(f"{out}/{part}")
        return rows.where(F.col("batch") < batch).drop("batch")

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["t", "section", "name", "site", "loaded_at"])
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        rows = spark.read.parquet(f"{out}/rows/batch={n}")
        past = kept(spark, "rows", n, batch.schema)
        first = rows.agg(F.min("taken_at").alias("first"))
        # the last snapshot before those that have new rows, and all from there on
        start = past.join(F.broadcast(first), F.col("taken_at") < F.col("first")).agg(F.max("taken_at").alias("start"))
        since = past.join(F.broadcast(start), F.col("taken_at") >= F.coalesce("start", F.lit("1900-01-01").cast("timestamp"))).drop("start")
        found = alerts(since.unionByName(rows), watch)
        known = kept(spark, "alerts", n, found.schema).select(*key)
        found.join(known, key, "left_anti").write.mode("overwrite").parquet(f"{out}/alerts/batch={n}")

    return snapshots.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
