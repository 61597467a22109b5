"""Event-time windows, for batch tables and streams alike (an extension of the reference's scope)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream of Parquet files as they arrive, at most ``files`` at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Streams need instants for their event time, and a watermark to end windows."""
    if not (late and events.isStreaming):
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, every: str, late: str | None = None) -> DataFrame:
    """Counts and sums per type and window; a stream drops what is later than ``late``."""
    rows = _timed(events, late)
    g = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a user, ended by a pause of ``gap``."""
    rows = _timed(events, late)
    g = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append to Parquet with a checkpoint; ``once`` takes what is there and ends."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def best_rows(events: DataFrame, keys: list[str], priority: list[Column], every: str = "1 day", late: str | None = None) -> DataFrame:
    """One row per key and window, the first by ``priority``, then of the least values: for tables and streams alike.

    The state of a stream is one row per key and open window. A window is handed on when the
    watermark passes its end; what comes later than ``late`` is left out, and ``split_late`` keeps it.
    """
    rows = _timed(events, late)
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(others)])
    best = rows.groupBy(F.window("ts", every).alias("w"), *keys).agg(F.min_by(F.struct(*others), order).alias("r"))
    return best.select(F.col("w.start").alias("start"), *keys, "r.*")


def split_late(events: DataFrame, path: str, checkpoint: str, delay: str, once: bool = True):
    """Part a stream of rows with a time ``ts`` into ``path``/rows and ``path``/late.

    A row is late if it is over ``delay`` older than the newest row of any batch before its own. A
    batch writes its rows and its newest time into folders of its own, over what a failed try left
    there, so that a restarted query neither loses nor doubles a row. Rows without a time are late.
    """
    spark = events.sparkSession

    def part(batch: DataFrame, number: int) -> None:
        known = spark.createDataFrame([], "newest timestamp, batch long")
        if number:
            known = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/newest")
        before = known.where(F.col("batch") < number).agg(F.max("newest").alias("newest")).first()["newest"]
        at = F.col("ts").cast("timestamp")
        edge = F.lit(before) - F.expr(f"interval {delay}") if before else None
        late = at.isNull() if edge is None else F.coalesce(at < edge, F.lit(True))
        batch = batch.persist()
        try:
            batch.where(~late).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            batch.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
