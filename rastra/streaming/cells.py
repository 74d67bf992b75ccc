"""An extension for live layers: events become cells as they arrive, and finished windows are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def cell_windows(events: DataFrame, columns: int = 256, late: str = "2 hours") -> DataFrame:
    """layer, row (hour since the epoch), col, value (greatest, capped at 1) and n; events later than `late` are dropped, which
    bounds the state by the hours that are still open."""
    hour = F.window("ts", "1 hour")
    kept = events.withWatermark("ts", late)
    out = kept.groupBy(hour.alias("w"), F.col("event_type").alias("layer"), (F.col("user_id") % columns).cast("int").alias("col"))
    out = out.agg(F.max(F.least(F.lit(1.0), F.col("value") / 500)).alias("value"), F.count("*").alias("n"))
    return out.select("layer", (F.unix_seconds("w.start") / 3600).cast("int").alias("row"), "col", "value", "n")


def append_layer(cells: DataFrame, path: str, checkpoint: str):
    """Start writing finished cells; availableNow ends with the input that is there."""
    return cells.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
