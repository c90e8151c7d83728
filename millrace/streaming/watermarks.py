"""High-water marks of incremental extraction, kept as a small append-only table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

SCHEMA = "name string, watermark string, recorded_at timestamp"


class Watermarks:
    """One mark per prefix or collection; the newest row counts. Advance only after a successful write."""

    def __init__(self, spark: SparkSession, path: str, look_back: dt.timedelta | None = None):
        self.spark, self.path, self.look_back = spark, path, look_back

    def table(self) -> DataFrame:
        """The current mark of every name."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing recorded yet
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("name").agg(
            F.max_by("watermark", "recorded_at").alias("watermark"), F.max("recorded_at").alias("recorded_at")
        )

    def get(self, name: str, now: dt.datetime) -> str | None:
        """The mark; without one ``now`` minus the look-back, or None (read everything) if no look-back was asked for."""
        row = self.table().filter(F.col("name") == name).select("watermark").first()
        if row and row[0] is not None:
            return row[0]
        return None if self.look_back is None else (now - self.look_back).isoformat(sep=" ")

    def set(self, name: str, value: str | None, now: dt.datetime) -> None:
        """Record a mark: the largest value seen, not the time of the run."""
        self.spark.createDataFrame([(name, value, now)], SCHEMA).write.mode("append").parquet(self.path)

    def reset(self, name: str, now: dt.datetime) -> None:
        """Forget the mark; the next run starts anew."""
        self.set(name, None, now)

    def advance(self, name: str, processed: DataFrame, column: str, now: dt.datetime) -> str | None:
        """Move the mark to the largest value of the processed rows, if there are any."""
        top = processed.agg(F.max(column).cast("string")).first()[0]
        if top is not None:
            self.set(name, top, now)
        return top
