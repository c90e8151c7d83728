"""Progress of streaming queries as rows, and alerts on failures and backlog."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

MAX_LAG = 100_000
SCHEMA = (
    "query string, batch_id bigint, input_rows bigint, input_rate double, processed_rate double,"
    " duration_ms bigint, backlog bigint, error string"
)


def _backlog(progress: Mapping) -> int:
    """Rows the sources report as not yet read, where they report it."""
    lags = [(s.get("metrics") or {}).get("maxOffsetsBehindLatest") for s in progress.get("sources", [])]
    return sum(int(float(x)) for x in lags if x is not None)


def progress_row(progress: Mapping) -> tuple:
    return (
        progress.get("name") or progress.get("id"),
        int(progress.get("batchId", -1)),
        int(progress.get("numInputRows", 0)),
        float(progress.get("inputRowsPerSecond") or 0.0),
        float(progress.get("processedRowsPerSecond") or 0.0),
        int((progress.get("durationMs") or {}).get("triggerExecution", 0)),
        _backlog(progress),
        None,
    )


class QueryMonitor(StreamingQueryListener):
    """The progress of all queries of a session; register with ``spark.streams.addListener``.

    With a ``path`` every ``flush_rows`` rows are appended to a table there, so that runs of any length are counted whole;
    without one all rows are kept in memory.
    """

    def __init__(self, path: str | None = None, flush_rows: int = 100):
        self.path, self.flush_rows = path, flush_rows
        self.rows: list[tuple] = []

    def _add(self, row: tuple) -> None:
        self.rows.append(row)
        if self.path and len(self.rows) >= self.flush_rows:
            self.flush(SparkSession.active())

    def flush(self, spark: SparkSession) -> None:
        """Append what is not yet in the table."""
        rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._add(progress_row(json.loads(event.progress.json)))

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._add((str(event.id), -1, 0, 0.0, 0.0, 0, 0, event.exception))

    def metrics(self, spark: SparkSession) -> DataFrame:
        if not self.path:
            return spark.createDataFrame(list(self.rows), SCHEMA)
        self.flush(spark)
        try:
            return spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing happened yet
            return spark.createDataFrame([], SCHEMA)


def recent_progress(spark: SparkSession, queries: Iterable[StreamingQuery]) -> DataFrame:
    """The progress the queries themselves remember, as rows."""
    rows = [progress_row(json.loads(p.json) if hasattr(p, "json") else p) for q in queries for p in q.recentProgress]
    return spark.createDataFrame(rows, SCHEMA)


def alerts(metrics: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """An ERROR per failed query and a WARNING per batch that is too far behind."""
    severity = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("backlog") > max_lag, "WARNING")
    message = F.when(F.col("error").isNotNull(), F.concat(F.lit("query failed: "), "error")).otherwise(
        F.concat(F.lit("high lag: "), F.col("backlog").cast("string"))
    )
    return metrics.select("query", "batch_id", severity.alias("severity"), message.alias("message")).filter(
        F.col("severity").isNotNull()
    )
