"""Grouped and whole-table aggregations, Gold tables and dashboard metrics.

All of them are partial aggregates, so a hot group sends one row per task over the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import order as paging
from millrace.functions.scalars import FLOATING, NUMERIC, TEMPORAL, as_list, epoch_seconds, exact, missing
from millrace.functions.stats import with_distinct_counts
from millrace.operators.columns import filter_triples


def group_sum(df: DataFrame, group_by: str | Sequence[str], agg_columns: str | Sequence[str]) -> DataFrame:
    return df.groupBy(*[exact(c) for c in as_list(group_by)]).agg(*[F.sum(exact(c)).alias(f"{c}_sum") for c in as_list(agg_columns)])


def group_avg(df: DataFrame, group_by: str | Sequence[str], agg_columns: str | Sequence[str]) -> DataFrame:
    return df.groupBy(*[exact(c) for c in as_list(group_by)]).agg(*[F.avg(exact(c)).alias(f"{c}_avg") for c in as_list(agg_columns)])


def group_count(df: DataFrame, group_by: str | Sequence[str]) -> DataFrame:
    return df.groupBy(*[exact(c) for c in as_list(group_by)]).agg(F.count("*").alias("count"))


def group_min_max(df: DataFrame, group_by: str | Sequence[str], agg_columns: str | Sequence[str]) -> DataFrame:
    names = as_list(agg_columns)
    aggs = [f(exact(c)).alias(f"{c}_{n}") for c in names for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*[exact(c) for c in as_list(group_by)]).agg(*aggs)


FUNCTIONS = {"sum": F.sum, "count": F.count, "avg": F.avg, "max": F.max, "min": F.min, "count_distinct": F.count_distinct}


def aggregate(
    df: DataFrame,
    group_by: str | Sequence[str],
    aggs: Sequence[Mapping[str, str]],
    filters: Sequence[Mapping[str, object]] = (),
    now: Column | None = None,
    approx: bool = False,
) -> DataFrame:
    """Gold aggregate: ``[{column, function, alias}]`` per group, with the creation time when given.

    ``approx=True`` counts distinct values with a sketch.
    """
    out = []
    for spec in aggs:
        name, column = spec["function"], spec["column"]
        build = F.approx_count_distinct if approx and name == "count_distinct" else FUNCTIONS[name]
        out.append(build("*" if column == "*" else F.col(column)).alias(spec.get("alias") or f"{name}_{column}"))
    result = filter_triples(df, filters).groupBy(*as_list(group_by)).agg(*out)
    return result if now is None else result.withColumn("_gold_created_at", now)


# Segment name, total spent above, purchases above; the first match wins.
SEGMENTS = [("VIP", 1000, 10), ("Premium", 500, 5), ("Regular", 100, 2)]
NEW_SEGMENT = "New"


def rfm(
    df: DataFrame, customer: str, date: str, amount: str, as_of: Column | None = None, now: Column | None = None
) -> DataFrame:
    """Recency, frequency and money per customer, with a segment."""
    totals = df.groupBy(customer).agg(
        F.max(date).alias("last_purchase_date"),
        F.count("*").alias("purchase_frequency"),
        F.sum(amount).alias("total_spent"),
        F.avg(amount).alias("avg_order_value"),
    )
    segment = F.lit(NEW_SEGMENT)
    for name, spent, times in reversed(SEGMENTS):
        hit = (F.col("total_spent") > spent) & (F.col("purchase_frequency") > times)
        segment = F.when(hit, F.lit(name)).otherwise(segment)
    today = F.current_date() if as_of is None else as_of
    result = totals.withColumn("days_since_last_purchase", F.datediff(today, F.col("last_purchase_date")))
    result = result.withColumn("customer_segment", segment)
    return result if now is None else result.withColumn("_gold_created_at", now)


LEVELS = ("day", "week", "month", "quarter", "year")


def time_rollup(
    df: DataFrame, ts: str, level: str, metrics: Mapping[str, Column], group_by: str | Sequence[str] = ()
) -> DataFrame:
    """Metrics per calendar period and group."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    period = F.date_trunc(level, F.col(ts)).cast("date").alias("period")
    return df.groupBy(period, *as_list(group_by)).agg(*[c.alias(n) for n, c in metrics.items()])


def max_watermark(df: DataFrame, col: str) -> DataFrame:
    """One row: the largest value of the column, as text."""
    return df.agg(F.max(col).cast("string").alias("watermark"))


def column_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: distinct, nulls, null %, and min/max/avg where they make sense.

    One scan for all columns but the exact distinct counts, which are narrow aggregates of their own;
    ``approx=True`` replaces those by sketches.
    """
    entries = []
    for f in df.schema.fields:
        value = exact(f.name)
        if isinstance(f.dataType, FLOATING):
            value = F.when(~F.isnan(value), value)
        number = isinstance(f.dataType, NUMERIC)
        ordered = number or isinstance(f.dataType, TEMPORAL)
        entries.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.count("*").alias("row_count"),
                F.count_if(missing(df, f.name)).alias("null_count"),
                (F.min(value).cast("string") if ordered else F.lit(None).cast("string")).alias("min_value"),
                (F.max(value).cast("string") if ordered else F.lit(None).cast("string")).alias("max_value"),
                (F.avg(value).cast("double") if number else F.lit(None).cast("double")).alias("avg_value"),
            )
        )
    rows = df.agg(F.array(*entries).alias("c")).select(F.inline("c"))
    rows = with_distinct_counts(rows, df, df.columns, approx=approx)
    share = F.try_divide(F.col("null_count") * F.lit(100.0), F.col("row_count"))
    return rows.withColumn("null_percentage", F.round(share, 2))


# File type → media category; anything else counts as a document.
MEDIA_CATEGORIES = {
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff"],
    "document": ["pdf", "doc", "docx", "txt", "csv"],
    "audio": ["mp3", "wav", "flac", "m4a"],
    "video": ["mp4", "avi", "mov", "mkv"],
}


def media_category(file_type: Column) -> Column:
    kind, result = F.lower(file_type), F.lit("document")
    for name, types in MEDIA_CATEGORIES.items():
        result = F.when(kind.isin(types), F.lit(name)).otherwise(result)
    return result


def asset_stats(df: DataFrame, file_type: str = "file_type", size: str = "file_size_bytes") -> DataFrame:
    """Count and bytes per media category."""
    return df.groupBy(media_category(F.col(file_type)).alias("category")).agg(
        F.count("*").alias("count"), F.sum(F.coalesce(F.col(size), F.lit(0))).alias("size_bytes")
    )


def asset_quality(df: DataFrame) -> DataFrame:
    """Per file type: total, mean confidence, failed, success, pending, and success % as the score."""
    status = F.col("extraction_status")
    return (
        df.groupBy("file_type")
        .agg(
            F.count("*").alias("total"),
            F.avg("confidence").alias("avg_confidence"),
            F.count_if(status == "failed").alias("failed"),
            F.count_if(status == "success").alias("success"),
            F.count_if(status == "pending").alias("pending"),
        )
        .withColumn("quality_score", F.round(F.col("success") * F.lit(100.0) / F.col("total"), 1))
    )


def extraction_success(df: DataFrame) -> DataFrame:
    """Per file type and model, successful assets only: count, mean confidence, first and last time."""
    good = df.filter(F.col("extraction_status") == "success")
    return good.groupBy("file_type", "model").agg(
        F.count("*").alias("success_count"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("processed_at").alias("first_processed"),
        F.max("processed_at").alias("last_processed"),
    )


def asset_aging(df: DataFrame, now: Column, statuses: Sequence[str] = ("failed", "pending")) -> DataFrame:
    """Unfinished assets with the hours since they were created."""
    hours = (epoch_seconds(now) - epoch_seconds(F.col("created_at"))) / 3600
    return df.filter(F.col("extraction_status").isin(list(statuses))).withColumn("hours_since_created", hours)


def quarantine_summary(df: DataFrame) -> DataFrame:
    """Per table and domain: total, per-status and per-severity counts, last date."""
    status, severity = F.col("resolution_status"), F.lower(F.col("severity"))
    return df.groupBy("source_table", "domain").agg(
        F.count("*").alias("total_quarantined"),
        *[F.count_if(status == s).alias(s) for s in ("pending", "fixed", "reprocessed")],
        *[F.count_if(severity == s).alias(f"severity_{s}") for s in ("critical", "high", "warning")],
        F.max("quarantined_at").alias("last_quarantine_date"),
    )


def rule_activity(rules: DataFrame, log: DataFrame) -> DataFrame:
    """Active rules with their distinct executions, mean time and mean failure rate."""
    runs = log.groupBy("rule_id").agg(
        F.count_distinct("execution_id").alias("total_executions"),
        F.avg("processing_time_ms").alias("avg_execution_time_ms"),
        F.avg("failure_rate").alias("avg_failure_rate"),
    )
    return (
        rules.filter("is_active").join(runs, "rule_id", "left").fillna({"total_executions": 0})
    )


def rule_performance(log: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per rule, day and hour: times, executions, rows, failure rate, and its trend against the hour before."""
    hourly = log.groupBy("rule_id", F.to_date("executed_at").alias("metric_date"), F.hour("executed_at").alias("metric_hour")).agg(
        F.avg("processing_time_ms").alias("avg_execution_time_ms"),
        F.max("processing_time_ms").alias("max_execution_time_ms"),
        F.min("processing_time_ms").alias("min_execution_time_ms"),
        F.count("*").alias("total_executions"),
        F.sum("rows_processed").alias("total_rows_processed"),
        F.avg("failure_rate").alias("avg_failure_rate"),
    )
    # Only hourly aggregates reach the window: 8,760 rows per rule and year.
    before = F.lag("avg_failure_rate").over(Window.partitionBy("rule_id").orderBy("metric_date", "metric_hour"))
    change = F.col("avg_failure_rate") - before
    trend = (
        F.when(change < -tolerance, F.lit("improving")).when(change > tolerance, F.lit("degrading")).otherwise(F.lit("stable"))
    )
    return hourly.withColumn("trend_direction", trend)


def run_metrics(log: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: distinct pipelines, active ones, success rate, failures and mean duration of the last hours."""
    fresh = F.col("executed_at") > now - F.make_dt_interval(F.lit(0), F.lit(hours))
    good = fresh & (F.col("status") == "success")
    return (
        log.filter(F.col("operation") == "transform")
        .agg(
            F.count_distinct("table_name").alias("total_pipelines"),
            F.count_distinct(F.when(fresh, F.col("table_name"))).alias("active_pipelines"),
            F.count_if(fresh).alias("recent_runs"),
            F.count_if(good).alias("recent_success"),
            F.avg(F.when(good, F.col("duration_seconds"))).alias("avg_duration_seconds"),
        )
        .withColumn(
            "success_rate", F.round(F.try_divide(F.col("recent_success") * F.lit(100.0), F.col("recent_runs")), 1)
        )
        .withColumn("failed_runs", F.col("recent_runs") - F.col("recent_success"))
    )


def event_sequence(
    df: DataFrame, key: str, ts: str, event_type: str, tie: str, part_rows: int = 10_000, page_rows: int = paging.PAGE_ROWS
) -> DataFrame:
    """Per asset: event count, first and last time, and the event types in time order.

    A sequence longer than ``part_rows`` continues in further rows (``part`` 0, 1, …), so no array grows
    without bound and nothing is cut off.
    """
    slim = df.select(key, ts, tie, event_type)
    pages = paging.paged(slim, [key], [F.col(ts), F.col(tie)], page_rows)
    numbered = paging.running(pages, [key], paging.row_numbers("_rn"), page_rows)
    parts = numbered.groupBy(key, F.floor((F.col("_rn") - 1) / part_rows).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", event_type))), lambda e: e[event_type]).alias("events")
    )
    totals = df.groupBy(key).agg(
        F.count("*").alias("total_events"), F.min(ts).alias("first_event"), F.max(ts).alias("last_event")
    )
    return parts.join(totals, key)


def asset_event_sequence(
    df: DataFrame, assets: DataFrame, key: str, ts: str, event_type: str, tie: str, about: Sequence[str] = ("file_type", "source"), **kw
) -> DataFrame:
    """``event_sequence`` with columns of the assets (one row per ``key``); events of unknown assets keep NULLs there."""
    known = assets.select(key, *about)
    return event_sequence(df, key, ts, event_type, tie, **kw).join(known, key, "left")


def gold_metadata(df: DataFrame) -> DataFrame:
    """One row over the Gold assets: totals, distinct types and sources, date range, mean confidence."""
    return df.agg(
        F.count("*").alias("total_gold_assets"),
        F.count_distinct("file_type").alias("unique_file_types"),
        F.count_distinct("source").alias("unique_sources"),
        F.min("processed_at").alias("earliest_asset"),
        F.max("processed_at").alias("latest_asset"),
        F.avg("confidence").alias("avg_confidence_score"),
    )


GOLD_COLUMNS = ["id", "source", "file_type", "summary", "confidence", "silver_key", "bronze_key", "processed_at", "model"]


def promote(silver: DataFrame, columns: Sequence[str] = tuple(GOLD_COLUMNS)) -> DataFrame:
    """Successful assets in the fixed Gold projection."""
    return silver.filter(F.col("extraction_status") == "success").select(*[c for c in columns if c in silver.columns])


def refresh_report(gold: DataFrame, previous: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """One row: refresh time, Gold rows, and rows that were not in the previous Gold table."""
    marked = gold.select(key).join(previous.select(key).withColumn("_old", F.lit(True)), key, "left")
    return marked.agg(
        F.count("*").alias("total_assets"), F.count_if(F.col("_old").isNull()).alias("new_assets")
    ).withColumn("refreshed_at", now)


def distinct_fast(df: DataFrame, columns: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """Sketched distinct counts of the columns, one row."""
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])
