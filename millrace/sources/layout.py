"""Bronze and quarantine layouts: partition columns, metadata columns, envelopes, tenant folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import order
from millrace.functions.scalars import sha256_of


def add_partition_columns(df: DataFrame, ts_col: str, hive: bool = False) -> DataFrame:
    """``<ts>_year/_month/_day``, or plain ``year/month/day`` for a Hive layout."""
    prefix = "" if hive else f"{ts_col}_"
    return df.withColumns(
        {
            f"{prefix}year": F.year(ts_col),
            f"{prefix}month": F.month(ts_col),
            f"{prefix}day": F.dayofmonth(ts_col),
        }
    )


def add_bronze_metadata(
    df: DataFrame, source: str, entity: str, ingestion_id: str, now: Column, schema_version: int = 1
) -> DataFrame:
    """The six Bronze metadata columns; the row hash covers the data columns only."""
    data = [c for c in df.columns if not c.startswith("_")]
    return df.withColumns(
        {
            "_ingestion_timestamp": now,
            "_source_system": F.lit(source),
            "_source_entity": F.lit(entity),
            "_ingestion_id": F.lit(ingestion_id),
            "_schema_version": F.lit(schema_version),
            "_row_hash": sha256_of(data),
        }
    )


def write_quarantine(df: DataFrame, path: str, job_id: str, now: Column, by_rule: bool = False) -> str:
    """Rejected rows with time and job id in the job's folder, replacing what an earlier try of the same job left there.

    On request there is one folder per rule; rules are gathered first and large ones split over several files.
    """
    target = f"{path.rstrip('/')}/{job_id}"
    out = df.withColumns({"_quarantine_timestamp": now, "_quarantine_job_id": F.lit(job_id)})
    if by_rule:
        out.hint("rebalance", "rule_id").write.mode("overwrite").partitionBy("rule_id").parquet(target)
    else:
        out.write.mode("overwrite").parquet(target)
    return target


def write_tenants(df: DataFrame, path: str, tenant_col: str, table_col: str | None = None) -> None:
    """One job for all tenants; every tenant (and table) gets its own folder."""
    parts = [tenant_col] + ([table_col] if table_col else [])
    df.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def to_envelopes(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    n: int,
    page_rows: int = order.PAGE_ROWS,
) -> DataFrame:
    """Messages of ``n`` records per group: batch number, total batches, record count, records as JSON.

    Record numbers come from the global sort, so one very large group is numbered by many tasks; an array
    never holds more than ``n`` records.
    """
    groups = list(group_cols)
    pages = order.paged(df, groups, [F.col(c) for c in order_cols], page_rows)
    numbered = order.running(pages, groups, order.row_numbers("_rn"), page_rows)
    records = numbered.select(
        *groups,
        "_rn",
        (F.floor((F.col("_rn") - 1) / n) + 1).alias("batch_number"),
        F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("_record"),
    )
    batches = records.groupBy(*groups, "batch_number").agg(
        F.count("*").alias("record_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_record"))), lambda r: r["_record"]).alias("records"),
    )
    totals = df.groupBy(*groups).agg(F.ceil(F.count("*") / n).alias("total_batches"))
    return batches.join(totals, groups)
