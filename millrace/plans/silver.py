"""Bronze to Silver as one plan per output, with counts observed while the outputs are written."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.operators import columns
from millrace.operators.rules import Rule, enforce
from millrace.operators.windows import deduplicate, drop_exact
from millrace.sources.layout import write_quarantine
from millrace.sources.tables import TableRef, read_bronze


@dataclass(frozen=True)
class SilverJob:
    """What to read, which checks and cleaning to apply, and where the outputs go."""

    source: TableRef | str
    target: str
    quarantine: str
    job_id: str
    source_system: str
    entity: str
    rules: Sequence[Rule] = ()
    sql: str | None = None
    dedup_keys: Sequence[str] = ()
    dedup_order: Sequence[str] = ()
    dedup_exact: bool = True
    standardize: bool = True
    mode: str = "full"
    watermark_col: str | None = None
    watermark_value: object = None
    partition_by: Sequence[str] = field(default_factory=tuple)


def silver_rows(df: DataFrame, job: SilverJob, now: Column) -> tuple[DataFrame, DataFrame]:
    """The clean rows with Silver metadata, and the rejected rows, both lazy."""
    split = enforce(df, job.rules)
    clean = split.valid.drop("_violations")
    if job.sql:
        clean = columns.apply_sql(clean, job.sql)
    if job.dedup_keys:
        clean = deduplicate(clean, list(job.dedup_keys), list(job.dedup_order), "last")
    elif job.dedup_exact:
        clean = drop_exact(clean)
    if job.standardize:
        clean = columns.standardize(clean)
    return columns.add_silver_metadata(clean, job.source_system, job.entity, job.job_id, now), split.rejected


def bronze_to_silver(spark: SparkSession, job: SilverJob, now: Column) -> DataFrame:
    """Run the job and return its one-row report.

    Two writes and no other action: the row counts and the new watermark are observed on the way. The watermark is that of
    all rows read, rejected ones included, whatever the SQL does to the column, so no row is read twice; a job that is
    tried again replaces its own quarantined rows.
    """
    raw = read_bronze(spark, job.source, job.mode, job.watermark_col, job.watermark_value)
    raw_seen, clean_seen, rejected_seen = Observation("raw"), Observation("clean"), Observation("rejected")
    raw = raw.observe(raw_seen, _watermark(job, raw).alias("high"))
    clean, rejected = silver_rows(raw, job, now)
    clean = clean.observe(clean_seen, F.count(F.lit(1)).alias("n"))
    rejected = rejected.observe(rejected_seen, F.count(F.lit(1)).alias("n"))
    writer = clean.write.mode("overwrite" if job.mode == "full" else "append").option("compression", "snappy")
    (writer.partitionBy(*job.partition_by) if job.partition_by else writer).parquet(job.target)
    write_quarantine(rejected, job.quarantine, job.job_id, now)
    kept, lost = clean_seen.get, rejected_seen.get
    row = (job.job_id, job.entity, kept["n"], lost["n"], raw_seen.get["high"])
    return spark.createDataFrame(
        [row], "job_id string, entity string, silver_rows bigint, quarantined_rows bigint, watermark string"
    )


def _watermark(job: SilverJob, df: DataFrame) -> Column:
    """The largest value of the watermark column as text, or NULL when the job has none."""
    if job.watermark_col and job.watermark_col in df.columns:
        return F.max(job.watermark_col).cast("string")
    return F.max(F.lit(None).cast("string"))
