"""Source rows → Bronze in one call: metadata, write, schema version, profile and lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.scalars import exact
from millrace.operators import lineage, profiling, sets, sketches
from millrace.sources.layout import add_bronze_metadata
from millrace.sources.tables import read_bronze

LISTING = "table_name string, column_name string, data_type string"


@dataclass(frozen=True)
class BronzeJob:
    """One entity of one source, and where its rows and records go."""

    source: str
    entity: str
    run_id: str
    target: str
    catalog: str
    profile: str
    lineage: str


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing recorded yet
        return spark.createDataFrame([], schema)


def ingest(df: DataFrame, job: BronzeJob, now: Column) -> DataFrame:
    """Write the rows of a run and record everything about them; returns the run's catalogue row.

    The schema version rises when names or types differ from the entity's last run, and is stored with the rows. Each
    run has its own folder below the target and the profile, so a run that is tried again replaces its rows; catalogue and
    lineage get one more row. The profile reads the written rows, so the source is read once. It includes sketches, from which
    ``profile`` and ``sketches.drift`` answer for any set of runs without reading their rows.
    """
    spark = df.sparkSession
    listing = spark.createDataFrame([(job.entity, f.name, f.dataType.simpleString()) for f in df.schema.fields], LISTING)
    known = _stored(spark, job.catalog, sets.CATALOG_SCHEMA)
    nothing = spark.createDataFrame([], "table_name string, row_count bigint")
    version = sets.register(known, listing, nothing, now).first()["version"]
    path = f"{job.target.rstrip('/')}/_run={job.run_id}"
    add_bronze_metadata(df, job.source, job.entity, job.run_id, now, version).write.mode("overwrite").parquet(path)
    written = read_bronze(spark, path)
    data = written.select(*[exact(c) for c in df.columns])
    overview = profiling.overview(data).withColumns({"table_name": F.lit(job.entity), "run_id": F.lit(job.run_id), "profiled_at": now})
    columns = profiling.describe(data).withColumns({"table_name": F.lit(job.entity), "run_id": F.lit(job.run_id)})
    folder = f"{job.profile.rstrip('/')}/_run={job.run_id}"
    overview.write.mode("overwrite").parquet(f"{folder}/overview")
    columns.write.mode("overwrite").parquet(f"{folder}/columns")
    marked = sketches.sketch(data).withColumns({"run_id": F.lit(job.run_id), "profiled_at": now})
    marked.write.mode("overwrite").parquet(f"{folder}/sketches")
    rows = spark.read.parquet(f"{folder}/overview").first()["row_count"]
    counts = spark.createDataFrame([(job.entity, rows)], "table_name string, row_count bigint")
    entry = sets.register(known, listing, counts, now, ["bronze", job.source])
    entry = spark.createDataFrame(entry.collect(), sets.CATALOG_SCHEMA)  # one row
    entry.write.mode("append").parquet(job.catalog)
    edge = {
        "source_layer": "source", "source_table": f"{job.source}.{job.entity}", "target_layer": "bronze", "target_table": job.entity,
        "target_location": path, "transformation_type": "ingest", "row_count": rows, "columns": df.columns,
    }
    lineage.record_lineage(spark, job.lineage, edge)
    return entry


def stored_profiles(spark: SparkSession, job: BronzeJob) -> DataFrame:
    """The sketches of all runs of an entity, with ``run_id`` and ``profiled_at``."""
    return spark.read.parquet(f"{job.profile.rstrip('/')}/_run=*/sketches")


def profile(spark: SparkSession, job: BronzeJob) -> DataFrame:
    """One row for each column over all runs, from their stored sketches."""
    return sketches.summary(sketches.merge(stored_profiles(spark, job)))
