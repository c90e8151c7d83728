"""Layered tables: addressing, scans, discovery, previews and writes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import seek
from millrace.functions.stats import one_row


@dataclass(frozen=True)
class TableRef:
    """A table of one layer, kept as a Parquet directory ``root/layer/domain/source/entity``."""

    root: str
    layer: str
    domain: str
    source: str
    entity: str

    @property
    def path(self) -> str:
        return "/".join([self.root.rstrip("/"), self.layer, self.domain, self.source, self.entity])


def read_bronze(
    spark: SparkSession,
    ref: TableRef | str,
    mode: str = "full",
    watermark_col: str | None = None,
    watermark_value: object = None,
) -> DataFrame:
    """Recursive Parquet scan; ``mode="incremental"`` keeps rows strictly above the watermark.

    The comparison is on the bare column, so it reaches the scan as a pushed filter.
    """
    path = ref.path if isinstance(ref, TableRef) else ref
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    if mode == "incremental":
        if watermark_col is None:
            raise ValueError("incremental reads need watermark_col")
        if watermark_value is not None:
            df = df.filter(F.col(watermark_col) > F.lit(watermark_value))
    elif mode != "full":
        raise ValueError(f"unknown mode {mode!r}")
    return df


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalogued table or view."""
    return spark.table(name)


def table_info(spark: SparkSession, name: str) -> DataFrame:
    """One row: name, column names and row count of a catalogued table."""
    df = spark.table(name)
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        "row_count",
    )


def preview(df: DataFrame, key: str | Sequence[str], limit: int, offset: int = 0, held: int = seek.HELD) -> DataFrame:
    """One page of rows in key order, however deep, with the size of the whole table in ``total_rows``."""
    keys = [key] if isinstance(key, str) else list(key)
    total = one_row(df, n=F.count("*"))["n"]
    return seek.page(df, [seek.By(k) for k in keys], limit, offset, held).withColumn("total_rows", total)


def discover_tables(spark: SparkSession, root: str) -> DataFrame:
    """``source/table`` folders below ``root`` that hold Parquet files, with file counts.

    Hidden folders and ``quality_reports`` are left out.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select(F.regexp_replace("path", r"^\w+:/*", "/").alias("path"), "length")
    )
    below = F.regexp_replace(F.col("path"), "^" + _quoted(root), "")
    parts = F.filter(F.split(below, "/"), lambda p: p != "")
    return (
        files.withColumn("_parts", parts)
        .filter((F.size("_parts") >= 3) & ~F.exists("_parts", lambda p: p.startswith(".") | (p == "quality_reports")))
        .groupBy(F.get("_parts", F.lit(0)).alias("source"), F.get("_parts", F.lit(1)).alias("table"))
        .agg(F.count("*").alias("file_count"), F.sum("length").alias("bytes"))
    )


def _quoted(root: str) -> str:
    path = root.split(":", 1)[-1] if "://" in root or root.startswith("file:") else root
    return "/?\\Q" + "/" + path.strip("/") + "\\E"


def write_table(df: DataFrame, name: str, mode: str = "full", partition_by: Sequence[str] | None = None) -> None:
    """Full → create or replace; incremental → append. Snappy Parquet, optionally partitioned."""
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown mode {mode!r}")
    writer = df.write.format("parquet").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.mode("overwrite" if mode == "full" else "append").saveAsTable(name)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None) -> None:
    """Overwrite ``path`` with the rows in the given format."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, one object per row."""
    df.write.mode("overwrite").json(path)
