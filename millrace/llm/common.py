"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Arrow batches are cut by bytes, so that many long texts never sit in one batch.
BATCH_BYTES = str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id long, text binary); a null text becomes empty."""
    return df.select(
        col(id_col).cast("long").alias("doc_id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, fn) -> Iterator[pa.RecordBatch]:
    """Apply ``fn(text bytes) -> tuple`` to every (id, text) row and put the id before the tuple."""
    for batch in batches:
        made = [fn(text) for text in batch.column(1).to_pylist()]
        columns = [list(c) for c in zip(*made)] if made else [[] for _ in schema.names[1:]]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)


def remainder(id_column: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % n, F.lit(0).cast("long"))


def hash_sample(df: DataFrame, key: list[str], rows: int, by: str | None = None, groups: int = 1000, distinct: bool = False) -> DataFrame:
    """At most ``rows`` rows (for each value of ``by``), the first by a hash of ``key``; the same on every run.

    The rows are counted first, and only those below a hash threshold that leaves about twice as many as wanted are
    ranked, so what one task sorts does not grow with the table. Of the values of ``by`` the ``groups`` most frequent are
    drawn from. With ``distinct`` rows with the same key (and ``by``) count as one, however many there are; their number is
    then taken from a sketch.
    """
    size = F.approx_count_distinct(F.xxhash64(*key), 0.02) if distinct else F.count(F.lit(1))
    drawn = df.withColumn("_hash", F.xxhash64(*key))
    if by:
        sizes = df.groupBy(by).agg(size.alias("_size")).orderBy(F.col("_size").desc(), by).limit(groups)
        sized = drawn.join(sizes, by)
    else:
        sized = drawn.withColumn("_size", F.lit(df.agg(size).first()[0]))
    share = F.when(F.col("_size") <= 4 * rows + 60, 1.0).otherwise(F.lit(2.0 * rows + 30) / F.col("_size"))
    near = sized.where(F.shiftrightunsigned("_hash", 11) < share * float(1 << 53))
    if distinct:
        near = near.dropDuplicates([*key, *([by] if by else [])])
    if not by:
        return near.orderBy("_hash", *key).limit(rows).select(*df.columns)
    first = Window.partitionBy(by).orderBy("_hash", *key)
    return near.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= rows).select(*df.columns)
