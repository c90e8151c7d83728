"""Range-partitioned and incremental JDBC reads, and the split points they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.order import values_at
from millrace.functions.stats import one_row


def jdbc_options(
    url: str,
    table: str,
    part_col: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    n: int = 1,
    since: tuple[str, object] | None = None,
    fetch_size: int = 10_000,
    min_keys: int = 0,
) -> dict[str, str]:
    """Reader options: ``[lower, upper]`` cut into ``n`` ranges, read serially when it holds fewer than ``min_keys``.

    ``since=(column, value)`` reads only rows strictly above the value; the filter runs in the database.
    """
    source = table
    if since is not None:
        column, value = since
        literal = str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
        source = f"(SELECT * FROM {table} WHERE {column} > {literal}) AS incremental"
    options = {"url": url, "dbtable": source, "fetchsize": str(fetch_size)}
    splittable = part_col is not None and lower is not None and upper is not None
    if splittable and n > 1 and upper - lower + 1 >= max(min_keys, 2):
        options |= {
            "partitionColumn": part_col,
            "lowerBound": str(lower),
            "upperBound": str(upper + 1),
            "numPartitions": str(n),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, part_col: str | None = None, n: int = 8, **kw) -> DataFrame:
    """JDBC scan; the key bounds are asked from the database when they are not given."""
    if part_col and "lower" not in kw:
        bounds = (
            spark.read.format("jdbc")
            .options(url=url, query=f"SELECT MIN({part_col}) AS lo, MAX({part_col}) AS hi FROM {table}")
            .load()
            .first()
        )
        kw["lower"], kw["upper"] = bounds["lo"], bounds["hi"]
    return spark.read.format("jdbc").options(**jdbc_options(url, table, part_col, n=n, **kw)).load()


def partition_bounds(df: DataFrame, col: str, n: int) -> DataFrame:
    """Split points with equal row counts: the value at every ``floor(total / n)``-th row, then the last.

    A table with fewer than ``n`` rows has a split for each row. Rows: ``split``, ``bound``.
    """
    total = one_row(df, n=F.count("*"))["n"]
    step = F.greatest(F.floor(total / n), F.lit(1))
    none = F.array().cast("array<bigint>")

    def splits(start: Column, end: Column) -> Column:
        first, last = F.ceil(start / step), F.least(F.floor((end - 1) / step), F.lit(n - 1))
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(none)
        final = F.when(end == total, F.array(F.lit(n).cast("bigint"))).otherwise(none)
        return F.concat(starts, final)

    hits = values_at(df, col, splits)
    return hits.select(F.col("pick").cast("int").alias("split"), F.col("value").alias("bound"))


def range_predicates(col: str, bounds: list[object]) -> list[str]:
    """WHERE clauses for ``spark.read.jdbc(predicates=…)`` covering all keys, one per split."""
    cuts = bounds[1:-1]
    if not cuts:
        return ["1=1"]
    first = f"{col} < {cuts[0]} OR {col} IS NULL"
    middle = [f"{col} >= {a} AND {col} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [first, *middle, f"{col} >= {cuts[-1]}"]
