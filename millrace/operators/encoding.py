"""Catalogue operations that encode categories.

Category tables come from a partial aggregate. They are joined back without a broadcast hint: Spark
broadcasts them when their size is under its threshold and shuffles otherwise, splitting hot categories.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.functions.order import POS, sorted_positions
from millrace.functions.scalars import as_list, exact
from millrace.functions.stats import one_row

# Categories that may become columns, unless the caller says otherwise: each is a column of the plan.
MAX_ONE_HOT = 1000


def category_index(df: DataFrame, column: str) -> DataFrame:
    """Rows ``(column, index)``: 0 for the most frequent value, ties by value.

    Numbered through a distributed sort, so the category list has no size limit.
    """
    counts = df.filter(exact(column).isNotNull()).groupBy(exact(column)).agg(F.count("*").alias("_n"))
    placed = sorted_positions(counts, F.col("_n").desc(), exact(column))
    return placed.select(exact(column), F.col(POS).alias("_index"))


def distinct_values(df: DataFrame, column: str, limit: int = MAX_ONE_HOT) -> list:
    """Sorted distinct values, for operators that make one column per value."""
    rows = df.filter(exact(column).isNotNull()).select(exact(column).alias("_v")).distinct().orderBy("_v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; use label_encode or one_hot_vector")
    return [r[0] for r in rows]


def one_hot(
    df: DataFrame,
    columns: str | Sequence[str],
    prefix: str | None = None,
    categories: Mapping[str, Sequence] | None = None,
    max_categories: int = MAX_ONE_HOT,
) -> DataFrame:
    """A 0/1 column ``<prefix>_<value>`` per category, in value order; more than ``max_categories`` are refused."""
    out = {}
    for c in as_list(columns):
        values = (categories or {}).get(c) or distinct_values(df, c, max_categories)
        out |= {f"{prefix or c}_{v}": F.when(exact(c) == F.lit(v), 1).otherwise(0) for v in values}
    return df.withColumns(out)


def one_hot_vector(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """A sparse vector column over all categories, for domains too wide for columns."""
    from pyspark.ml.feature import OneHotEncoder

    indexed = label_encode(df.filter(exact(column).isNotNull()), column)
    model = OneHotEncoder(inputCol=f"{column}_encoded", outputCol=name or f"{column}_vector", dropLast=False)
    return model.fit(indexed).transform(indexed)


def label_encode(
    df: DataFrame, columns: str | Sequence[str], mapping: Mapping[str, int] | None = None, suffix: str = "_encoded"
) -> DataFrame:
    """Category → index by descending frequency, or by a given mapping (unknown → NULL)."""
    for c in as_list(columns):
        if mapping is not None:
            lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
            df = df.withColumn(f"{c}{suffix}", F.try_element_at(lookup, exact(c)).cast("bigint"))
        else:
            index = category_index(df, c).withColumnRenamed("_index", f"{c}{suffix}")
            df = df.join(index, c, "left")
    return df


def binary_encode(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """The category index as bit columns ``<column>_bit0…``, lowest bit first."""
    for c in as_list(columns):
        index = category_index(df, c)
        size = index.agg(F.count("*")).first()[0]
        bits = max(1, (size - 1).bit_length())
        df = df.join(index, c, "left")
        df = df.withColumns(
            {f"{c}_bit{b}": F.shiftright("_index", b).bitwiseAND(F.lit(1)).cast("int") for b in range(bits)}
        ).drop("_index")
    return df


def target_encode(
    df: DataFrame, columns: str | Sequence[str], target: str, smoothing: float = 0.0, suffix: str = "_target"
) -> DataFrame:
    """Category → mean target, pulled towards the overall mean by ``smoothing`` virtual rows."""
    overall = one_row(df, mean=F.avg(exact(target)))["mean"]
    for c in as_list(columns):
        sums = df.groupBy(exact(c)).agg(F.sum(exact(target)).alias("_sum"), F.count(exact(target)).alias("_n"))
        encoded = sums.select(
            exact(c).alias("_key"),
            F.try_divide(F.col("_sum") + overall * smoothing, F.col("_n") + smoothing).alias(f"{c}{suffix}"),
        )
        df = df.join(encoded, exact(c).eqNullSafe(F.col("_key")), "left").drop("_key")
    return df


def frequency_encode(df: DataFrame, columns: str | Sequence[str], suffix: str = "_frequency") -> DataFrame:
    """Category → its share of the rows."""
    total = one_row(df, n=F.count("*"))["n"]
    for c in as_list(columns):
        counts = df.groupBy(exact(c)).agg(F.count("*").alias("_n"))
        shares = counts.select(exact(c).alias("_key"), (F.col("_n") / total).alias(f"{c}{suffix}"))
        df = df.join(shares, exact(c).eqNullSafe(F.col("_key")), "left").drop("_key")
    return df
