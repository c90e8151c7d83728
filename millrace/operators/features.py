"""Catalogue operations that derive columns: dates, text parts, arithmetic, categories, reshaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.scalars import as_list, exact
from millrace.operators.encoding import MAX_ONE_HOT, distinct_values

DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "quarter": F.quarter,
    "dayofweek": F.dayofweek,
}


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Long and double as epoch milliseconds, strings parsed, dates and timestamps as they are."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.LongType, T.DoubleType)):
        return F.timestamp_millis(exact(name).cast("bigint"))
    if isinstance(kind, T.StringType):
        return exact(name).try_cast("timestamp")
    return exact(name)


def extract_datetime(df: DataFrame, column: str, parts: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """``<column>_<part>`` columns; weeks start on Sunday = 1."""
    value = as_timestamp(df, column)
    return df.withColumns({f"{column}_{p}": DATE_PARTS[p](value) for p in parts})


def calculate_age(df: DataFrame, date_column: str, reference_date: str | None = None) -> DataFrame:
    """Whole years and days from the date to the reference date."""
    ref = F.lit(reference_date).cast("date") if reference_date else F.current_date()
    day = F.to_date(as_timestamp(df, date_column))
    years = F.floor(F.months_between(ref, day) / 12).cast("int")
    return df.withColumns({f"{date_column}_age_years": years, f"{date_column}_age_days": F.datediff(ref, day)})


COMBINE = {
    "sum": lambda cols: reduce(lambda a, b: a + b, cols),
    "diff": lambda cols: reduce(lambda a, b: a - b, cols),
    "product": lambda cols: reduce(lambda a, b: a * b, cols),
    "ratio": lambda cols: reduce(F.try_divide, cols),
    "concat": lambda cols: F.concat_ws("_", *[c.cast("string") for c in cols]),
}


def combine_features(
    df: DataFrame, columns: str | Sequence[str], operation: str = "concat", new_name: str = "combined"
) -> DataFrame:
    return df.withColumn(new_name, COMBINE[operation]([exact(c) for c in as_list(columns)]))


def polynomial_features(df: DataFrame, columns: str | Sequence[str], degree: int = 2) -> DataFrame:
    """``<column>_pow2`` up to the degree."""
    return df.withColumns({f"{c}_pow{d}": F.pow(exact(c), F.lit(d)) for c in as_list(columns) for d in range(2, degree + 1)})


def interaction_features(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """``<a>_x_<b>`` products of all column pairs."""
    return df.withColumns({f"{a}_x_{b}": exact(a) * exact(b) for a, b in combinations(as_list(columns), 2)})


def split_column(df: DataFrame, column: str, delimiter: str, into: int = 2) -> DataFrame:
    """``<column>_part1…n``; the delimiter is plain text, missing parts are NULL."""
    parts = F.split(exact(column), re.escape(delimiter), -1)
    return df.withColumns({f"{column}_part{i + 1}": F.get(parts, F.lit(i)) for i in range(into)})


def extract_regex(df: DataFrame, column: str, pattern: str, group: int = 1, name: str | None = None) -> DataFrame:
    """One group of the first match; NULL when there is none."""
    found = F.when(exact(column).rlike(pattern), F.regexp_extract(exact(column), pattern, group))
    return df.withColumn(name or f"{column}_extracted", found)


def parse_json(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``<column>_<key>`` text columns; keys may be paths such as ``a.b``."""
    return df.withColumns({f"{column}_{k.replace('.', '_')}": F.get_json_object(column, f"$.{k}") for k in keys})


URL_PARTS = {"protocol": "PROTOCOL", "host": "HOST", "path": "PATH", "query": "QUERY"}


def parse_url(df: DataFrame, column: str, parts: Sequence[str] = ("protocol", "host", "path", "query")) -> DataFrame:
    return df.withColumns({f"{column}_{p}": F.try_parse_url(exact(column), F.lit(URL_PARTS[p])) for p in parts})


def log_transform(df: DataFrame, columns: str | Sequence[str], base: float | None = None) -> DataFrame:
    """``<column>_log``, natural or to a base; NULL for x ≤ 0."""

    def log(c: str) -> Column:
        return F.log(exact(c)) if base is None else F.log(float(base), exact(c))

    return df.withColumns({f"{c}_log": F.when(exact(c) > 0, log(c)) for c in as_list(columns)})


def sqrt_transform(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Square root in place; NULL for x < 0."""
    return df.withColumns({c: F.when(exact(c) >= 0, F.sqrt(exact(c))) for c in as_list(columns)})


def power_transform(df: DataFrame, columns: str | Sequence[str], exponent: float = 2.0) -> DataFrame:
    """``<column>_power``; NULL where the power is not a real number."""
    value = {c: F.pow(exact(c), F.lit(float(exponent))) for c in as_list(columns)}
    return df.withColumns({f"{c}_power": F.when(~F.isnan(v), v) for c, v in value.items()})


def reciprocal(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """``<column>_reciprocal``; 0 → NULL."""
    return df.withColumns({f"{c}_reciprocal": F.try_divide(F.lit(1.0), exact(c)) for c in as_list(columns)})


def box_cox(df: DataFrame, columns: str | Sequence[str], lambda_: float = 0.0) -> DataFrame:
    """ln x for λ = 0, else (x^λ - 1) / λ; only for x > 0."""

    def value(c: str) -> Column:
        return F.log(exact(c)) if lambda_ == 0 else (F.pow(exact(c), F.lit(float(lambda_))) - 1) / lambda_

    return df.withColumns({f"{c}_boxcox": F.when(exact(c) > 0, value(c)) for c in as_list(columns)})


def round_values(df: DataFrame, columns: str | Sequence[str], precision: int = 2) -> DataFrame:
    """Half-up rounding in place."""
    return df.withColumns({c: F.round(c, precision) for c in as_list(columns)})


def categorize(
    df: DataFrame, columns: str | Sequence[str], categories: Mapping[str, str], default: str = "Other"
) -> DataFrame:
    """``<column>_category`` by a value → category map."""
    lookup = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
    return df.withColumns(
        {
            f"{c}_category": F.coalesce(F.try_element_at(lookup, exact(c).cast("string")), F.lit(default))
            for c in as_list(columns)
        }
    )


def hierarchy_rollup(
    df: DataFrame,
    column: str,
    level: str,
    mapping: DataFrame,
    aggregates: Mapping[str, Column] | None = None,
    subtotals: bool = False,
) -> DataFrame:
    """Add the parent ``level`` of ``column`` from a (column, level) table, then aggregate there if asked.

    With ``subtotals`` the result has one row per (level, column), per level, and in total.
    """
    parents = mapping.select(F.col(column).alias("_child"), F.col(level)).dropDuplicates(["_child"])
    mapped = df.join(parents, F.col(column) == F.col("_child"), "left").drop("_child")
    if not aggregates:
        return mapped
    groups = mapped.rollup(level, column) if subtotals else mapped.groupBy(level)
    return groups.agg(*[c.alias(n) for n, c in aggregates.items()])


PIVOT_AGG = {"first": F.first, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def pivot_wide(
    df: DataFrame,
    index: str | Sequence[str],
    columns: str,
    values: str,
    agg: str = "first",
    categories: Sequence | None = None,
    max_categories: int = MAX_ONE_HOT,
) -> DataFrame:
    """One row per index, one column per category; more than ``max_categories`` found values are refused."""
    wanted = list(categories) if categories is not None else distinct_values(df, columns, max_categories)
    return df.groupBy(*as_list(index)).pivot(columns, wanted).agg(PIVOT_AGG[agg](values))


def melt_long(
    df: DataFrame,
    id_vars: str | Sequence[str],
    value_vars: str | Sequence[str],
    variable: str = "variable",
    value: str = "value",
) -> DataFrame:
    """Wide → (id, variable, value)."""
    return df.unpivot(as_list(id_vars), as_list(value_vars), variable, value)
