"""Profiles and exploratory reports: one or two aggregation passes per report, never a row to the driver.

NaN counts as missing in floating columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.functions.scalars import (
    EMAIL_PATTERN,
    FLOATING,
    INTEGRAL,
    NUMERIC,
    TEMPORAL,
    clean_number,
    columns_of,
    exact,
    missing,
)
from millrace.functions.stats import one_row, quantiles, sample_kurtosis, sample_skewness, with_distinct_counts
from millrace.operators.binning import width_bin
from millrace.session import stage


def _value(df: DataFrame, name: str) -> Column:
    """The cell with NaN read as NULL."""
    column = exact(name)
    return F.when(~F.isnan(column), column) if isinstance(df.schema[name].dataType, FLOATING) else column


def _inline(df: DataFrame, entries: list[Column]) -> DataFrame:
    """One aggregate whose result is one row per entry."""
    return df.agg(F.array(*entries).alias("_e")).select(F.inline("_e"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows and repeats after the first (rows - distinct rows)."""
    groups = df.groupBy(*[exact(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicates, missing cells, and their shares in %."""
    groups = df.groupBy(*[exact(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    holes = sum([missing(df, c).cast("bigint") for c in df.columns], F.lit(0).cast("bigint"))
    row = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("_n") * holes), F.lit(0)).alias("missing_cells"),
    ).withColumn("column_count", F.lit(len(df.columns)))
    cells = F.col("row_count") * F.col("column_count")

    def percent(part: str, whole: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(part) * F.lit(100.0), whole), F.lit(0.0)), 2)

    return row.withColumns(
        {
            "duplicate_percentage": percent("duplicate_rows", F.col("row_count")),
            "missing_percentage": percent("missing_cells", cells),
        }
    ).withColumn("completeness_score", F.round(F.lit(100.0) - F.col("missing_percentage"), 2))


def numeric_profile(df: DataFrame, columns: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """One row per number column: range, moments, quartiles, sign counts."""
    names = list(columns) or columns_of(df, *NUMERIC)
    q = quantiles(df, names, [0.25, 0.5, 0.75], approx)
    entries = []
    for c in names:
        v = clean_number(exact(c))
        low, mid, high = (F.lit(q[(c, p)]).cast("double") for p in (0.25, 0.5, 0.75))
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(v).alias("count"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.avg(v).alias("mean"),
                F.first(mid).alias("median"),
                F.stddev_samp(v).alias("std"),
                F.var_samp(v).alias("variance"),
                F.first(low).alias("q25"),
                F.first(high).alias("q75"),
                F.first(high - low).alias("iqr"),
                sample_skewness(v).alias("skewness"),
                sample_kurtosis(v).alias("kurtosis"),
                F.count_if(v == 0).alias("zeros"),
                F.count_if(v < 0).alias("negatives"),
                F.count_if(v > 0).alias("positives"),
            )
        )
    return _inline(df, entries)


def value_counts(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(column_name, value, count) of the text columns: one shuffle for all columns, pre-aggregated."""
    names = list(columns) or columns_of(df, T.StringType)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), exact(c).cast("string").alias("value")) for c in names])
    return df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count("*").alias("count"))


def categorical_profile(df: DataFrame, columns: Sequence[str] = (), top: int = 10, high_above: int = 50) -> DataFrame:
    """One row per text column: unique, most and least frequent value, lengths, the ``top`` values with counts.

    Columns with more than ``high_above`` different values are labelled "high"; the label changes nothing else. Ties are
    ordered by value.
    """
    counts = value_counts(df, columns)
    # The two ends of each frequency list come from bounded aggregates, not from an unbounded list.
    present = counts.filter(F.col("value").isNotNull())
    best = F.struct(-F.col("count"), F.col("value"))
    ranked = present.withColumn("_rn", F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("count").desc(), "value")))
    leading = (
        ranked.filter(F.col("_rn") <= top)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "value", "count"))).alias("_top"))
    )
    summary = counts.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("count")).otherwise(0)).alias("non_null_count"),
        F.min(F.when(F.col("value").isNotNull(), best)).alias("_best"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("count", "value"))).alias("_worst"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.try_divide(F.sum(F.length("value") * F.col("count")), F.sum(F.when(F.col("value").isNotNull(), F.col("count")))).alias("avg_length"),
    )
    joined = summary.join(leading, "column_name", "left")
    high = F.col("unique_count") > high_above
    listed = F.transform("_top", lambda e: F.concat(e["value"], F.lit(":"), e["count"].cast("string")))
    return joined.select(
        "column_name",
        "unique_count",
        "null_count",
        "non_null_count",
        F.col("_best.value").alias("most_frequent"),
        (-F.col("_best.col1")).alias("most_frequent_count"),
        F.col("_worst.value").alias("least_frequent"),
        F.col("_worst.count").alias("least_frequent_count"),
        "min_length",
        "max_length",
        "avg_length",
        F.when(high, F.lit("high")).otherwise(F.lit("low")).alias("cardinality"),
        listed.alias("values"),
    )


def datetime_profile(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One row per date column: first, last, days between."""
    names = list(columns) or columns_of(df, *TEMPORAL)
    return _inline(
        df,
        [
            F.struct(
                F.lit(c).alias("column_name"),
                F.min(v).cast("timestamp_ntz").alias("min"),
                F.max(v).cast("timestamp_ntz").alias("max"),
                F.floor((F.max(v).cast("timestamp").cast("double") - F.min(v).cast("timestamp").cast("double")) / 86400).alias("range_days"),
                F.count_if(v.isNull()).alias("null_count"),
            )
            for c in names
            for v in [exact(c)]
        ],
    )


def describe(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: non-null, null, null %, unique, unique %, kind (booleans are categorical)."""

    def kind(t: T.DataType) -> str:
        if isinstance(t, NUMERIC):
            return "numeric"
        return "datetime" if isinstance(t, TEMPORAL) else "categorical"

    basics = _inline(
        df,
        [
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(kind(f.dataType)).alias("kind"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.count("*").alias("row_count"),
                F.count_if(missing(df, f.name)).alias("null_count"),
            )
            for f in df.schema.fields
        ],
    )
    rows = with_distinct_counts(basics, df, df.columns, "unique_count", approx)
    share = lambda part: F.round(F.coalesce(F.try_divide(part * F.lit(100.0), F.col("row_count")), F.lit(0.0)), 2)
    return rows.withColumns(
        {
            "non_null_count": F.col("row_count") - F.col("null_count"),
            "null_percentage": share(F.col("null_count")),
            "unique_percentage": share(F.col("unique_count")),
        }
    )


# Weights of the quality score.
COMPLETENESS_WEIGHT, UNIQUENESS_WEIGHT, VALIDITY_WEIGHT = 0.4, 0.3, 0.3


def quality_score(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: completeness, uniqueness, validity (100 - outliers per row in %, not below 0), total."""
    numbers = columns_of(df, *NUMERIC)
    hits = outlier_counts(df, numbers, approx=approx) if numbers else None
    base = overview(df)
    outliers = hits.agg(F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("s")).scalar() if hits is not None else F.lit(0)
    rows, cells = F.col("row_count"), F.col("row_count") * F.col("column_count")
    whole = lambda part, n: F.lit(100.0) - F.coalesce(F.try_divide(part * F.lit(100.0), n), F.lit(0.0))
    parts = base.select(
        whole(F.col("missing_cells"), cells).alias("completeness"),
        whole(F.col("duplicate_rows"), rows).alias("uniqueness"),
        F.greatest(F.lit(0.0), whole(outliers, rows)).alias("validity"),
    )
    total = (
        F.col("completeness") * COMPLETENESS_WEIGHT
        + F.col("uniqueness") * UNIQUENESS_WEIGHT
        + F.col("validity") * VALIDITY_WEIGHT
    )
    return parts.withColumn("quality_score", F.round(total, 2))


def gold_score(df: DataFrame) -> DataFrame:
    """One row: completeness % - min(duplicate %, 20), not below 0."""
    base = overview(df)
    cells = F.col("row_count") * F.col("column_count")
    complete = F.lit(100.0) - F.coalesce(F.try_divide(F.col("missing_cells") * F.lit(100.0), cells), F.lit(0.0))
    repeated = F.coalesce(F.try_divide(F.col("duplicate_rows") * F.lit(100.0), F.col("row_count")), F.lit(0.0))
    score = F.greatest(F.lit(0.0), complete - F.least(repeated, F.lit(20.0)))
    return base.select("row_count", F.round(complete, 4).alias("completeness"), F.round(score, 4).alias("quality_score"))


def missing_by_column(df: DataFrame) -> DataFrame:
    return _inline(
        df,
        [
            F.struct(F.lit(c).alias("column_name"), F.count_if(missing(df, c)).alias("missing_count"))
            for c in df.columns
        ],
    )


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(bin, low edge, high edge, count) of equal-width bins, the last closed; every bin has a row."""
    value = clean_number(exact(col))
    numbers = df.select(value.alias("_v")).filter("_v IS NOT NULL")
    s = one_row(numbers, lo=F.min("_v"), hi=F.max("_v"))
    counts = (
        numbers.groupBy(width_bin(F.col("_v"), s["lo"], s["hi"], bins).alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (s["hi"] - s["lo"]) / bins
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (s["lo"] + width * (F.col("bin") - 1)).alias("low_edge"),
        F.when(F.col("bin") == bins, s["hi"]).otherwise(s["lo"] + width * F.col("bin")).alias("high_edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def skew_label(df: DataFrame, columns: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Per number column: right, left or symmetric by mean against median; constant when there is no spread."""
    p = numeric_profile(df, columns, approx)
    label = (
        F.when(F.col("min") == F.col("max"), "constant")
        .when(F.col("mean") > F.col("median"), "right")
        .when(F.col("mean") < F.col("median"), "left")
        .otherwise("symmetric")
    )
    return p.select("column_name", "mean", "median", label.alias("skew"))


def _skew_z(n: Column, g1: Column) -> Column:
    """D'Agostino's normal score of the skewness."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    return delta * F.asinh(F.when(y == 0, 1.0).otherwise(y) / alpha)


def _kurt_z(n: Column, b2: Column) -> Column:
    """Anscombe and Glynn's normal score of the kurtosis (b2 not reduced by 3)."""
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(denom) * F.pow((1 - 2 / a) / F.abs(denom), F.lit(1.0 / 3.0))
    return (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))


def distribution_type(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Per number column: insufficient_data (n < 8), normal (K² test p > 0.05), else by skewness ±0.5."""
    names = list(columns) or columns_of(df, *NUMERIC)
    entries = []
    for c in names:
        v = clean_number(exact(c))
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(v).cast("double").alias("_n"),
                F.skewness(v).alias("_g1"),
                (F.kurtosis(v) + 3).alias("_b2"),
                sample_skewness(v).alias("skewness"),
                (F.var_pop(v) > 0).alias("_spread"),
            )
        )
    rows = _inline(df, entries)
    n = F.col("_n")
    usable = (n >= 8) & F.col("_spread")
    k2 = F.pow(_skew_z(n, F.col("_g1")), F.lit(2)) + F.pow(_kurt_z(n, F.col("_b2")), F.lit(2))
    rows = rows.withColumn("p_value", F.when(usable, F.exp(-k2 / 2)))
    skew = F.coalesce(F.col("skewness"), F.lit(0.0))
    label = (
        F.when(n < 8, "insufficient_data")
        .when(F.col("p_value") > 0.05, "normal")
        .when(F.abs(skew) < 0.5, "symmetric")
        .when(skew > 0.5, "right_skewed")
        .otherwise("left_skewed")
    )
    return rows.select("column_name", "skewness", "p_value", label.alias("distribution"))


# Columns up to which each pair is an expression of its own.
GRAM_COLUMNS = 24


def gram_correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson r of every pair from the products of all columns with each other, over the rows where both are present.

    For each column a row holds its distance from the mean (0 where missing), whether it is present, and the square of that
    distance. The Gram matrix of these, added up in the tasks, has every sum that the pairs need; what reaches the driver is
    that matrix and what goes back is a row for each pair.
    """
    number = [clean_number(exact(c)) for c in names]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(number)]).first()
    far = [F.coalesce(v - F.lit(means[f"m{i}"]).cast("double"), F.lit(0.0)) for i, v in enumerate(number)]
    there = [v.isNotNull().cast("double") for v in number]
    cells = F.array(*far, *there, *[x * x for x in far])
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(cells).alias("v")), "v")
    k = len(names)
    empty = df.isEmpty()
    g = np.zeros((3 * k, 3 * k)) if empty else RowMatrix(vectors, 0, 3 * k).computeGramianMatrix().toArray()
    n, product = g[k : 2 * k, k : 2 * k], g[:k, :k]
    total, square = g[:k, k : 2 * k], g[2 * k :, k : 2 * k]  # of the row's column, where the other one is present
    with np.errstate(all="ignore"):
        own = square - total * total / n
        own = np.where(own > 1e-12 * square, own, np.nan)  # no spread but rounding
        r = np.clip((product - total * total.T / n) / np.sqrt(own * own.T), -1, 1)
    rows = [(names[i], names[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in combinations(range(k), 2)]
    return df.sparkSession.createDataFrame(rows, "column1 string, column2 string, correlation double")


def _corr(a: Column, b: Column) -> Column:
    """Pearson r where both are present; NULL where one of them does not vary."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlations(df: DataFrame, columns: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    """Pearson r of every pair of number columns over the rows where both are present, in one aggregate.

    With a threshold only pairs with |r| above it, rounded to three digits. Many columns share one Gram matrix instead of an
    expression for each pair.
    """
    names = list(columns) or columns_of(df, *NUMERIC)
    if len(names) > GRAM_COLUMNS:
        pairs = gram_correlations(df, names)
        if threshold is None:
            return pairs
        return pairs.filter(F.abs("correlation") > threshold).withColumn("correlation", F.round("correlation", 3))
    number = {c: clean_number(exact(c)) for c in names}
    entries = [
        F.struct(
            F.lit(a).alias("column1"), F.lit(b).alias("column2"), _corr(number[a], number[b]).alias("correlation")
        )
        for a, b in combinations(names, 2)
    ]
    if not entries:
        return df.sparkSession.createDataFrame([], "column1 string, column2 string, correlation double")
    pairs = _inline(df, entries)
    if threshold is None:
        return pairs
    return pairs.filter(F.abs("correlation") > threshold).withColumn("correlation", F.round("correlation", 3))


def outlier_counts(
    df: DataFrame, columns: Sequence[str] = (), k: float = 1.5, approx: bool = False, strict: bool = False
) -> DataFrame:
    """Per number column: IQR fences, outliers and their share of the present values.

    ``strict`` leaves out columns with fewer than four values or no spread.
    """
    names = list(columns) or columns_of(df, *NUMERIC)
    q = quantiles(df, names, [0.25, 0.75], approx)
    entries = []
    for c in names:
        low, high = q[(c, 0.25)], q[(c, 0.75)]
        if low is None or (strict and high == low):
            continue
        lo, hi = low - k * (high - low), high + k * (high - low)
        v = clean_number(exact(c))
        outside = (v < lo) | (v > hi)
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(v).alias("value_count"),
                F.count_if(outside).alias("outlier_count"),
                F.first(F.lit(lo)).alias("lower_bound"),
                F.first(F.lit(hi)).alias("upper_bound"),
                F.min(F.when(outside, v)).alias("lowest_outlier"),
                F.max(F.when(outside, v)).alias("highest_outlier"),
            )
        )
    if not entries:
        schema = "column_name string, value_count bigint, outlier_count bigint, lower_bound double, upper_bound double, lowest_outlier double, highest_outlier double"
        rows = df.sparkSession.createDataFrame([], schema)
    else:
        rows = _inline(df, entries)
    if strict:
        rows = rows.filter("value_count >= 4")
    return rows.withColumn(
        "outlier_percentage", F.round(F.try_divide(F.col("outlier_count") * F.lit(100.0), F.col("value_count")), 2)
    )


def outliers(df: DataFrame, columns: Sequence[str] = (), k: float = 1.5, samples: int = 5, approx: bool = False) -> DataFrame:
    """Columns that have outliers: count, %, fences and the ``samples`` smallest outlying values."""
    found = outlier_counts(df, columns, k, approx, strict=True).filter("outlier_count > 0")
    bounds = {r["column_name"]: (r["lower_bound"], r["upper_bound"]) for r in found.collect()}
    if not bounds:
        return found.withColumn("outlier_values", F.array().cast("array<double>"))
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), clean_number(exact(c)).alias("value")) for c in bounds]
    )
    out = F.lit(False)
    for c, (lo, hi) in bounds.items():
        out = out | ((F.col("column_name") == c) & ~F.col("value").between(lo, hi))


    ranked = (
        df.select(F.inline(cells))
        .filter(out)
        .withColumn("_rn", F.row_number().over(Window.partitionBy("column_name").orderBy("value")))
        .filter(F.col("_rn") <= samples)
    )
    values = ranked.groupBy("column_name").agg(F.array_sort(F.collect_list(F.round("value", 2))).alias("outlier_values"))
    return found.join(values, "column_name", "left")


DATE_WORDS = ["date", "time", "timestamp", "created", "updated"]


def temporal(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Per date column: range, distinct times, a batch-load warning, and the counts of all its months.

    Text columns with a date-like name take part when more than half of them parse.
    """
    dates = list(columns) or columns_of(df, *TEMPORAL)
    texts = [] if columns else [c for c in columns_of(df, T.StringType) if any(w in c.lower() for w in DATE_WORDS)]
    if texts:
        parsed = [F.avg(exact(c).try_cast("timestamp").isNotNull().cast("double")).alias(f"c{i}") for i, c in enumerate(texts)]
        shares = df.agg(*parsed).first()
        texts = [c for i, c in enumerate(texts) if (shares[i] or 0) > 0.5]
    names = dates + texts
    value = {c: (exact(c).try_cast("timestamp") if c in texts else exact(c)).cast("timestamp_ntz") for c in names}
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), value[c].alias("value")) for c in names])
    long = df.select(F.inline(cells))
    seconds = lambda c: c.cast("timestamp").cast("double")
    summary = (
        long.groupBy("column_name", "value").agg(F.count("*").alias("_n"))
        .groupBy("column_name")
        .agg(
            F.min("value").alias("min_date"),
            F.max("value").alias("max_date"),
            F.count("value").alias("unique_dates"),
            F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)).alias("null_count"),
        )
        .withColumn("range_days", F.floor((seconds(F.col("max_date")) - seconds(F.col("min_date"))) / 86400))
        .withColumn("warning", F.when(F.col("unique_dates") == 1, F.lit("All timestamps identical - batch load detected")))
    )
    monthly = (
        long.filter("value IS NOT NULL")
        .groupBy("column_name", F.date_format("value", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("count"))
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list(F.struct("month", "count"))).alias("monthly"))  # one entry per month
    )
    text = F.transform("monthly", lambda e: F.concat(e["month"], F.lit(":"), e["count"].cast("string")))
    return summary.join(monthly, "column_name", "left").withColumn("monthly", text)


def semantic_warnings(df: DataFrame, approx: bool = False) -> DataFrame:
    """Leading zeros in most values, too few valid emails, names with few different values."""
    texts = columns_of(df, T.StringType)
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, type string, severity string, measure double")
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("rows"),
            F.count(exact(c)).alias("present"),
            F.count_if(exact(c).rlike(r"^0\d+")).alias("zeros"),
            F.count_if(exact(c).rlike(EMAIL_PATTERN)).alias("emails"),
        )
        for c in texts
    ]
    rows = _inline(df, entries)
    names = [c for c in texts if "name" in c.lower()]
    if names:
        rows = with_distinct_counts(rows, df, names, "unique", approx)
    else:
        rows = rows.withColumn("unique", F.lit(None).cast("bigint"))
    name = F.lower("column_name")
    share = lambda part: F.try_divide(part, F.col("present"))
    none = F.lit(None).cast("struct<type:string,severity:string,measure:double>")

    def issue(cond: Column, kind: str, severity: str, measure: Column) -> Column:
        fields = [F.lit(kind).alias("type"), F.lit(severity).alias("severity"), measure.cast("double").alias("measure")]
        return F.when(cond, F.struct(*fields)).otherwise(none)

    valid = share(F.col("emails")) * 100
    unique = F.try_divide(F.col("unique"), F.col("rows"))
    issues = F.array_compact(
        F.array(
            issue(share(F.col("zeros")) > 0.5, "leading_zeros", "high", F.col("zeros")),
            issue(name.contains("email") & (valid < 95), "invalid_format", "medium", F.round(valid, 1)),
            issue(
                name.contains("name") & ~name.contains("file") & (unique < 0.1) & (F.col("rows") > 100),
                "synthetic_data",
                "low",
                F.round(unique, 3),
            ),
        )
    )
    return rows.select("column_name", F.inline(issues))


def uniqueness(df: DataFrame, approx: bool = False) -> DataFrame:
    """Columns whose values are all different, and integer keys without gaps (max - min + 1 = rows)."""
    whole = columns_of(df, *INTEGRAL)
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("rows"),
            ((F.max(exact(c)) - F.min(exact(c)) + 1).cast("bigint") if c in whole else F.lit(None).cast("bigint")).alias("span"),
        )
        for c in df.columns
    ]
    rows = with_distinct_counts(_inline(df, entries), df, df.columns, "unique", approx)
    rows = rows.filter((F.col("unique") == F.col("rows")) & (F.col("rows") > 0))
    signals = F.array_compact(
        F.array(
            F.lit("unique"),
            F.when((F.col("span") == F.col("rows")) & (F.col("rows") > 1), F.lit("sequential")),
        )
    )
    return rows.select("column_name", F.explode(signals).alias("signal"))


def patterns(df: DataFrame, approx: bool = False) -> DataFrame:
    """Constant (≤ 1 value), ID-like (> 95 % unique) and low-cardinality (< 10) columns."""
    d = describe(df, approx)
    enough = F.col("row_count") > 10
    labels = F.array_compact(
        F.array(
            F.when(F.col("unique_count") <= 1, F.lit("constant")),
            F.when((F.try_divide(F.col("unique_count"), F.col("row_count")) > 0.95) & enough, F.lit("potential_id")),
            F.when((F.col("unique_count") < 10) & enough, F.lit("low_cardinality")),
        )
    )
    return d.select("column_name", F.explode(labels).alias("pattern"))


def insights(df: DataFrame) -> DataFrame:
    """Messages about size, missing data, duplicates and zeros; one friendly line when all is well."""
    base = overview(df).select(
        "row_count",
        F.try_divide(F.col("missing_cells") * F.lit(100.0), F.col("row_count") * F.col("column_count")).alias("miss"),
        F.try_divide(F.col("duplicate_rows") * F.lit(100.0), F.col("row_count")).alias("dup"),
    )
    messages = base.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("row_count") > 1_000_000,
                        F.concat(F.lit("Large dataset with "), F.format_number("row_count", 0), F.lit(" rows - consider partitioning")),
                    ),
                    F.when(F.col("miss") > 10, F.concat(F.lit("High missing data rate: "), _one_digit("miss"), F.lit("% - review data collection"))),
                    F.when(F.col("dup") > 5, F.concat(F.lit("Significant duplicates: "), _one_digit("dup"), F.lit("% - verify data ingestion"))),
                )
            )
        ).alias("message")
    )
    numbers = columns_of(df, *NUMERIC)
    if numbers:
        zeros = _inline(
            df,
            [
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.try_divide(F.count_if(_value(df, c) == 0) * F.lit(100.0), F.count(_value(df, c))).alias("share"),
                )
                for c in numbers
            ],
        ).filter("share > 50")
        messages = messages.unionAll(
            zeros.select(F.concat(F.lit("Column '"), "column_name", F.lit("' has "), _one_digit("share"), F.lit("% zeros - verify validity")))
        )
    # At most three messages and one per column, so one task can hold them all.
    lines = messages.agg(F.collect_list("message").alias("m"))
    fine = F.array(F.lit("Data quality looks good - no major issues detected"))
    return lines.select(F.explode(F.when(F.size("m") == 0, fine).otherwise(F.col("m"))).alias("message"))


def _one_digit(name: str) -> Column:
    return F.format_number(F.col(name), 1)


def business_metrics(df: DataFrame, kind: str, roles: Mapping[str, str], approx: bool = False) -> DataFrame:
    """Metrics by kind of table. ``roles`` names the columns: amount and date, or patient and age."""
    if kind == "transaction":
        amount, date = roles["amount"], roles["date"]
        return df.agg(
            F.sum(amount).alias("total_transaction_amount"),
            F.avg(amount).alias("avg_transaction_amount"),
            F.max(amount).alias("max_transaction_amount"),
            F.min(date).alias("date_start"),
            F.max(date).alias("date_end"),
        )
    if kind == "patient":
        age = roles["age"]
        middle = quantiles(df, [age], [0.5], approx)[(age, 0.5)]
        return df.agg(
            F.count_distinct(roles["patient"]).alias("unique_patients"),
            F.avg(age).alias("avg_age"),
            F.min(age).cast("double").alias("min_age"),
            F.max(age).cast("double").alias("max_age"),
        ).withColumn("median_age", F.lit(middle).cast("double"))
    raise ValueError("kind must be 'transaction' or 'patient'")


def classify_table(df: DataFrame, table: str, approx: bool = False) -> DataFrame:
    """One row: FACT or DIMENSION with confidence, key candidates, and Star or Snowflake."""
    described = describe(df, approx)
    lower = F.lower("column_name")
    unique = F.try_divide(F.col("unique_count"), F.col("row_count"))
    nulls = F.try_divide(F.col("null_count"), F.col("row_count"))
    is_id = lower.contains("_id") | lower.endswith("id")
    marked = described.select(
        "column_name",
        "row_count",
        "unique_count",
        F.when((unique > 0.95) & (nulls < 0.01), F.struct("column_name", (unique * (1 - nulls)).alias("confidence"))).alias("pk"),
        (is_id & (unique < 0.5)).alias("fk"),
        ((F.col("kind") == "numeric") & ~is_id).alias("measure"),
        F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column_name")).alias("position"),
    )
    # One row per column of the table: a bounded input for one task.
    row = marked.agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.array_sort(F.collect_list(F.col("pk.column_name"))).alias("primary_keys"),
        F.array_sort(F.collect_list(F.when(F.col("fk"), F.col("column_name")))).alias("foreign_keys"),
        F.count_if("measure").alias("numeric_measures"),
        F.array_sort(F.collect_list(F.when(F.col("fk"), F.struct("position", "unique_count")))).alias("_cards"),
    )
    fk = F.size("foreign_keys")
    fact = (fk >= 2) & (F.col("numeric_measures") >= 2)
    dimension = (F.col("row_count") < 10_000) & (F.size("primary_keys") > 0)
    kind = F.when(fact, "FACT").when(dimension, "DIMENSION").when(F.col("row_count") > 1000, "FACT").otherwise("DIMENSION")
    # Small leading keys mean flat dimensions; otherwise a very wide key means normalised ones.
    leading_wide = F.exists(F.slice("_cards", 1, 3), lambda c: c["unique_count"] >= 100)
    any_huge = F.exists("_cards", lambda c: c["unique_count"] > 1000)
    snowflake = (F.col("table_type") == "FACT") & leading_wide & any_huge
    return (
        row.withColumn("table_name", F.lit(table))
        .withColumn("table_type", kind)
        .withColumn("confidence", F.when(fact, 0.8).when(dimension, 0.7).otherwise(0.5))
        .withColumn("schema_type", F.when(snowflake, "Snowflake").otherwise("Star"))
        .drop("_cards")
    )


def sample_rows(df: DataFrame, rows: int, key: str | Sequence[str]) -> DataFrame:
    """Exactly ``rows`` rows (all, if there are fewer): the first by the MD5 of the key, the same on every run."""
    names = [key] if isinstance(key, str) else list(key)
    drawn = F.md5(F.concat_ws("|", *[exact(c).cast("string") for c in names]))
    return df.orderBy(drawn, *[exact(c) for c in names]).limit(rows)


def profile(
    df: DataFrame, sample: int | None = None, key: str | Sequence[str] = (), approx: bool = False
) -> dict[str, DataFrame]:
    """Overview on all rows; column statistics on all rows or, on request, on a sample drawn by ``key``.

    The overview reports ``sampled_rows``, the rows that the column statistics have seen. The sample is written
    once, so that all sections see the same rows.
    """
    part, summary = df, overview(df)
    seen = F.col("row_count")
    if sample is not None:
        part = stage(sample_rows(df, sample, key or df.columns), "sample")
        seen = F.least(seen, F.lit(sample).cast("bigint"))
    sections = {"overview": summary.withColumn("sampled_rows", seen), "columns": describe(part, approx)}
    if columns_of(df, *NUMERIC):
        sections["numeric"] = numeric_profile(part, approx=approx)
    if columns_of(df, T.StringType):
        sections["categorical"] = categorical_profile(part)
    if columns_of(df, *TEMPORAL):
        sections["datetime"] = datetime_profile(part)
    return sections


def _flat(section: DataFrame, table: str, name: str) -> DataFrame:
    """A section as (table_name, section, column_name, metric, value, text): a row for each cell."""
    entries = []
    for f in section.schema.fields:
        if f.name == "column_name":
            continue
        cell = exact(f.name)
        number = isinstance(f.dataType, (*NUMERIC, T.BooleanType))
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        value = cell.cast("double") if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number else F.to_json(cell) if nested else cell.cast("string")
        entries.append(F.struct(F.lit(f.name).alias("metric"), value.alias("value"), text.alias("text")))
    about = F.col("column_name") if "column_name" in section.columns else F.lit(None).cast("string")
    return section.select(
        F.lit(table).alias("table_name"), F.lit(name).alias("section"), about.alias("column_name"), F.inline(F.array(*entries))
    )


def _sections(df: DataFrame, roles: Mapping[str, object] | None, approx: bool) -> dict[str, DataFrame]:
    """Everything a report has to say about one table."""
    sections = {
        "overview": overview(df),
        "columns": describe(df, approx),
        "uniqueness": uniqueness(df, approx),
        "patterns": patterns(df, approx),
        "semantic_warnings": semantic_warnings(df, approx),
        "quality_score": quality_score(df, approx),
        "insights": insights(df),
    }
    numbers = columns_of(df, *NUMERIC)
    if numbers:
        sections["numeric"] = numeric_profile(df, approx=approx)
        sections["outliers"] = outlier_counts(df, approx=approx)
        sections["skew"] = skew_label(df, approx=approx)
        sections["distributions"] = distribution_type(df)
        for c in numbers:
            sections[f"histogram {c}"] = histogram(df, c).withColumn("column_name", F.lit(c))
    if len(numbers) > 1:
        sections["correlations"] = correlations(df, threshold=0.7)
    if columns_of(df, T.StringType):
        sections["categorical"] = categorical_profile(df)
    if columns_of(df, *TEMPORAL):
        sections["datetime"] = datetime_profile(df)
        sections["temporal"] = temporal(df, columns_of(df, *TEMPORAL))
    if roles:
        sections["business_metrics"] = business_metrics(df, roles["kind"], roles["columns"], approx)
    return sections


def eda_report(
    tables: Mapping[str, DataFrame], approx: bool = False, roles: Mapping[str, Mapping[str, object]] | None = None
) -> DataFrame:
    """All sections of all tables as (table_name, section, column_name, metric, value, text).

    Numbers are in ``value``, everything else in ``text``. Each table is computed and written once, then its sections;
    a table that fails on the way, in planning or while running, is one row with its error and hides nothing
    else. ``roles`` names kind and columns of tables with business metrics.
    """
    parts = []
    for name, df in tables.items():
        try:
            source = stage(df, "eda")
            found = _sections(source, (roles or {}).get(name), approx)
            flat = [_flat(section, name, key) for key, section in found.items()]
            parts.append(stage(reduce(lambda a, b: a.unionAll(b), flat), "eda_sections"))
        except Exception as error:  # noqa: BLE001 - one broken table must not hide the others
            row = (name, "failed", None, "error", None, str(error))
            schema = "table_name string, section string, column_name string, metric string, value double, text string"
            parts.append(df.sparkSession.createDataFrame([row], schema))
    return reduce(lambda a, b: a.unionAll(b), parts)
