"""Catalogue operations that clean values and rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.scalars import EMAIL_PATTERN, NUMERIC, as_list, columns_of, exact, missing
from millrace.functions.stats import one_row, quantiles
from millrace.operators.windows import deduplicate, forward_fill

UNKNOWN = "Unknown"


def remove_nulls(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any listed column."""
    return df.dropna(subset=as_list(columns))


def fill_nulls(
    df: DataFrame,
    columns: str | Sequence[str],
    fill_value: object = None,
    method: str = "constant",
    partition_by: str | Sequence[str] = (),
    order_by: str | Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """Fill NULLs with a constant (cast to the column type), mean, median, mode, or the previous value."""
    names = as_list(columns)
    if method == "ffill":
        return forward_fill(df, partition_by, order_by, names)
    if method == "constant":
        fills = {c: F.lit(fill_value) for c in names}
    elif method == "mean":
        stats = one_row(df, **{c: F.avg(exact(c)) for c in names})
        fills = {c: stats[c] for c in names}
    elif method == "median":
        middle = quantiles(df, names, [0.5], approx, own_type=True)
        fills = {c: F.lit(middle[(c, 0.5)]) for c in names}
    elif method == "mode":
        fills = {c: _mode(df, c) for c in names}
    else:
        raise ValueError(f"unknown fill method {method!r}")
    return df.withColumns({c: F.coalesce(exact(c), v.cast(df.schema[c].dataType)) for c, v in fills.items()})


def _mode(df: DataFrame, name: str) -> Column:
    """The most frequent non-NULL value, the smallest of them on a tie."""
    counts = df.filter(exact(name).isNotNull()).groupBy(exact(name)).count()
    return counts.orderBy(F.col("count").desc(), exact(name)).limit(1).select(exact(name)).scalar()


def remove_duplicates(
    df: DataFrame,
    columns: str | Sequence[str] = (),
    keep: str = "first",
    order_by: str | Sequence[str] = (),
) -> DataFrame:
    """Distinct rows on a subset or on all columns; with an order, the first or last row per subset."""
    names = as_list(columns) or df.columns
    if as_list(order_by):
        return deduplicate(df, names, order_by, keep)
    return df.dropDuplicates(names)


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], k: float = 1.5, approx: bool = False
) -> dict[str, tuple[float, float] | None]:
    """Per column ``(q1 - k·iqr, q3 + k·iqr)``, or None for an empty column."""
    q = quantiles(df, list(columns), [0.25, 0.75], approx)
    bounds: dict[str, tuple[float, float] | None] = {}
    for c in columns:
        low, high = q[(c, 0.25)], q[(c, 0.75)]
        bounds[c] = None if low is None else (low - k * (high - low), high + k * (high - low))
    return bounds


def remove_outliers(
    df: DataFrame, columns: str | Sequence[str], method: str = "iqr", threshold: float | None = None, approx: bool = False
) -> DataFrame:
    """Drop rows outside the IQR fences or beyond ``threshold`` standard deviations; NULLs stay."""
    names = as_list(columns)
    if method == "iqr":
        fences = iqr_bounds(df, names, 1.5 if threshold is None else threshold, approx)
        tests = [exact(c).between(*b) for c, b in fences.items() if b]
    elif method == "zscore":
        limit = 3.0 if threshold is None else threshold
        stats = one_row(df, **{f"m_{c}": F.avg(exact(c)) for c in names}, **{f"s_{c}": F.stddev_samp(exact(c)) for c in names})
        tests = [F.abs(exact(c) - stats[f"m_{c}"]) <= limit * stats[f"s_{c}"] for c in names]
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return df.filter(reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(True)) for t in tests], F.lit(True)))


def fix_typos(df: DataFrame, columns: str | Sequence[str], pattern: str, replacement: str) -> DataFrame:
    """Regex replace in the listed columns."""
    return df.withColumns({c: F.regexp_replace(exact(c), pattern, replacement) for c in as_list(columns)})


def clean_missing(
    df: DataFrame,
    drop_threshold: float = 0.80,
    numeric_fill: str = "median",
    text_fill: str = UNKNOWN,
    approx: bool = False,
) -> DataFrame:
    """Drop columns that are mostly NULL, fill numbers with median or mean and strings with a word."""
    shares = df.agg(*[F.avg(missing(df, c).cast("double")).alias(c) for c in df.columns]).first().asDict()
    kept = [c for c in df.columns if (shares[c] or 0.0) <= drop_threshold]
    df = df.select(*[exact(c) for c in kept])
    holes = [c for c in kept if (shares[c] or 0.0) > 0]
    numbers = [c for c in columns_of(df, *NUMERIC) if c in holes]
    texts = [c for c in columns_of(df, T.StringType) if c in holes]
    if numbers:
        df = df.withColumns({c: F.when(~missing(df, c), exact(c)) for c in numbers})
        middle = {
            "median": lambda: {c: F.lit(v) for (c, _), v in quantiles(df, numbers, [0.5], approx).items()},
            "mean": lambda: {c: one_row(df, **{n: F.avg(exact(n)) for n in numbers})[c] for c in numbers},
        }[numeric_fill]()
        df = df.withColumns({c: F.coalesce(exact(c), v.cast(_filled_type(df, c))) for c, v in middle.items()})
    return df.withColumns({c: F.coalesce(exact(c), F.lit(text_fill)) for c in texts}) if texts else df


def _filled_type(df: DataFrame, name: str) -> T.DataType:
    """Integers become double when filled, so that a median of 2.5 stays 2.5."""
    kind = df.schema[name].dataType
    return kind if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else T.DoubleType()


def cap_outliers(df: DataFrame, columns: str | Sequence[str] = (), k: float = 1.5, approx: bool = False) -> DataFrame:
    """Clip to the IQR fences; ``<column>_has_outlier`` where any was clipped, ``_has_anomalies`` = any flag."""
    names = as_list(columns) or [c for c in columns_of(df, *NUMERIC) if not c.startswith("_")]
    fences = {c: b for c, b in iqr_bounds(df, names, k, approx).items() if b}
    outside = {c: (exact(c) < lo) | (exact(c) > hi) for c, (lo, hi) in fences.items()}
    if not outside:
        return df.withColumn("_has_anomalies", F.lit(False))
    hit = df.agg(*[F.coalesce(F.bool_or(cond), F.lit(False)).alias(c) for c, cond in outside.items()]).first()
    flagged = [c for c in outside if hit[c]]
    out = df.withColumns({f"{c}_has_outlier": F.coalesce(outside[c], F.lit(False)) for c in flagged})
    out = out.withColumns({c: _clip(exact(c).cast("double"), *fences[c]) for c in flagged})
    any_flag = reduce(lambda a, b: a | b, [exact(f"{c}_has_outlier") for c in flagged], F.lit(False))
    return out.withColumn("_has_anomalies", any_flag)


def _clip(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


# Accepted ranges, patterns and value lists by column name.
NUMERIC_RANGES = {
    "age": (0, 120),
    "patient_age": (0, 120),
    "temperature": (32, 42),
    "blood_pressure_systolic": (70, 200),
    "blood_pressure_diastolic": (40, 120),
}
COLUMN_PATTERNS = {
    "phone_number": r"^\+?[0-9\-\s\(\)]+$",
    "email_address": EMAIL_PATTERN,
    "contact_email": EMAIL_PATTERN,
}
COLUMN_ENUMS = {
    "gender": ["M", "F", "Other", "Unknown"],
    "status": ["active", "inactive", "archived"],
    "admission_type": ["emergency", "elective", "urgent"],
}


def null_invalid(
    df: DataFrame,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    patterns: Mapping[str, str] | None = None,
    enums: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Values outside their range, pattern or list become NULL; the row stays."""
    ranges = NUMERIC_RANGES if ranges is None else ranges
    patterns = COLUMN_PATTERNS if patterns is None else patterns
    enums = COLUMN_ENUMS if enums is None else enums
    ok = {c: exact(c).between(lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns}
    ok |= {c: exact(c).rlike(p) for c, p in patterns.items() if c in df.columns}
    ok |= {c: exact(c).isin(list(v)) for c, v in enums.items() if c in df.columns}
    return df.withColumns({c: F.when(test, exact(c)) for c, test in ok.items()}) if ok else df


def backfill(df: DataFrame, fills: Mapping[str, Sequence[Column]]) -> DataFrame:
    """NULLs in a column take the first non-NULL of the listed expressions."""
    return df.withColumns({c: F.coalesce(exact(c), *v) for c, v in fills.items()})


def backfill_assets(df: DataFrame, now: Column, bronze: str = "bronze/", silver: str = "silver/") -> DataFrame:
    """Asset rows: missing keys become placeholders built from the id, missing times the processing time."""
    ident = F.col("id").cast("string")
    done = F.col("extraction_status") == "success"
    return backfill(
        df,
        {
            "bronze_key": [F.concat(F.lit(f"{bronze}MISSING/"), ident)],
            "silver_key": [F.when(done, F.concat(F.lit(f"{silver}MISSING/"), ident, F.lit(".json")))],
            "created_at": [F.col("processed_at"), now],
            "updated_at": [F.col("processed_at"), now],
            "is_anomaly": [F.lit(False)],
        },
    )
