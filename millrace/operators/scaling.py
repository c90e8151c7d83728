"""Catalogue operations that rescale numbers. Statistics come from one aggregate per call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.functions.scalars import as_list, exact
from millrace.functions.stats import one_row, quantiles


def minmax_scale(
    df: DataFrame, columns: str | Sequence[str], min: float = 0.0, max: float = 1.0, suffix: str = "_scaled"
) -> DataFrame:
    """(x - min) / (max - min) into the target range; a constant column gives NULL."""
    names = as_list(columns)
    s = one_row(df, **{f"lo_{c}": F.min(exact(c)) for c in names}, **{f"hi_{c}": F.max(exact(c)) for c in names})
    share = {c: F.try_divide(exact(c) - s[f"lo_{c}"], s[f"hi_{c}"] - s[f"lo_{c}"]) for c in names}
    return df.withColumns({f"{c}{suffix}": v * (max - min) + min for c, v in share.items()})


def zscore_normalize(df: DataFrame, columns: str | Sequence[str], suffix: str = "_normalized") -> DataFrame:
    """(x - mean) / sample standard deviation."""
    names = as_list(columns)
    s = one_row(df, **{f"m_{c}": F.avg(exact(c)) for c in names}, **{f"s_{c}": F.stddev_samp(exact(c)) for c in names})
    return df.withColumns({f"{c}{suffix}": F.try_divide(exact(c) - s[f"m_{c}"], s[f"s_{c}"]) for c in names})


def robust_scale(
    df: DataFrame, columns: str | Sequence[str], suffix: str = "_robust", approx: bool = False
) -> DataFrame:
    """(x - median) / IQR."""
    names = as_list(columns)
    q = quantiles(df, names, [0.25, 0.5, 0.75], approx)
    out = {}
    for c in names:
        if q[(c, 0.5)] is None:
            out[f"{c}{suffix}"] = F.lit(None).cast("double")
        else:
            spread = q[(c, 0.75)] - q[(c, 0.25)]
            out[f"{c}{suffix}"] = F.try_divide(exact(c) - F.lit(q[(c, 0.5)]), F.lit(spread))
    return df.withColumns(out)


def maxabs_scale(df: DataFrame, columns: str | Sequence[str], suffix: str = "_maxabs") -> DataFrame:
    """x / max |x|."""
    names = as_list(columns)
    s = one_row(df, **{c: F.max(F.abs(exact(c))) for c in names})
    return df.withColumns({f"{c}{suffix}": F.try_divide(exact(c), s[c]) for c in names})


def unit_vector(df: DataFrame, columns: str | Sequence[str], suffix: str = "_unit") -> DataFrame:
    """The listed columns divided by the row's Euclidean norm."""
    names = as_list(columns)
    squares = reduce(lambda a, b: a + b, [exact(c).cast("double") * exact(c) for c in names])
    return df.withColumns({f"{c}{suffix}": F.try_divide(exact(c), F.sqrt(squares)) for c in names})
