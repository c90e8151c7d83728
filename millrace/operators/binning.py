"""Catalogue operations that put numbers into bins. Bins are numbered from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.scalars import as_list, exact
from millrace.functions.stats import one_row, quantiles


def width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of a value, the last bin closed; a constant column is all bin 1."""
    share = F.try_divide((value - low) * bins, high - low)
    inside = F.least(F.floor(share).cast("int") + 1, F.lit(bins))
    return F.when(value.isNotNull(), F.coalesce(inside, F.lit(1)))


def equal_width_bin(df: DataFrame, columns: str | Sequence[str], bins: int = 10, suffix: str = "_bin") -> DataFrame:
    names = as_list(columns)
    s = one_row(df, **{f"lo_{c}": F.min(exact(c)) for c in names}, **{f"hi_{c}": F.max(exact(c)) for c in names})
    return df.withColumns({f"{c}{suffix}": width_bin(exact(c), s[f"lo_{c}"], s[f"hi_{c}"], bins) for c in names})


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """1 + the number of inner edges below the value: bins are closed on the right, the first on both sides."""
    result = F.lit(1)
    for edge in sorted(set(edges)):
        result = result + F.when(value > F.lit(edge), 1).otherwise(0)
    return F.when(value.isNotNull(), result)


def quantile_bin(
    df: DataFrame,
    columns: str | Sequence[str],
    quantile_list: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0),
    suffix: str = "_bin",
    approx: bool = False,
) -> DataFrame:
    """Bins between the values at the given quantiles."""
    names = as_list(columns)
    inner = [p for p in quantile_list if 0.0 < p < 1.0]
    edges = quantiles(df, names, inner, approx)
    return df.withColumns(
        {
            f"{c}{suffix}": edge_bin(exact(c), [edges[(c, p)] for p in inner if edges[(c, p)] is not None])
            for c in names
        }
    )


def equal_freq_bin(
    df: DataFrame, columns: str | Sequence[str], bins: int = 4, suffix: str = "_bin", approx: bool = False
) -> DataFrame:
    """Bins that hold about the same number of rows; equal values always share a bin."""
    return quantile_bin(df, columns, [i / bins for i in range(bins + 1)], suffix, approx)


def custom_bin(
    df: DataFrame,
    columns: str | Sequence[str],
    bins: Sequence[float],
    labels: Sequence[str] | None = None,
    suffix: str = "_bin",
) -> DataFrame:
    """Given edges, closed on the left; outside all of them → NULL."""
    labels = list(labels) if labels else [f"{a}-{b}" for a, b in zip(bins, bins[1:])]
    if len(labels) != len(bins) - 1:
        raise ValueError("there must be one label per pair of edges")
    out = {}
    for c in as_list(columns):
        result = F.lit(None).cast("string")
        for low, high, label in reversed(list(zip(bins, bins[1:], labels))):
            result = F.when((exact(c) >= low) & (exact(c) < high), F.lit(label)).otherwise(result)
        out[f"{c}{suffix}"] = result
    return df.withColumns(out)
