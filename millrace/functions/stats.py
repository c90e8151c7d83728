"""Whole-table statistics: one-row aggregates as scalar subqueries, exact quantiles, sample moments."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.scalars import FLOATING, clean_number, exact

# percentile_approx keeps about this many sketch entries; rank error is at most n / ACCURACY.
ACCURACY = 10_000
# Compared without a detour through double.
_EXACT = (T.IntegralType, T.DecimalType)


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates of the whole table as one struct column usable next to any row.

    A scalar subquery: partial aggregation runs on the executors, one row comes back, and no join with
    the table is planned. Read a field with ``stats["name"]``.
    """
    return df.agg(F.struct(*[c.alias(name) for name, c in aggregates.items()]).alias("stats")).scalar()


@dataclass
class _Wanted:
    """One order statistic: the ``rank``-th value (from 0) of the ``inner`` values strictly between two bounds."""

    column: str
    rank: int
    inner: int
    low: object = None
    high: object = None
    found: bool = False
    value: object = None

    def inside(self) -> Column:
        """The column's value if it lies strictly between the bounds."""
        value, limits = F.col(self.column), []
        if self.low is not None:
            limits.append(value > F.lit(self.low))
        if self.high is not None:
            limits.append(value < F.lit(self.high))
        return F.when(reduce(lambda a, b: a & b, limits), value) if limits else value

    @property
    def bracket(self) -> tuple:
        return (self.column, self.low, self.high)


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], small: int = 50_000, own_type: bool = False
) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles, without sorting and without a large buffer in one task.

    Each order statistic is looked for between two bounds that are values of the column and not inside themselves. A pass
    sketches the inside, takes a value a little below and one a little above the wanted place, and counts exactly how
    many rows lie below, at, between, at and above the two. Either one of them is the wanted value or the new bounds are two of the
    old inside's values, so the inside shrinks in every pass, usually about 2500 times: 10^12 rows need two. At most ``small`` rows
    are then sorted in one aggregate. Only counts and bounds come to the driver. Integers and decimals are
    compared in their own type; with ``own_type`` a quantile that is one of the values, or lies at a whole
    number, comes back in it.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    data = df.select(
        *[
            (exact(c) if isinstance(kinds[c], _EXACT) else clean_number(exact(c))).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    names = {f"c{i}": c for i, c in enumerate(columns)}
    head = data.agg(*[F.count(k).alias(k) for k in names]).first()
    wanted: dict[tuple[str, int], _Wanted] = {}
    places: dict[tuple[str, float], tuple[list[_Wanted], float]] = {}
    for key, name in names.items():
        n = head[key]
        for p in probs:
            position = (n - 1) * p if n else 0.0
            rank = int(position)
            ranks = [] if not n else [rank] if position == rank else [rank, rank + 1]
            both = [wanted.setdefault((key, r), _Wanted(key, r, n)) for r in ranks]
            places[(name, p)] = (both, position - rank)

    _find(data, list(wanted.values()), small)
    return {place: _between([w.value for w in both], frac, own_type) for place, (both, frac) in places.items()}


def _find(data: DataFrame, wanted: list[_Wanted], small: int) -> None:
    while large := [w for w in wanted if not w.found and w.inner > small]:
        _narrow(data, large)
    _look_up(data, [w for w in wanted if not w.found])


def values_at_ranks(data: DataFrame, column: str, ranks: list[int], rows: int, small: int = 50_000) -> list:
    """The values of an integer, decimal or float column at places of its ascending order; it has ``rows`` non-NULL values.

    Found like exact quantiles: no sort of the table, no large buffer, only bounds and counts on the driver.
    """
    wanted = [_Wanted(column, rank, rows) for rank in ranks]
    _find(data, wanted, small)
    return [w.value for w in wanted]


def _between(values: list, frac: float, own_type: bool):
    """Linear interpolation between one or two neighbouring order statistics."""
    if not values:
        return None
    first, last = values[0], values[-1]
    if own_type and isinstance(first, (int, Decimal)):
        step = (last - first) * (Decimal(frac) if isinstance(first, Decimal) else Fraction(frac))
        if isinstance(first, Decimal):
            return first + step
        return first + int(step) if step.denominator == 1 else float(first + step)
    return float(first) + frac * (float(last) - float(first))


def _by_bracket(targets: list[_Wanted]) -> list[list[_Wanted]]:
    shared: dict[tuple, list[_Wanted]] = {}
    for t in targets:
        shared.setdefault(t.bracket, []).append(t)
    return list(shared.values())


def _narrow(data: DataFrame, targets: list[_Wanted]) -> None:
    """One pass for all targets; those that still share their bounds share the sketch."""
    groups = _by_bracket(targets)

    def aims(t: _Wanted) -> list[float]:
        margin = 2.0 / ACCURACY
        return [max(0.0, t.rank / t.inner - margin), min(1.0, (t.rank + 1) / t.inner + margin)]

    sketch = data.agg(
        *[
            F.percentile_approx(group[0].inside(), [p for t in group for p in aims(t)], ACCURACY).alias(f"b{i}")
            for i, group in enumerate(groups)
        ]
    ).first()
    bounds = [(t, *sketch[f"b{i}"][2 * j : 2 * j + 2]) for i, group in enumerate(groups) for j, t in enumerate(group)]
    counts = []
    for i, (t, a, b) in enumerate(bounds):
        x = t.inside()
        counts += [
            F.count_if(x < F.lit(a)).alias(f"below{i}"),
            F.count_if(x == F.lit(a)).alias(f"a{i}"),
            F.count_if((x > F.lit(a)) & (x < F.lit(b))).alias(f"between{i}"),
            F.count_if((x == F.lit(b)) & (x > F.lit(a))).alias(f"b{i}"),
        ]
    row = data.agg(*counts).first()
    for i, (t, a, b) in enumerate(bounds):
        below, at_a, between, at_b = (row[f"{k}{i}"] for k in ("below", "a", "between", "b"))
        if t.rank < below:
            t.high, t.inner = a, below
            continue
        t.rank -= below
        if t.rank < at_a:
            t.found, t.value = True, a
            continue
        t.rank -= at_a
        if t.rank < between:
            t.low, t.high, t.inner = a, b, between
            continue
        t.rank -= between
        if t.rank < at_b:
            t.found, t.value = True, b
            continue
        t.rank -= at_b
        t.low, t.inner = b, t.inner - below - at_a - between - at_b


def _look_up(data: DataFrame, targets: list[_Wanted]) -> None:
    """Sort what little lies inside the bounds, once for each pair of bounds."""
    groups = _by_bracket(targets)
    if not groups:
        return
    sorted_values = [F.sort_array(F.collect_list(group[0].inside())).alias(f"s{i}") for i, group in enumerate(groups)]
    row = data.agg(*sorted_values).select(
        *[F.array(*[F.get(f"s{i}", F.lit(t.rank)) for t in group]).alias(f"v{i}") for i, group in enumerate(groups)]
    ).first()
    for i, group in enumerate(groups):
        for t, value in zip(group, row[f"v{i}"]):
            t.found, t.value = True, value


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[tuple[str, float], float | None]:
    """Quantiles with rank error at most n / 10000, in one pass over the columns."""
    row = df.agg(
        *[
            F.percentile_approx(clean_number(exact(c)), probs, ACCURACY).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {
        (c, p): (row[f"q{i}"][j] if row[f"q{i}"] is not None else None)
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    }


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], approx: bool = False, own_type: bool = False
) -> dict[tuple[str, float], float | None]:
    """Exact quantiles, or the one-pass sketch with ``approx=True``."""
    return approx_quantiles(df, columns, probs) if approx else exact_quantiles(df, columns, probs, own_type=own_type)


def distinct_counts(df: DataFrame, columns: list[str], name: str = "distinct_count", approx: bool = False) -> DataFrame:
    """(column_name, <name>): different non-missing values per column, in one scan whatever the number of columns.

    Exact counts shuffle the distinct (column, value) pairs, which each task reduces first; values are compared as
    text. With ``approx`` all columns share one pass of sketches. An empty table gives no rows.
    """

    def value(c: str) -> Column:
        column = exact(c)
        return F.when(~F.isnan(column), column) if isinstance(df.schema[c].dataType, FLOATING) else column

    if approx:
        entries = [
            F.struct(F.lit(c).alias("column_name"), F.approx_count_distinct(value(c)).alias(name)) for c in columns
        ]
        return df.agg(F.array(*entries).alias("d")).select(F.inline("d"))

    def text(c: str) -> Column:
        column, kind = value(c), df.schema[c].dataType
        if isinstance(kind, FLOATING):
            column = column + F.lit(0.0)  # -0.0 is 0.0
        return F.hex(column) if isinstance(kind, T.BinaryType) else column.cast("string")

    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("v")) for c in columns])
    return df.select(F.inline(cells)).distinct().groupBy("column_name").agg(F.count("v").alias(name))


def with_distinct_counts(
    rows: DataFrame, df: DataFrame, columns: list[str], name: str = "distinct_count", approx: bool = False
) -> DataFrame:
    """Add the distinct count of ``df`` to rows that carry a ``column_name``; NULL for other columns.

    The counts, one per column, arrive as one map through a scalar subquery.
    """
    counts = distinct_counts(df, columns, "n", approx)
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "n")))).scalar()
    known = F.coalesce(F.try_element_at(found, F.col("column_name")), F.lit(0).cast("bigint"))
    return rows.withColumn(name, F.when(F.col("column_name").isin(list(columns)), known))


def sample_skewness(column: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(column).cast("double")
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.when(F.var_pop(column) > 0, factor * F.skewness(column)).otherwise(F.lit(0.0)))


def sample_kurtosis(column: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(column).cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6)
    return F.when(n > 3, F.when(F.var_pop(column) > 0, value).otherwise(F.lit(0.0)))
