"""One page of rows deep inside a sorted table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.order import POS, sorted_positions
from millrace.functions.scalars import FLOATING, INTEGRAL, exact
from millrace.functions.stats import values_at_ranks

# Rows that a task may hold of a page and of what precedes it.
HELD = 1 << 18


@dataclass(frozen=True)
class By:
    """A sort column."""

    name: str
    down: bool = False
    nulls_last: bool = False

    @property
    def order(self) -> Column:
        column = exact(self.name)
        if self.down:
            return column.desc_nulls_last() if self.nulls_last else column.desc_nulls_first()
        return column.asc_nulls_last() if self.nulls_last else column.asc_nulls_first()


def _number(df: DataFrame, name: str) -> Column | None:
    """The column as numbers that sort alike, or None for a kind that has none."""
    kind, column = df.schema[name].dataType, exact(name)
    if isinstance(kind, (*INTEGRAL, T.DecimalType)):
        return column
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    return column.cast("double") if isinstance(kind, FLOATING) else None


def page(df: DataFrame, by: Sequence[By], limit: int, offset: int = 0, held: int = HELD) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the sorted table, in order; the order should name a unique column last.

    A shallow page is a plain limit: each task keeps its first ``offset + limit`` rows. For a deep one the values of the first
    sort column at the page's ends are found as exact quantiles are, the rows before them are counted, and only the rows
    between them are sorted. Where these are still too many, because a value repeats or the column has no numbers to
    narrow by, they are sorted over all tasks and the page is picked by position. So no task holds more than ``held`` rows.
    """
    if offset + limit <= held:
        return df.orderBy(*[b.order for b in by]).offset(offset).limit(limit)
    rows, skip = _between_ends(df, by[0], limit, offset)
    if skip + limit <= held:
        return rows.orderBy(*[b.order for b in by]).offset(skip).limit(limit)
    placed = sorted_positions(rows, *[b.order for b in by])
    return placed.filter(F.col(POS).between(skip, skip + limit - 1)).orderBy(POS).drop(POS)


def _between_ends(df: DataFrame, by: By, limit: int, offset: int) -> tuple[DataFrame, int]:
    """The rows whose first sort value lies between those of the page's ends, and how many of them precede the page."""
    number = _number(df, by.name)
    if number is None:
        return df, offset
    is_float = isinstance(df.schema[by.name].dataType, FLOATING)
    counts = df.agg(F.count("*").alias("all"), F.count(number).alias("present"), (F.count_if(F.isnan(number)) if is_float else F.lit(0)).alias("nan")).first()
    if counts["nan"]:  # sorted above all numbers; too rare a case for a way of its own
        return df, offset
    present, gone = counts["present"], counts["all"] - counts["present"]
    before_numbers = 0 if by.nulls_last else gone
    first, last = offset - before_numbers, min(offset + limit, counts["all"]) - 1 - before_numbers
    if last < 0 or first >= present:  # nothing but NULLs, or nothing at all
        return df.filter(number.isNull()), offset - (present if by.nulls_last else 0)
    ends = sorted({max(first, 0), min(last, present - 1)})
    data = df.select(number.alias("v"))
    values = values_at_ranks(data, "v", [present - 1 - r if by.down else r for r in ends], present)
    low, high = min(values), max(values)
    inside = number.between(F.lit(low), F.lit(high))
    ahead = data.agg(F.count_if(F.col("v") > F.lit(high) if by.down else F.col("v") < F.lit(low))).first()[0]
    if first < 0:  # begins among leading NULLs: everything up to the last value
        return df.filter(number.isNull() | inside), offset
    if last >= present:  # ends among trailing NULLs
        return df.filter(number.isNull() | inside), offset - ahead
    return df.filter(inside), offset - ahead - before_numbers
