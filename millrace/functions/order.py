"""Ordered per-key computations that hold when one key owns a third of the table.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here the table is sorted once by
(keys, order) with a range partitioning, so a hot key spreads over many partitions, and every row gets its
global position. Rows are then grouped into pages of fixed length. Windows run per (page, key): no group is
longer than a page. What a window needs from before its page arrives in one of two ways:

* a bounded look-back or look-ahead gets copies of the neighbouring rows (``look_around``);
* a running value gets one carry row per page and key (``running``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from millrace.functions.scalars import row_spread
from millrace.session import stage

PAGE_ROWS = 1 << 18

POS = "_pos"
PAGE = "_page"


def sorted_positions(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with ``_pos``, their 0-based place in the global sort order.

    The sorted rows are written once; afterwards the number of each row is fixed, whatever is recomputed.
    """
    ordered = stage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_mid", 33).cast("int")
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per sort partition, so this window and the broadcast are bounded by the partition count.
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        ordered.withColumn("_part", part)
        .withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .withColumn(POS, F.col("_off") + F.col("_local"))
        .drop("_mid", "_part", "_local", "_off")
    )


def paged(df: DataFrame, keys: list[str], order: list[Column], page_rows: int = PAGE_ROWS) -> DataFrame:
    """Rows sorted by (keys, order) with ``_pos`` and ``_page``.

    A hash of the row comes last in the sort, so that equal (key, order) pairs spread over partitions too.
    """
    spread = row_spread(df)
    placed = sorted_positions(df, *[F.col(k) for k in keys], *order, spread)
    return placed.withColumn(PAGE, F.floor(F.col(POS) / page_rows))


def clustered(pages: DataFrame) -> DataFrame:
    """Whole pages per task. All windows and carry joins after this use the same partitioning."""
    return pages.repartition(F.col(PAGE))


def page_window(keys: list[str]) -> WindowSpec:
    """Window over one page of one key, in sort order."""
    return Window.partitionBy(PAGE, *keys).orderBy(POS)


def look_around(
    pages: DataFrame,
    keys: list[str],
    columns: dict[str, Callable[[WindowSpec], Column]],
    back: int = 0,
    ahead: int = 0,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Add window columns that see at most ``back`` rows before and ``ahead`` rows after.

    Rows near a page edge are copied to the neighbouring page, used there, and dropped again.
    """
    if max(back, ahead) > page_rows:
        raise ValueError("a window frame may not be longer than a page; raise page_rows")
    place = F.col(POS) % page_rows
    here = F.struct(F.col(PAGE).alias("page"), F.lit(True).alias("home"))
    after = F.when(place >= page_rows - back, F.struct((F.col(PAGE) + 1).alias("page"), F.lit(False).alias("home")))
    before = F.when(place < ahead, F.struct((F.col(PAGE) - 1).alias("page"), F.lit(False).alias("home")))
    spread = pages.withColumn("_copy", F.explode(F.array_compact(F.array(here, after, before))))
    spread = spread.withColumn(PAGE, F.col("_copy.page")).withColumn("_home", F.col("_copy.home")).drop("_copy")
    spread, spec = clustered(spread), page_window(keys)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(spec))
    return spread.filter("_home").drop("_home")


@dataclass(frozen=True)
class Running:
    """One running computation: what is done inside a page, handed on, folded, and combined.

    ``local`` are window columns inside the page; ``per_page`` the aggregates a page hands on; ``fold`` turns
    the page table into one with the ``carried`` columns, given the window over a key's earlier pages; ``result``
    reads local and carried columns. A carried column is NULL where the key starts in this page.
    """

    local: dict[str, Callable[[WindowSpec], Column]]
    per_page: dict[str, Column]
    fold: Callable[[DataFrame, WindowSpec], DataFrame]
    carried: list[str]
    result: dict[str, Column]


def running(
    pages: DataFrame, keys: list[str], job: Running, page_rows: int = PAGE_ROWS, is_clustered: bool = False
) -> DataFrame:
    """Add values that depend on all earlier rows of the key.

    Only keys that touch an edge of their page can continue, so at most two rows per page are folded and one is
    joined back, on the page alone: the shuffle that brings pages together serves windows and join.
    """
    first, last = F.min(POS).alias("_first"), F.max(POS).alias("_last")
    summary = pages.groupBy(PAGE, *keys).agg(*[c.alias(n) for n, c in job.per_page.items()], first, last)
    edges = summary.filter((F.col("_first") % page_rows == 0) | (F.col("_last") % page_rows == page_rows - 1))
    by_key = Window.partitionBy(*keys).orderBy(PAGE)
    folded = job.fold(edges, by_key.rowsBetween(Window.unboundedPreceding, -1))
    carried = (
        folded.withColumn("_nth", F.row_number().over(by_key))
        .filter((F.col("_nth") > 1) & (F.col("_first") % page_rows == 0))
        .select(
            F.col(PAGE).alias("_cpage"),
            *[F.col(c).alias(f"_in_{c}") for c in job.carried],
            *[F.col(k).alias(f"_c_{k}") for k in keys],
        )
    )
    body = pages if is_clustered else clustered(pages)
    for name, build in job.local.items():
        body = body.withColumn(name, build(page_window(keys)))
    joined = body.join(carried, F.col(PAGE) == F.col("_cpage"), "left")
    same_key = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys], F.col("_cpage").isNotNull()
    )
    joined = joined.withColumns({c: F.when(same_key, F.col(f"_in_{c}")) for c in job.carried})
    helpers = [*job.local, *job.carried, *[f"_in_{c}" for c in job.carried], "_cpage", *[f"_c_{k}" for k in keys]]
    return joined.withColumns(job.result).drop(*[h for h in helpers if h not in job.result])


def _so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def running_sum(name: str, value: Column) -> Running:
    """Sum of ``value`` over the key up to and including the row."""
    return Running(
        local={"_sum_here": lambda w: F.sum(value).over(_so_far(w))},
        per_page={"_sum_page": F.sum(value)},
        fold=lambda edges, earlier: edges.withColumn("_sum_before", F.sum("_sum_page").over(earlier)),
        carried=["_sum_before"],
        result={name: F.col("_sum_here") + F.coalesce(F.col("_sum_before"), F.lit(0))},
    )


def row_numbers(name: str) -> Running:
    """1, 2, 3 … per key in sort order."""
    return running_sum(name, F.lit(1).cast("bigint"))


def latest_values(columns: dict[str, Column]) -> Running:
    """Per new column the latest non-NULL value of the key up to and including the row."""

    def fold(edges: DataFrame, earlier: WindowSpec) -> DataFrame:
        return edges.withColumns({f"_last_before_{n}": F.last(f"_last_page_{n}", ignorenulls=True).over(earlier) for n in columns})

    return Running(
        local={f"_last_here_{n}": (lambda w, c=c: F.last(c, ignorenulls=True).over(_so_far(w))) for n, c in columns.items()},
        per_page={f"_last_page_{n}": F.max_by(c, F.when(c.isNotNull(), F.col(POS))) for n, c in columns.items()},
        fold=fold,
        carried=[f"_last_before_{n}" for n in columns],
        result={n: F.coalesce(F.col(f"_last_here_{n}"), F.col(f"_last_before_{n}")) for n in columns},
    )


def ranks(row_number: str, rank: str, dense_rank: str, is_new: str) -> Running:
    """All three ranks; ``is_new`` is true on the first row of every group of equals."""
    new = F.col(is_new)
    one = F.when(new, 1).otherwise(0).cast("bigint")

    def fold(edges: DataFrame, earlier: WindowSpec) -> DataFrame:
        counted = edges.withColumns(
            {"_rows_before": F.sum("_rows_page").over(earlier), "_groups_before": F.sum("_groups_page").over(earlier)}
        )
        start = F.col("_start_page") + F.coalesce(F.col("_rows_before"), F.lit(0))
        return counted.withColumn("_start_page", start).withColumn("_start_before", F.max("_start_page").over(earlier))

    before = F.coalesce(F.col("_rows_before"), F.lit(0))
    return Running(
        local={
            "_row_here": lambda w: F.row_number().over(w),
            "_start_here": lambda w: F.max(F.when(new, F.col("_row_here"))).over(_so_far(w)),
            "_group_here": lambda w: F.sum(one).over(_so_far(w)),
        },
        per_page={
            "_rows_page": F.count("*"),
            "_groups_page": F.sum(one),
            "_start_page": F.max(F.when(new, F.col(POS))) - F.min(POS) + 1,
        },
        fold=fold,
        carried=["_rows_before", "_groups_before", "_start_before"],
        result={
            row_number: F.col("_row_here") + before,
            rank: F.coalesce(F.col("_start_here") + before, F.col("_start_before")),
            dense_rank: F.col("_group_here") + F.coalesce(F.col("_groups_before"), F.lit(0)),
        },
    )


def values_at(
    df: DataFrame, col: str, pick: Callable[[Column, Column], Column], page_rows: int = PAGE_ROWS
) -> DataFrame:
    """(pick, value): values at chosen places of the sorted column.

    A value fills the 0-based places from ``start`` up to, not including, ``end``; ``pick(start, end)`` returns
    an array with one entry per wanted place among them.

    Equal values are counted before the sort, so a value that fills a third of the column is one row of it.
    """
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("_n"))
    pages = paged(counts, [], [F.col("value")], page_rows)
    totals = running(pages, [], running_sum("_end", F.col("_n")), page_rows)
    return totals.select(F.explode(pick(F.col("_end") - F.col("_n"), F.col("_end"))).alias("pick"), "value")


def unpaged(df: DataFrame) -> DataFrame:
    """Drop the position columns."""
    return df.drop(POS, PAGE)
