"""Keyed de-duplication, ranks, look-back windows, forward fill, top-k and recent rows.

``row_number() <= k`` filters are planned by Spark with a limit per key before the shuffle, so a hot key
sends at most k rows per task. Ordered windows without such a limit use pages (``functions.order``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import frames, order as paging, seek
from millrace.functions.scalars import as_list, exact
from millrace.functions.stats import one_row


def descending(columns: Sequence[str]) -> list[Column]:
    return [exact(c).desc_nulls_last() for c in columns]


def sort_spec(order_by: str | Sequence[str]) -> list[tuple[str, bool]]:
    """``["a desc", "b"]`` → ``[("a", True), ("b", False)]``."""
    return [(part.split()[0], part.lower().endswith(" desc")) for part in as_list(order_by)]


def sort_columns(order_by: str | Sequence[str]) -> list[Column]:
    """Sort expressions; NULLs come last either way."""
    return [exact(c).desc_nulls_last() if down else exact(c).asc_nulls_last() for c, down in sort_spec(order_by)]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of every key in the given order."""
    spec = Window.partitionBy(*[exact(c) for c in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") <= k).drop("_rn")


def deduplicate(
    df: DataFrame,
    keys: str | Sequence[str],
    order_by: str | Sequence[str] = "_ingestion_timestamp",
    keep: str = "last",
) -> DataFrame:
    """One row per key: the first or last by the order columns; list a unique column last to break ties."""
    columns = as_list(order_by)
    if keep == "last":
        order = descending(columns)
    elif keep == "first":
        order = [exact(c).asc_nulls_last() for c in columns]
    else:
        raise ValueError("keep must be 'first' or 'last'")
    return first_per_key(df, as_list(keys), order)


def latest_changes(
    df: DataFrame, key: str | Sequence[str] = "_cdc_key", order: Sequence[str] = ("_cdc_timestamp", "_cdc_lsn")
) -> DataFrame:
    """The newest change of every key."""
    return deduplicate(df, key, list(order), "last")


def dedup_by_hash(df: DataFrame, hash_col: str, order_by: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per hash value."""
    return deduplicate(df, hash_col, list(order_by), keep)


def drop_exact(df: DataFrame, data_only: bool = True) -> DataFrame:
    """Distinct rows over the data columns (names not starting with ``_``), or over all columns."""
    data = [c for c in df.columns if not (data_only and c.startswith("_"))]
    return df.dropDuplicates(data)


def removed_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, rows removed."""
    kept = one_row(after, n=F.count("*"))["n"]
    return before.agg(F.count("*").alias("rows_before")).select(
        "rows_before", kept.alias("rows_after"), (F.col("rows_before") - kept).alias("rows_removed")
    )


def add_window(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str | Sequence[str],
    row_number: str | None = None,
    rank: str | None = None,
    dense_rank: str | None = None,
    ties: int | None = None,
    shifts: Mapping[str, tuple[str, int]] | None = None,
    page_rows: int = paging.PAGE_ROWS,
) -> DataFrame:
    """Row number, ranks, lag and lead per key in one sort, ordered by ``["a desc", "b"]``.

    Rows are equal for the ranks when their first ``ties`` order columns are (all by default). ``shifts`` maps a
    new column to ``(column, steps)``: positive steps look back, negative ones ahead.
    """
    keys, shifts = list(keys), dict(shifts or {})
    spec = sort_spec(order_by)
    ranked = bool(rank or dense_rank)
    looks = {new: (lambda w, c=c, n=n: F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)) for new, (c, n) in shifts.items()}
    source = df
    if ranked:
        source = df.withColumn("_peer", F.struct(*[name for name, _ in spec[:ties]]))
        looks["_prev"] = lambda w: F.lag("_peer").over(w)
    pages = paging.paged(source, keys, sort_columns(order_by), page_rows)
    if looks:
        steps = [n for _, n in shifts.values()]
        back, ahead = max([1, *steps]), max([0, *[-n for n in steps]])
        pages = paging.look_around(pages, keys, looks, back, ahead, page_rows)
    if ranked:
        pages = pages.withColumn("_new", F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(F.col("_peer")))
        job, wanted = paging.ranks("_r1", "_r2", "_r3", "_new"), {"_r1": row_number, "_r2": rank, "_r3": dense_rank}
    else:
        job, wanted = paging.row_numbers("_r1"), {"_r1": row_number}
    if any(wanted.values()):
        pages = paging.running(pages, keys, job, page_rows, is_clustered=bool(looks))
        pages = pages.withColumns({new: F.col(old) for old, new in wanted.items() if new}).drop(*wanted)
    return paging.unpaged(pages).drop("_prev", "_new", "_peer")


ROLLING = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def rolling_agg(
    df: DataFrame,
    columns: str | Sequence[str],
    window: int,
    function: str = "avg",
    partition_by: str | Sequence[str] = (),
    order_by: str | Sequence[str] = (),
    page_rows: int = paging.PAGE_ROWS,
) -> DataFrame:
    """``<column>_rolling_<function>`` over the last ``window`` rows of the key.

    Windows that reach back over more than a page are put together from running values, see ``frames``; sums of floating
    columns are then differences of running sums and agree with a plain window up to rounding.
    """
    aggregate = ROLLING[function]
    keys, order = as_list(partition_by), sort_columns(order_by)
    pages = paging.paged(df, keys, order, page_rows)
    if window - 1 > page_rows:
        names = {c: f"{c}_rolling_{function}" for c in as_list(columns)}
        return paging.unpaged(frames.long_frames(pages, keys, names, window, function, page_rows))
    build = {
        f"{c}_rolling_{function}": (lambda w, c=c: aggregate(exact(c)).over(w.rowsBetween(-(window - 1), 0)))
        for c in as_list(columns)
    }
    return paging.unpaged(paging.look_around(pages, keys, build, back=window - 1, page_rows=page_rows))


def forward_fill(
    df: DataFrame,
    keys: str | Sequence[str],
    order_by: str | Sequence[str],
    columns: str | Sequence[str],
    page_rows: int = paging.PAGE_ROWS,
) -> DataFrame:
    """NULLs take the latest earlier value of the same key."""
    names = as_list(columns)
    pages = paging.paged(df, as_list(keys), sort_columns(order_by), page_rows)
    job = paging.latest_values({f"_filled_{c}": F.col(c) for c in names})
    filled = paging.running(pages, as_list(keys), job, page_rows).withColumns({c: F.col(f"_filled_{c}") for c in names})
    return paging.unpaged(filled).select(*df.columns)


def top_k(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values with count and share of the non-NULL rows; ties by value."""
    present = df.filter(exact(col).isNotNull())
    total = one_row(df, n=F.count(exact(col)))["n"]
    return (
        present.groupBy(exact(col).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), F.col("value"))
        .limit(k)
        .withColumn("percentage", F.round(F.col("count") * 100.0 / total, 2).cast("double"))
    )


def recent(
    df: DataFrame,
    ts: str | Sequence[str],
    n: int,
    offset: int = 0,
    filters: Mapping[str, object] | None = None,
    held: int = seek.HELD,
) -> DataFrame:
    """The newest rows first, NULL times last, one page of them, however deep."""
    for name, value in (filters or {}).items():
        df = df.filter(exact(name) == value)
    return seek.page(df, [seek.By(c, down=True, nulls_last=True) for c in as_list(ts)], n, offset, held)
