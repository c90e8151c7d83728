"""Look-back windows that are longer than a page.

Sums and counts are differences of running ones: the value at a row less the value ``window`` rows before it. Minima and
maxima cut every key into blocks of ``window`` rows: a window is the end of one block and the beginning of the next, so it
is the better of a running extreme from the right and one from the left. Running values come page by page, and the two
ends of a window meet by a join on the row's position, which no two rows share.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.order import PAGE, POS, PAGE_ROWS, Running, _so_far, row_numbers, running, running_sum
from millrace.functions.scalars import exact
from millrace.session import stage


def running_extreme(name: str, value: Column, largest: bool) -> Running:
    """Minimum or maximum of ``value`` over the key up to and including the row."""
    pick, better = (F.max, F.greatest) if largest else (F.min, F.least)
    return Running(
        local={"_end_here": lambda w: pick(value).over(_so_far(w))},
        per_page={"_end_page": pick(value)},
        fold=lambda edges, earlier: edges.withColumn("_end_before", pick("_end_page").over(earlier)),
        carried=["_end_before"],
        result={name: better(F.col("_end_here"), F.col("_end_before"))},
    )


def long_frames(pages: DataFrame, keys: list[str], names: Mapping[str, str], window: int, function: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Add for each column its sum, avg, count, min or max over the last ``window`` rows of the key, under the given names."""
    placed = stage(running(pages, keys, row_numbers("_nth"), page_rows), "numbered")
    for column, name in names.items():
        add = _by_extremes if function in ("min", "max") else _by_sums
        placed = add(placed, keys, exact(column), name, window, function, page_rows)
    return placed.drop("_nth")


def _by_sums(placed: DataFrame, keys: list[str], value: Column, name: str, window: int, function: str, page_rows: int) -> DataFrame:
    there = value.isNotNull().cast("bigint")
    body = running(placed, keys, running_sum("_n", there), page_rows)
    ends = ["_n"]
    if function != "count":
        body = running(body, keys, running_sum("_sum", F.coalesce(value, F.lit(0))), page_rows, is_clustered=True)
        ends.append("_sum")
    body = stage(body, "running")
    earlier = body.select((F.col(POS) + window).alias(POS), *[F.col(c).alias(f"{c}_before") for c in ends])
    joined = body.join(earlier, POS, "left")
    zero = F.lit(0)
    part = {c: F.col(c) - F.when(F.col("_nth") > window, F.col(f"{c}_before")).otherwise(zero) for c in ends}
    if function == "count":
        result = part["_n"]
    else:
        total = F.when(part["_n"] > 0, part["_sum"])
        result = total if function == "sum" else total / part["_n"]
    return joined.withColumn(name, result).drop(*ends, *[f"{c}_before" for c in ends])


def _by_extremes(placed: DataFrame, keys: list[str], value: Column, name: str, window: int, function: str, page_rows: int) -> DataFrame:
    largest = function == "max"
    better = F.greatest if largest else F.least
    blocks = placed.withColumn("_block", F.floor((F.col("_nth") - 1) / window))
    within = [*keys, "_block"]
    last = blocks.agg(F.max(POS)).first()[0] or 0  # one number
    turned = blocks.withColumn(POS, F.lit(last) - F.col(POS)).withColumn(PAGE, F.floor(F.col(POS) / page_rows))
    to_end = running(turned, within, running_extreme("_to_end", value, largest), page_rows)
    # The window of a row begins window - 1 rows before it: there the block's rest is looked up.
    begun = to_end.select((F.lit(last) - F.col(POS) + (window - 1)).alias(POS), "_to_end")
    from_start = running(blocks, within, running_extreme("_from_start", value, largest), page_rows)
    joined = from_start.join(begun, POS, "left")
    whole = better(F.col("_from_start"), F.when(F.col("_nth") > window, F.col("_to_end")))
    return joined.withColumn(name, whole).drop("_block", "_from_start", "_to_end")
