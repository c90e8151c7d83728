"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import col
from millrace.session import stage

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 2
# Rows that are numbered together by one task.
ROWS_PER_BLOCK = 1 << 18


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def even_tree(shards: int) -> list[Leaf]:
    """``shards`` leaves of weight 1: four to a rack, two racks to a region."""
    return [Leaf(s, s // (SHARDS_PER_RACK * RACKS_PER_REGION), s // SHARDS_PER_RACK) for s in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and a region of its own: the subtrees that were there keep their weights."""
    return [*tree, Leaf(*(1 + max(getattr(t, level) for t in tree) for level in ("shard", "region", "rack")), weight)]


def _wait(key: Column, level: str, number: int, weight: float) -> Column:
    """Weighted hash draw of a node: an exponential waiting time with the node's weight as its rate, from key and node."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"/{level}{number}"))), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(uniform) / float(weight)


def descend(df: DataFrame, key: Column, tree: Sequence[Leaf], out: str) -> DataFrame:
    """Add the shard of ``key`` (a string) as ``out``: at each level go to the child with the smallest draw.

    A node's weight is the sum of its leaves' weights, and each level draws for itself: a region among the regions, a rack
    among the racks of that region, a shard among the shards of that rack. So only the children on the way are drawn
    for, and a key's rack in a region does not depend on the other regions, nor its shard on other racks. Where a
    weight changes, keys move into or out of the nodes above it only; subtrees whose weights stay keep their keys in place
    and never exchange any. Leaves without weight get nothing; equal draws go to the node named first.
    """
    leaves = [t for t in tree if t.weight > 0]
    placed, above = df, {None: leaves}
    for level in ("region", "rack", "shard"):
        chosen, below = None, {}
        for parent, inside in above.items():
            children: dict[int, list[Leaf]] = {}
            for t in inside:
                children.setdefault(getattr(t, level), []).append(t)
            below.update(children)
            draws = [F.struct(_wait(key, level, n, sum(t.weight for t in c)).alias("wait"), F.lit(i).alias("nth"), F.lit(n).alias("node")) for i, (n, c) in enumerate(children.items())]
            pick = F.array_min(F.array(*draws))["node"] if len(draws) > 1 else F.lit(next(iter(children)))
            chosen = pick if parent is None else F.when(F.col("_above") == parent, pick) if chosen is None else chosen.when(F.col("_above") == parent, pick)
        placed, above = placed.withColumn("_above", chosen), below
    return placed.withColumnRenamed("_above", out)


def number(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``slot``: the rows of each shard counted from 0 without gaps.

    A shard may hold any share of the table, and a row may be repeated any number of times, so shards are numbered in blocks:
    the rows are written once with a number of their own, which deals them to blocks whatever they hold; the blocks are
    counted, and each block starts where the blocks before it end.
    """
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "placed")
    blocks = max(1, -(-rows.count() // rows_per_block))
    spread = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    sizes = spread.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("_row")
    numbered = spread.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "_block"]).withColumn("slot", F.col("_start") + F.col("_at"))


def assign(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Law ``key``: the id and the number of shards alone decide, so equal ids (and all null ids) share a shard; the text
    doesn't matter. ``grown_shard`` is the place with one more shard, which takes rows from all others and into itself
    alone. ``size`` is the text's UTF-8 bytes plus one, a null text having none. ``slot`` numbers the rows of a shard from 0
    without gaps, in no particular order. Further columns are not read.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    tree = even_tree(shards)
    placed = descend(descend(rows, key, tree, "shard"), key, grown(tree), "grown_shard")
    return number(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
