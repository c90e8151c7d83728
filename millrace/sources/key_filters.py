"""Which files of a table may hold certain keys: ranges of the first key, and Bloom filters over all keys.

A file's filter is a row of blocks of 32,768 bits (the bitmap type of Spark's own bitmap functions). A key belongs to one block
and sets ``PROBES`` bits of it, so looking it up reads one block. Filters are built and looked up by Spark jobs; the
driver only sees one row for each file.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from millrace.functions.scalars import exact

BITS = 1 << 15
PROBES = 4
# Blocks for each MB of the largest file: about 8 bits for each key of 16 stored bytes.
BLOCKS_PER_MB = 16
# Pieces by which the changed keys are compared with the files' ranges.
PIECES = 64
FEW_FILES = 8  # up to so many files one range is enough
# Kinds of keys whose order is that of the text or number in the list of files; others have no range, only filters.
RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def _positions(keys: Sequence[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i + 1), *keys), F.lit(BITS)).cast("int") for i in range(PROBES)]


def build(rows: DataFrame, keys: Sequence[str], largest: int, path: str) -> int:
    """Write the filters of the files that ``rows`` is read from, with counts and ranges; returns the number of blocks of each.

    Rows of the result: (file, block, bits, rows, low, high), low and high as text.
    """
    blocks = 1
    while blocks < BLOCKS_PER_MB * largest >> 20:
        blocks *= 2
    filters(rows, keys, blocks).write.parquet(path)
    return blocks


def filters(rows: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """The rows that ``build`` writes.

    Bits are first gathered into words of 64, which are plain numbers and hashed; an aggregate of bitmaps would sort four rows
    for each key. A word's bytes stand as in the bitmap, so its hex digits are a piece of the block's.
    """
    marked = rows.select(
        F.col("_metadata.file_path").alias("file"),
        _block(keys, blocks).alias("block"),
        exact(keys[0]).alias("first"),
        F.posexplode(F.array(*_positions(keys))).alias("probe", "position"),
    )
    shift = 56 - F.shiftright(F.col("position") % 64, 3) * 8 + F.col("position") % 8
    of_word = marked.groupBy("file", "block", F.shiftright("position", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), shift)).alias("set"),
        F.count_if(F.col("probe") == 0).alias("rows"), F.min("first").alias("low"), F.max("first").alias("high"),
    )
    of_block = of_word.groupBy("file", "block").agg(
        F.array_sort(F.collect_list(F.struct("word", "set"))).alias("words"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    before = lambda i: F.coalesce(F.get("words", i - 1).getField("word"), F.lit(-1))
    pieces = F.transform("words", lambda w, i: F.concat(F.repeat(F.lit("0"), 16 * (w.getField("word") - before(i) - 1)), F.lpad(F.hex(w.getField("set")), 16, "0")))
    bits = F.unhex(F.rpad(F.array_join(pieces, ""), BITS // 4, "0"))
    return of_block.select("file", "block", bits.alias("bits"), "rows", "low", "high")


def ranges(rows: DataFrame, key: str) -> DataFrame:
    """(file, rows, low, high) of the files that ``rows`` is read from, without filters."""
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.min(exact(key)).alias("low"), F.max(exact(key)).alias("high"))


def summary(stored: DataFrame, ranged: bool) -> list[Row]:
    """(file, rows, low, high) of the files of one write, the ends as they are kept in the list of files."""
    kind = stored.schema["low"].dataType
    bound = (lambda c: c.cast("string") if isinstance(kind, T.DateType) else c) if ranged else (lambda c: F.lit(None))
    per_file = stored.groupBy("file").agg(F.sum("rows").alias("rows"), bound(F.min("low")).alias("low"), bound(F.max("high")).alias("high"))
    return per_file.collect()  # a row for each file


def pieces(touched: DataFrame, key: str, most: int = PIECES) -> tuple[list[tuple] | None, int]:
    """(at most ``most`` ranges, in order, that hold all keys; the number of rows). The ranges are None if a key is null."""
    column = exact(key)
    text = column.cast("string") if isinstance(touched.schema[key].dataType, T.DateType) else column
    keys = touched.select(text.alias("k"))
    parts = keys.repartitionByRange(most, "k").groupBy(F.spark_partition_id().alias("p")) if most > 1 else keys.groupBy()
    found = parts.agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("k").isNull()).alias("nulls"), F.count("*").alias("rows"))
    rows = [r for r in found.collect() if r["rows"]]  # a row for each piece
    ranges = None if any(r["nulls"] for r in rows) else sorted((r["low"], r["high"]) for r in rows)
    return ranges, sum(r["rows"] for r in rows)


def overlapping(files: Iterable, ranges: list[tuple]) -> list:
    """The files whose range meets one of the ordered ranges, and those without a range."""
    ends = [high for _, high in ranges]
    found = []
    for f in files:
        if f.rows == 0:
            continue
        if f.low is None:
            found.append(f)
            continue
        at = bisect_left(ends, f.low)  # the first range that does not end before the file begins
        if at < len(ranges) and ranges[at][0] <= f.high:
            found.append(f)
    return found


def holding(path: str, files: Iterable, schema: T.StructType, keys: Sequence[str], touched: DataFrame, probe_from: int) -> tuple[list, int]:
    """(the files of a table below ``path`` that may hold one of the keys of ``touched``, its rows); never misses a file.

    Filters are not looked up for candidates of less than ``probe_from`` bytes together: reading these is quicker.
    """
    named = list(files)
    wanted = touched.select(*[exact(k).cast(schema[k].dataType).alias(k) for k in keys])
    if isinstance(schema[keys[0]].dataType, RANGED):
        ranges, rows = pieces(wanted, keys[0], PIECES if len(named) > FEW_FILES else 1)
        named = named if ranges is None else overlapping(named, ranges)
    else:
        rows = wanted.count()
    if not named or sum(f.size for f in named) < probe_from:
        return named, rows
    hits, places = None, {f.path for f in named if not f.blocks}
    for blocks in sorted({f.blocks for f in named} - {0}):  # powers of two: a handful
        mine = [f for f in named if f.blocks == blocks]
        filters = touched.sparkSession.read.parquet(*[f"{path}/filters/{w}" for w in sorted({f.write for f in mine})]).select("file", "block", "bits")
        probes = wanted.select(_block(keys, blocks).alias("block"), F.array(*_positions(keys)).alias("at"))
        met = probes.join(filters, "block").filter(reduce(lambda a, b: a & b, [_bit(i) for i in range(PROBES)])).select("file").distinct()
        hits = met if hits is None else hits.unionAll(met)
    if hits is not None:
        places |= {"data/" + unquote(r["file"]).rsplit("/data/", 1)[1] for r in hits.collect()}  # a row for each file at most
    return [f for f in named if f.path in places], rows


def _bit(i: int) -> Column:
    """Whether the ``i``-th bit of a key is set in a block."""
    at = F.col("at")[i]
    byte = F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), at % 8) == 1
