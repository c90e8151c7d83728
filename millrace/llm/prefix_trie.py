"""Trie of the turns that conversations begin with, by collapsing whole conversations first.

Equal conversations become one weighted sequence with the list of those that end there. Sequences that are a proper prefix of
another one are found by an anti-join; the others are the leaves. All counts of a node are then sums over the rows
(sequence, depth), one for each turn of each different conversation: no pair of a node and a node below it is ever made.

A prefix is known by the sum of the digests of its turns, each taken together with its place. Sums can be built page by page,
so a conversation of any length spreads over tasks, and the prefix before a turn is had by subtraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import order
from millrace.llm.common import col
from millrace.session import stage

PAGE_TURNS = 1 << 18
# A digest is five numbers of 32 bits, so that the sums of 2^31 turns fit into a long.
PARTS = [f"s{i}" for i in range(5)]
NO_WORD = "\\x20\\x09-\\x0D"
# Bytes of a piece of an end list.
PIECE = 1 << 16


def numbered_turns(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", page_turns: int = PAGE_TURNS
) -> DataFrame:
    """(conv, nth from 1, mark, words): every row with its place in its conversation, a digest of role and text, and its words.

    By turn (nulls first), equal turns by role and digest. Null roles and texts are empty. Only these narrow rows are sorted.
    """
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    narrow = df.select(
        col(conv_col).cast("long").alias("conv"),
        col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("mark"),
        F.regexp_count(text, F.lit(f"[^{NO_WORD}]+")).cast("long").alias("words"),
    )
    pages = order.paged(stage(narrow, "turns"), ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")], page_turns)
    placed = order.running(pages, ["conv"], order.row_numbers("nth"), page_turns)
    return placed.select("conv", "nth", "mark", "words")


def with_shared_openings(turns: DataFrame, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (conv, depth, mark, words, length) and (conv, length).

    Conversation c takes the first h turns of conversation ``c - c % family`` (fewer if it has no more, none if there is
    none) and its own turns after its first h; h is the crc32 of its decimal id, modulo 4. A conversation without an id is
    left as it is. One row for each of the three first turns of a conversation meets the conversations of its family.
    """
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    given = F.coalesce(F.crc32(F.col("conv").cast("string").cast("binary")) % 4, F.lit(0))
    heads = own.select("conv", "n", given.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("head"))
    first = own.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    taken = F.least(F.coalesce("head_n", F.lit(0)), "h")
    shapes = heads.join(first, "head", "left").withColumn("taken", taken)
    shapes = stage(shapes.select("conv", "h", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "shapes")
    opening = turns.filter("nth <= 3").withColumnRenamed("conv", "head").join(shapes, "head").filter("nth <= h")
    opening = opening.select("conv", F.col("nth").alias("depth"), "mark", "words", "length")
    shape = shapes.select(F.col("conv").alias("of"), "h", "taken", "length")
    rest = turns.join(shape, F.col("conv").eqNullSafe(F.col("of"))).filter("nth > h")
    rest = rest.select("conv", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "mark", "words", "length")
    return opening.unionByName(rest), shapes.select("conv", "length")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations unchanged, in the form of ``with_shared_openings``."""
    lengths = stage(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length")), "lengths")
    own = lengths.withColumnRenamed("conv", "of")
    rows = turns.withColumnRenamed("nth", "depth").join(own, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    return rows, lengths


def _key(parts: list[Column], depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[p.cast("string") for p in parts], depth.cast("string"))))


def _root() -> Column:
    return _key([F.lit(0)] * len(PARTS), F.lit(0))


def prefixes(rows: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """(conv, depth, length, key, parent, words, before): for each turn the prefix that ends with it, the one before it, and the words before it.

    Sums run inside pages of a conversation; a page gets the sums of the earlier pages by a join, which conversations of a
    single page, and so most tables, have no rows for.
    """
    digest = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("mark")), 256)
    parts = {p: F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i, p in enumerate(PARTS)}
    cut = rows.withColumn("digest", digest).withColumns({**parts, "page": F.floor((F.col("depth") - 1) / page_turns)})
    cut = stage(cut.select("conv", "page", "depth", "length", "words", *PARTS), "turn_digests")
    summed = [*PARTS, "words"]
    totals = cut.groupBy("conv", "page").agg(*[F.sum(c).alias(c) for c in summed], F.max("length").alias("length"))
    earlier = Window.partitionBy("conv").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.filter(F.col("length") > page_turns).select(
        F.col("conv").alias("of"), F.col("page").alias("of_page"), *[F.sum(c).over(earlier).alias(f"{c}_in") for c in summed]
    )
    here = Window.partitionBy("conv", "page").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = cut.withColumns({f"{c}_here": F.sum(c).over(here) for c in summed})
    joined = running.join(carried, F.col("conv").eqNullSafe(F.col("of")) & (F.col("page") == F.col("of_page")), "left")
    so_far = {c: F.col(f"{c}_here") + F.coalesce(F.col(f"{c}_in"), F.lit(0)) for c in summed}
    return joined.select(
        "conv",
        "depth",
        "length",
        _key([so_far[p] for p in PARTS], F.col("depth")).alias("key"),
        _key([so_far[p] - F.col(p) for p in PARTS], F.col("depth") - 1).alias("parent"),
        "words",
        (so_far["words"] - F.col("words")).alias("before"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the conversations that end at a node, ascending, joined by commas.

    A hash runs over its whole list, so the list of a hot node has to pass through one task. It does so as a stream of long
    pieces that were put together, sorted, in as many tasks as Spark likes; no list is held as a whole.
    """
    piece_schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("piece", pa.binary())])
    sha_schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, key, first, held, size = [], None, None, [], 0
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (k != key or size > PIECE):
                    made.append((key, first, ",".join(held).encode()))
                    held, size = [], 0
                if not held:
                    key, first = k, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if held:
                made.append((key, first, ",".join(held).encode()))
            columns = list(zip(*made)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, piece_schema)], schema=piece_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if sha is None or k != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
            columns = list(zip(*done)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, sha_schema)], schema=sha_schema)
            done = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], schema=sha_schema)

    known = ends.filter(F.col("conv").isNotNull()).select("key", "conv")
    ranged = known.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    lists = ranged.mapInArrow(pieces, "key binary, first long, piece binary")
    gathered = lists.repartition("key").sortWithinPartitions("key", "first")
    return gathered.mapInArrow(digest, "key binary, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Every node of the trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``rows``: (conv, depth, mark, words, length), a row for each turn; ``lengths``: (conv, length), a row for each
    conversation, also for those without turns. conv_id: the smallest conversation that begins with the node's turns, null only
    if none of them has an id; conversations without an id count, but are not in the end lists. An empty table has no node.

    Saved words below a node are those of all its conversations from the node on, less those of every different turn once.
    A turn is counted for the sequence with the smallest conversation among those that share it. Which turns of a
    sequence are counted for it follows from the first such turn alone: if it is the first of all sequences that share a
    prefix, it is the first of those that share a longer one. So a sequence contributes a suffix sum to each of its prefixes.
    """
    found = stage(prefixes(rows, page_turns), "prefixes")
    nowhere = lengths.filter("length = 0").select(_root().alias("key"), "conv", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("length"))
    last = found.filter("depth = length").select("key", "conv", (F.col("before") + F.col("words")).alias("total"), F.col("length").cast("long").alias("length"))
    ends = stage(last.unionByName(nowhere), "ends")

    # Whole sequences: weight, total words, and the conversation they are read from.
    alike = ends.groupBy("key").agg(F.min("conv").alias("one"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total"), F.max("length").alias("n"))
    sequences = stage(alike, "sequences")
    chosen = sequences.select("one", "weight", "total", "n")
    # The row for the root stands before the first turn.
    below = found.join(chosen, F.col("conv").eqNullSafe(F.col("one"))).select("one", "weight", "total", "n", "depth", "key", "parent", "before")
    zero = F.lit(0).cast("long")
    at_root = chosen.select("one", "weight", "total", "n", zero.alias("depth"), _root().alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("before"))
    steps = stage(below.withColumn("depth", F.col("depth").cast("long")).unionByName(at_root), "steps")

    inner = steps.filter("depth < n").select("key").distinct()
    leaves = sequences.join(inner, "key", "left_anti").select("one", F.lit(1).cast("long").alias("leaf"))
    firsts = steps.groupBy("key").agg(F.min("one").alias("first"))
    mine = F.col("one").eqNullSafe(F.col("first")) & (steps["key"] == firsts["key"])
    counted = steps.join(firsts, mine).groupBy("one").agg(F.min("before").alias("counted_from"))
    marks = counted.join(leaves.withColumnRenamed("one", "leaf_one"), F.col("one").eqNullSafe(F.col("leaf_one")), "full_outer")
    marks = marks.select(F.coalesce("one", "leaf_one").alias("of"), "leaf", "counted_from")

    weighted = steps.join(marks, F.col("one").eqNullSafe(F.col("of")), "left")
    from_here = F.col("weight") * (F.col("total") - F.col("before"))
    once = F.col("total") - F.greatest(F.col("before"), F.coalesce(F.col("counted_from"), F.col("total")))
    nodes = weighted.groupBy("key").agg(
        F.min("one").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.sum("weight").alias("n_convs"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
        (F.sum(from_here) - F.sum(once)).alias("saved_tokens"),
    )
    nodes = stage(nodes, "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(above, "parent", "left").join(children, "key", "left").join(end_digests(ends), "key", "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Trie of the conversations of a table; see ``trie`` and, for ties and nulls, ``numbered_turns``."""
    return trie(*as_they_are(stage(numbered_turns(df, conv_col, turn_col, role_col, text_col), "numbered")))


def rebuilt_trie(df: DataFrame, family: int = 20) -> DataFrame:
    """Trie of the conversations after ``with_shared_openings``."""
    return trie(*with_shared_openings(stage(numbered_turns(df), "numbered"), family))
