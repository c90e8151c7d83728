"""SimHash near-duplicates by a hierarchical index in Gray order.

Distinct fingerprints are sorted by their rank in the Gray code, so that neighbours share most bits. Runs of
neighbours form groups; the bits that all members of a group share become its masked pattern, groups of groups get the
bits shared by all of them, and each lower node keeps only the bits that its parent lacks. A search goes down from the
root, adds up the differing bits of the patterns it passes, and drops a whole subtree when they exceed the limit.

The same index is used twice: a small one over all groups finds the groups that a fingerprint must visit, and one in
each group finds the partners there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import rows, texts_of
from millrace.llm.components import components, forest
from millrace.session import stage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
FANOUT = 4
# A group is the home of about so many fingerprints; there are at least MIN_GROUPS, always a power of two.
GROUP_SIZE = 1 << 16
MIN_GROUPS = 64
QUERIES_AT_ONCE = 2048

ALL_BITS = np.uint64(2**64 - 1)
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(raw: bytes, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text: a bit is set if it is set in more than half of the hashes of its word shingles.

    A-Z are lower-cased; a text with fewer words than a shingle has one shingle, one without words the fingerprint 0.
    """
    words = raw.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = min(width, len(words)) - 1
    starts, ends = (ends - sizes)[: len(words) - last].tolist(), ends[last:].tolist()
    hashed = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 1 << 14):
        part = hashed[i : i + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashed), bitorder="little").view("<i8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code word (uint64) in the Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _gray_order(fp: Column) -> Column:
    """``gray_rank`` as a signed long that sorts like the unsigned rank."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


@dataclass
class Index:
    """Levels of nodes from the root down; each node has a pattern on the bits of its mask that its parent lacks."""

    masks: list[np.ndarray]
    patterns: list[np.ndarray]

    @staticmethod
    def build(masks: np.ndarray, patterns: np.ndarray) -> Index:
        """Over leaves in Gray order: patterns that hold on the bits of their masks."""
        levels = [(masks, patterns & masks)]
        while len(levels[0][0]) > 1:
            m, p = levels[0]
            cuts = np.arange(0, len(m), FANOUT)
            all_one, all_zero = np.bitwise_and.reduceat(p & m, cuts), np.bitwise_and.reduceat(~p & m, cuts)
            levels.insert(0, (all_one | all_zero, all_one))
        own = [levels[0][0]]
        for (upper, _), (lower, _) in zip(levels, levels[1:]):
            own.append(lower & ~np.repeat(upper, FANOUT)[: len(lower)])
        return Index(own, [p for _, p in levels])

    def search(self, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``codes``, leaf) of all pairs that differ in at most ``limit`` bits of the leaf's whole mask."""
        query, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        differing = np.zeros(len(codes), np.uint8)
        for depth, (mask, pattern) in enumerate(zip(self.masks, self.patterns)):
            if depth:
                query, differing = np.repeat(query, FANOUT), np.repeat(differing, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                if len(node) and node[-1] >= len(mask) or (node >= len(mask)).any():
                    there = node < len(mask)
                    query, node, differing = query[there], node[there], differing[there]
            differing = differing + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node])
            near = differing <= limit
            query, node, differing = query[near], node[near], differing[near]
        return query, node


def fingerprints(df: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""

    def run(batches):
        yield from rows(batches, FINGERPRINTS, lambda raw: (fingerprint(raw, width),))

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect the distinct values of ``fp`` exactly as all pairs with at most ``limit`` differing bits do.

    Groups are cut at quantiles of the Gray rank. What reaches the driver is one pattern for each group, GROUP_SIZE times
    fewer than fingerprints. Each fingerprint is sent to its own group and to the later ones its search reaches, so
    that each pair meets once. A task holds the home fingerprints of a group; visitors stream past them.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    groups = max(MIN_GROUPS, 1 << max(0, (-(-n // GROUP_SIZE) - 1).bit_length()))
    ordered = distinct.select("fp", _gray_order(F.col("fp")).alias("rank"))
    shares = F.array(*[F.lit(i / groups) for i in range(1, groups)])
    cuts = ordered.agg(F.percentile_approx("rank", shares, F.lit(max(10_000, 4 * groups))).alias("cuts")).first().cuts
    if not cuts:
        return spark.createDataFrame([], "a long, b long")
    bounds = np.array(sorted(set(cuts)), np.int64)

    def place(batches):
        for batch in batches:
            group = np.searchsorted(bounds, batch.column(1).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group, pa.int64())], names=["fp", "home"])

    homes = stage(ordered.mapInArrow(place, "fp long, home long"), "homes")
    patterns = homes.groupBy("home").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any")).orderBy("home").collect()
    number = np.array([r.home for r in patterns], np.int64)
    ones, any_ = (np.array([r[k] for r in patterns], np.int64).view(np.uint64) for k in (1, 2))
    upper = Index.build(~(ones ^ any_), ones)

    def visit(batches):
        for batch in batches:
            codes, home = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(0, len(codes), QUERIES_AT_ONCE):
                part, own = codes[i : i + QUERIES_AT_ONCE], home[i : i + QUERIES_AT_ONCE]
                query, leaf = upper.search(part.view(np.uint64), limit)
                target = number[leaf]
                later = target >= own[query]
                query, target = query[later], target[later]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(target), pa.array(target != own[query]), pa.array(part[query])], names=["target", "visitor", "fp"]
                )

    visits = homes.mapInArrow(visit, "target long, visitor boolean, fp long")
    met = visits.repartition(len(number), "target").sortWithinPartitions("target", "visitor")
    return met.mapInArrow(lambda batches: _meet(batches, limit), "a long, b long")


def _meet(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links of each group: its home rows come first and become the index, all rows are searched in it."""
    group, home, index, codes = None, [], None, None

    def built():
        members = np.concatenate(home).view(np.uint64)
        members = members[np.argsort(gray_rank(members), kind="stable")]
        return Index.build(np.full(len(members), ALL_BITS), members), members

    def found(part: np.ndarray, inside: bool):
        for i in range(0, len(part), QUERIES_AT_ONCE):
            some = part[i : i + QUERIES_AT_ONCE]
            query, leaf = index.search(some, limit)
            a, b = some[query], codes[leaf]
            if inside:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in forest(a, b)], names=["a", "b"])

    for batch in batches:
        target, visitor, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        edges = np.flatnonzero(np.diff(target) != 0) + 1
        for t, v, f in zip(np.split(target, edges), np.split(visitor, edges), np.split(fp, edges)):
            if not len(t):
                continue
            if t[0] != group:
                if home and index is None:
                    index, codes = built()
                    yield from found(codes, True)
                group, home, index, codes = t[0], [], None, None
            if not v.all():
                home.append(f[~v])
            if v.any():
                if index is None and home:
                    index, codes = built()
                    yield from found(codes, True)
                if index is not None:
                    yield from found(f[v].view(np.uint64), False)
    if home and index is None:
        index, codes = built()
        yield from found(codes, True)


def near_duplicates(df: DataFrame, limit: int = MAX_BITS, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Documents link when their fingerprints differ in at most ``limit`` bits, all of them: equal fingerprints are searched
    once and stand for any number of rows, without a cap on groups or partners. Texts without words, null ones
    included, have the fingerprint 0 and link like any other. ``component_id`` is the smallest id reachable; rows
    with a null id take part, but only name a component (null) that has no other id. Further columns are not read.
    """
    prints = stage(fingerprints(df, width, id_col, text_col), "fingerprints")
    named = _roots(prints, limit).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text: Column) -> Column:
    """A hash by which equal texts are known; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def grouped(df: DataFrame, limit: int = MAX_BITS, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, root) of every row: rows with the same ``root`` are one group of near-duplicates, whatever their ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            made = [fingerprint(raw, width) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.int64())], schema=schema)

    keyed = texts_of(df, id_col, text_col).withColumn("text_key", text_key(F.col("text")))
    prints = stage(keyed.mapInArrow(run, "doc_id long, text_key long, fp long"), "fingerprints")
    return prints.join(_roots(prints, limit).select("fp", "root"), "fp").select("doc_id", "text_key", "root")


def _roots(prints: DataFrame, limit: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint: its component's smallest fingerprint and smallest document."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(distinct, limit)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(smallest, "root")
