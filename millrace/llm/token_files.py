"""Token ids of all documents as binary files, in the order of their ids, and back.

A file is a row of records, one for each document (all numbers little-endian)::

    magic "S8B1" | flags u32 (1: no document id) | document id i64 | ids u64 | blocks u32 | words u32 | escapes u32
    | crc32 of what follows u32 | first word of each block u32 … (filled up to 8 bytes) | words u64 … | escapes u64 …

and eight bytes that end it (``END``). Words and escapes are those of ``simple8b``. Records begin at multiples of eight
bytes. Files are written by Spark's own text writer and read by its binary reader, so they can be in any store that Spark
knows, and a task that is lost or runs twice leaves nothing behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import simple8b
from millrace.llm.common import col, texts_of
from millrace.llm.packing import END_ID, word_ids
from millrace.session import stage

HEADER = struct.Struct("<4sIqQIIII")
MAGIC, END, NO_ID = b"S8B1", "\n.\n.\n.\n\n", 1
# Text that goes into a file, in bytes; its ids take half of that or a little more. A document is never cut, so a file
# with a very long one is larger.
FILE_TEXT = 24 << 20
# Ids that are packed or unpacked together.
TOGETHER = 1 << 18
# Documents without an id stand before all others.
BEFORE_ALL = -(1 << 63)

RECORDS = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("record", pa.binary())])
DIGESTS = pa.schema([("file", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
IDS = pa.schema([("file", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("ids", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Record:
    doc_id: int | None
    packed: simple8b.Packed


def to_bytes(doc_id: int | None, packed: simple8b.Packed) -> bytes:
    """A record without its end mark."""
    gap = b"\0" * (-4 * len(packed.offsets) % 8)
    body = b"".join([packed.offsets.astype("<u4").tobytes(), gap, packed.words.astype("<u8").tobytes(), packed.escapes.astype("<u8").tobytes()])
    sizes = len(packed.offsets), len(packed.words), len(packed.escapes)
    return HEADER.pack(MAGIC, NO_ID if doc_id is None else 0, doc_id or 0, packed.count, *sizes, zlib.crc32(body)) + body


def records(data: bytes) -> Iterator[Record]:
    """The records of a file; raises ValueError where it is damaged."""
    view, at, end = memoryview(data), 0, END.encode()
    while at < len(view):
        if len(view) - at < HEADER.size:
            raise ValueError("a token file ends inside a record")
        magic, flags, doc_id, count, blocks, words, escapes, crc = HEADER.unpack_from(view, at)
        at += HEADER.size
        size = -(-4 * blocks // 8) * 8 + 8 * (words + escapes)
        body = view[at : at + size]
        if magic != MAGIC or zlib.crc32(body) != crc or view[at + size : at + size + len(end)] != end:
            raise ValueError("a token file is damaged")
        at += size + len(end)
        numbers = np.frombuffer(body, "<u8", words + escapes, -(-4 * blocks // 8) * 8)
        packed = simple8b.Packed(count, np.frombuffer(body, "<u4", blocks), numbers[:words], numbers[words:])
        yield Record(None if flags & NO_ID else doc_id, packed)


def cuts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_text: int = FILE_TEXT) -> list[int]:
    """Document ids that part a table into files of about ``file_text`` bytes of text; an id with many rows is named repeatedly.

    The ids are quantiles of the id column alone; the driver gets one number for each file.
    """
    size = df.agg(F.sum(F.octet_length(col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    files = -(-size // file_text)
    if files < 2:
        return []
    shares = F.array(*[F.lit(i / files) for i in range(1, files)])
    known = F.coalesce(col(id_col).cast("long"), F.lit(BEFORE_ALL))
    return [int(x) for x in df.agg(F.percentile_approx(known, shares, max(10_000, 20 * files)).alias("cuts")).first()["cuts"]]


def encode(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, parted_at: Sequence[int] = ()
) -> DataFrame:
    """(file, doc_id, n_tokens, record) of every row: its ids and ``end_id``, packed; null texts are empty.

    ``file``: place of the document id among ``parted_at``. An id that is named there repeatedly is dealt to all files that it
    may be in, one row after the other.
    """
    bounds = np.array(parted_at, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, dealt = word_ids(tokenizer), end_id.to_bytes(4, "little"), 0

        def made(doc_ids: list, lists: list) -> pa.RecordBatch:
            nonlocal dealt
            packed = simple8b.pack(lists)
            rows = [to_bytes(i, p) for i, p in zip(doc_ids, packed)]
            keys = np.array([BEFORE_ALL if i is None else i for i in doc_ids], np.int64)
            low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            files = low + (dealt + np.arange(len(keys))) % (high - low + 1)
            dealt += len(keys)
            columns = [files, doc_ids, [p.count for p in packed], rows]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS)], schema=RECORDS)

        for batch in batches:
            doc_ids, lists, held = [], [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                doc_ids.append(doc_id)
                lists.append(np.frombuffer(ids + end, "<u4"))
                held += len(lists[-1])
                if held >= TOGETHER:
                    yield made(doc_ids, lists)
                    doc_ids, lists, held = [], [], 0
            yield made(doc_ids, lists)

    return texts_of(df, id_col, text_col).mapInArrow(run, "file int, doc_id long, n_tokens long, record binary")


def write(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", file_text: int = FILE_TEXT) -> None:
    """Write the ids of every row's text and the end id to files below ``path``, in ascending order of the document ids.

    Rows without an id come first. Rows that share an id stand one after the other, in no particular order; a hot id is
    dealt to many files. The texts are encoded once, where they lie, and only the packed records are shuffled. Other columns
    are not read. An empty table gives no file.
    """
    parted_at = cuts(df, id_col, text_col, file_text)
    packed = encode(df, tokenizer, id_col, text_col, parted_at=parted_at)
    # More partitions than files, so that few of them get two.
    gathered = packed.repartition(3 * len(parted_at) + 1, "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "n_tokens")
    # The text writer puts the bytes of a string down as they are.
    lines = gathered.select("file", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("file").option("lineSep", END).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): whole files with their number."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract("path", r"/file=(\d+)/[^/]*$", 1).cast("long").alias("file"), "content")


def _together(data: bytes) -> Iterator[tuple[list[Record], list[np.ndarray]]]:
    """The records of a file with their ids, unpacked many at a time."""
    held, count = [], 0
    for record in records(data):
        held.append(record)
        count += record.packed.count
        if count >= TOGETHER:
            yield held, simple8b.unpack([r.packed for r in held])
            held, count = [], 0
    if held:
        yield held, simple8b.unpack([r.packed for r in held])


def _read(spark: SparkSession, path: str, schema: pa.Schema, ddl: str, value) -> DataFrame:
    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                within = 0
                for found, lists in _together(data.as_buffer()):
                    counts = np.array([r.packed.count for r in found])
                    places = within + np.cumsum(counts) - counts
                    within += int(counts.sum())
                    columns = [[file] * len(found), [r.doc_id for r in found], places, *value(found, lists)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return _files(spark, path).mapInArrow(run, ddl)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, within, ids array<long>) of every record; ``within``: ids of the same file before it."""
    return _read(spark, path, IDS, "file long, doc_id long, within long, ids array<long>", lambda found, lists: [[x.astype(np.int64) for x in lists]])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files below ``path``.

    start: ids of all records before it; ids_crc32: of its ids as unsigned 32-bit numbers, little-endian. Every file is read
    once. The files' sums are added up in one task: a row for each file.
    """

    def value(found, lists):
        return [[r.packed.count for r in found], [zlib.crc32(x.astype("<u4").tobytes()) for x in lists]]

    ddl = "file long, doc_id long, within long, n_tokens long, ids_crc32 long"
    found = stage(_read(spark, path, DIGESTS, ddl, value), "token_digests")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    offsets = sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    placed = found.join(offsets, "file")
    return placed.select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
