"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.common import texts_of

WINDOW_TOKENS = 4096
END_ID = 2
# Windows that are balanced together. One batch is held by a task at a time, whatever the size of the table.
BATCH_WINDOWS = 64
CACHED_WORDS = 300_000
CACHED_PIECES = 400_000

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# Words of these characters only are changed by nothing but lower-casing before they are split.
_NOT_PLAIN = re.compile(r"[^\n!-~À-ÖØ-öø-ÿ]")
# The tokenizer's own pieces of such words; a line break ends a word.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")


class WordIds:
    """Ids (little-endian 32 bit, as bytes) of the words between white space; a word's ids don't depend on its neighbours.

    A word goes through the tokenizer once while it stays in the cache. Words of plain characters skip the normaliser,
    which would only lower-case them, and are split here as the tokenizer's pattern does; their pieces are cached too.
    All other words, and those that hold one of the tokenizer's own marks (``<|endoftext|>``), take the whole way. Both
    caches are emptied when they have grown beyond a limit.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.alphabet = str.maketrans(_byte_letters())
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each whole text."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        split = [raw.split() for raw in texts]
        self._learn(list(set(chain.from_iterable(split)).difference(self.words)))
        known = self.words.__getitem__
        for words in split:
            yield b"".join(map(known, words))

    def _learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode("utf-8", "replace")
        marked = any(mark in text for mark in self.marks)
        if marked or _NOT_PLAIN.search(text):
            spelled = [w.decode("utf-8", "replace") for w in words]
            plain = [_NOT_PLAIN.search(w) is None and not (marked and any(m in w for m in self.marks)) for w in spelled]
            for word, own, skip in zip(words, spelled, plain):
                if not skip:
                    self.words[word] = np.array(self.tokenizer.encode(own, add_special_tokens=False).ids, "<u4").tobytes()
            words = [w for w, p in zip(words, plain) if p]
            text = "\n".join(w for w, p in zip(spelled, plain) if p)
        if not words:
            return
        found = _PIECES.findall(text.lower() + "\n")
        for piece in set(found).difference(self.pieces):
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
            self.pieces[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)]) if piece != "\n" else b"\n"
        known, parts, at = self.pieces, [], 0
        for piece in found:
            if piece == "\n":
                self.words[words[at]] = b"".join(parts)
                parts, at = [], at + 1
            else:
                parts.append(known[piece])


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def difference(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp: split ``sizes`` into ``k`` bins with near-equal sums; (sums, indices of each bin).

    Every size starts as a partial partition with one full bin. The two partial partitions with the largest spread are
    merged again and again, the fullest bins of one with the emptiest of the other, so that their imbalances cancel.
    Only bins that hold something are stored. Equal spreads are merged in the order of the sizes.
    """
    if not sizes:
        return [0] * k, [[] for _ in range(k)]
    # A bin is (sum, tree); a tree is an index or a pair of trees. Bins are kept from full to empty.
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        overlap = len(a) + len(b) - k
        if overlap <= 0:
            merged = a + b
        else:  # the last bins of one meet the last bins of the other in opposite order
            free = len(a) - overlap
            joined = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[free:], reversed(b[len(b) - overlap :]))]
            merged = a[:free] + b[: len(b) - overlap] + joined
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], order, merged))
        order += 1
    bins = heap[0][2]
    return [s for s, _ in bins] + [0] * (k - len(bins)), [_leaves(tree) for _, tree in bins] + [[] for _ in range(k - len(bins))]


def _leaves(tree) -> list[int]:
    found, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo.extend(node)
        else:
            found.append(node)
    return sorted(found)


def balance(sizes: list[int], capacity: int = WINDOW_TOKENS) -> list[list[int]]:
    """Indices for each window: as few windows as hold everything, one more whenever one would overflow."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, bins = difference(sizes, k)
        if max(sums) <= capacity:
            return [b for b in bins if b]
        k += 1


class _Packer:
    """Takes documents one by one and gives out rows of whole batches."""

    def __init__(self, first_sequence: int, capacity: int, piece: int, windows: int):
        self.sequence, self.capacity, self.piece, self.limit = first_sequence, capacity, piece, windows * capacity
        self.waiting: list[tuple[int, int, int, int, int]] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // 4
        at = 0
        while n - at >= self.capacity:  # fills a window by itself
            self._row((doc_id, at, self.capacity, _crc(ids, at, self.capacity), n), self.sequence, 0)
            self.sequence += 1
            at += self.capacity
        self.tokens += n - at
        parts = -(-(n - at) // self.piece)  # the rest in equal pieces, so that windows can be filled well
        for i in range(parts):
            end = at + -(-(n - at) // (parts - i))
            self.waiting.append((doc_id, at, end - at, _crc(ids, at, end - at), n))
            at = end
        if self.tokens >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            for members in balance([p[2] for p in self.waiting], self.capacity):
                offset = 0
                for i in members:
                    self._row(self.waiting[i], self.sequence, offset)
                    offset += self.waiting[i][2]
                self.sequence += 1
        self.waiting, self.tokens = [], 0

    def _row(self, piece: tuple, sequence: int, offset: int) -> None:
        self.rows.append((*piece, sequence, offset))

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in SCHEMA.names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SCHEMA)


def _crc(ids: bytes, start: int, length: int) -> int:
    return zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])


def pack(
    df: DataFrame,
    path: str,
    capacity: int = WINDOW_TOKENS,
    piece_tokens: int = 1024,
    batch_windows: int = BATCH_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and ``END_ID``. Full windows of a long document stand alone; what is left is cut into equal
    pieces of at most ``piece_tokens``. Each task balances the pieces of its own rows, ``batch_windows`` windows at a
    time, so nothing is shuffled, and a hot source or a large group of copies makes no task longer. Sequence ids are
    the task's number (high bits) and a running number. A null or empty text is the end id alone. Repeated rows are
    packed each for itself; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end = END_ID.to_bytes(4, "little")
        packer = _Packer(TaskContext.get().partitionId() << 33, capacity, piece_tokens, batch_windows)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                packer.add(doc_id, ids + end)
            yield packer.taken()
        packer.flush()
        yield packer.taken()

    return texts_of(df, id_col, text_col).mapInArrow(run, DDL)
