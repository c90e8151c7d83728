"""Simple-8b: numbers packed into 64-bit words, as many in a word as the widest of them allows.

The upper 4 bits of a word are its selector: 1 to 14 say that the lower 60 bits hold so many equally wide slots (60 of
one bit, … one of 60 bits), lowest slot first; 0 is an escape for a number of more than 60 bits, whose place in the list of
escapes is in the lower bits. Numbers are cut into blocks of ``BLOCK``; no word reaches over the end of a block, and the
number of each block's first word is kept, so that a block can be read without those before it. Slots behind the end of a
block are zero. Packing and unpacking work on whole arrays, of many lists at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

BLOCK = 2048
ESCAPE = 0
SLOTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // SLOTS
# Room behind each block in the working arrays, so that a word's slots never reach the next block.
PAD = int(SLOTS.max())
# For every number the narrowest selector's place among the widths from narrow to wide; len(WIDTHS) - 1 for an escape.
_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


@dataclass(frozen=True)
class Packed:
    """One list of numbers: how many, the first word of each block, the words, and the numbers beyond 60 bits."""

    count: int
    offsets: np.ndarray
    words: np.ndarray
    escapes: np.ndarray


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of blocks of each list, length of each block)."""
    per_list = -(-counts // BLOCK)
    lengths = np.full(int(per_list.sum()), BLOCK, np.int64)
    ends = np.cumsum(per_list)
    filled = counts > 0
    lengths[ends[filled] - 1] = counts[filled] - (per_list[filled] - 1) * BLOCK
    return per_list, lengths


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each block, place of each number) in an array with room behind each block."""
    begins = np.cumsum(lengths + PAD) - (lengths + PAD)
    firsts = np.cumsum(lengths) - lengths
    return begins, np.arange(int(lengths.sum())) + np.repeat(begins - firsts, lengths)


def _selectors(classes: np.ndarray) -> np.ndarray:
    """For every place the selector that takes most of the numbers from there on."""
    selectors = np.where(classes == len(_LIMITS), ESCAPE, len(SLOTS) - 1).astype(np.uint8)
    widest, length = classes, 1  # of the next ``length`` numbers
    for selector in range(len(SLOTS) - 2, 0, -1):
        n = int(SLOTS[selector])
        while 2 * length <= n:
            widest = np.maximum(widest[: len(widest) - length], widest[length:])
            length *= 2
        window = widest if n == length else np.maximum(widest[: len(widest) - (n - length)], widest[n - length :])
        fits = window <= selector - 1
        selectors[: len(fits)][fits] = selector
    return selectors


def pack(lists: Sequence[np.ndarray]) -> list[Packed]:
    """Pack lists of unsigned 64-bit numbers."""
    counts = np.array([len(x) for x in lists], np.int64)
    per_list, lengths = _blocks(counts)
    begins, places = _places(lengths)
    numbers = np.zeros(int((lengths + PAD).sum()), np.uint64)
    if len(places):
        numbers[places] = np.concatenate([np.asarray(x, np.uint64) for x in lists])
    small = len(numbers) == 0 or int(numbers.max()) < len(_SMALL)
    classes = _SMALL[numbers.astype(np.uint16)] if small else np.searchsorted(_LIMITS, numbers, side="right").astype(np.uint8)
    selectors = _selectors(classes)

    # Each word begins where the one before it ends: one step for a word of every block that has not ended.
    place, end, firsts = begins, begins + lengths, [np.zeros(0, np.int64)]
    while len(place):
        firsts.append(place)
        place = place + SLOTS[selectors[place]]
        left = place < end
        place, end = place[left], end[left]
    firsts = np.sort(np.concatenate(firsts))
    words_of = np.diff(np.append(np.searchsorted(firsts, begins), len(firsts)))
    chosen = selectors[firsts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in range(1, len(SLOTS)):
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            held = np.zeros(len(mine), np.uint64)
            for slot in range(int(SLOTS[selector])):
                held |= numbers[firsts[mine] + slot] << np.uint64(slot * int(WIDTHS[selector]))
            words[mine] |= held

    block_ends, word_ends = np.cumsum(per_list), np.append(0, np.cumsum(words_of))
    first_words = word_ends[block_ends - per_list]
    offsets = (word_ends[:-1] - np.repeat(first_words, per_list)).astype("<u4")
    escaped = np.flatnonzero(chosen == ESCAPE)
    escapes = numbers[firsts[escaped]].astype("<u8")
    escape_ends = np.searchsorted(escaped, word_ends[block_ends])
    escape_begins = np.searchsorted(escaped, first_words)
    words[escaped] = np.arange(len(escaped)) - np.repeat(escape_begins, escape_ends - escape_begins)  # selector 0
    spans = zip(counts.tolist(), (block_ends - per_list).tolist(), block_ends.tolist(), first_words.tolist(), word_ends[block_ends].tolist(), escape_begins.tolist(), escape_ends.tolist())
    words = words.astype("<u8")
    return [Packed(n, offsets[b0:b1], words[w0:w1], escapes[e0:e1]) for n, b0, b1, w0, w1, e0, e1 in spans]


def unpack(packed: Sequence[Packed]) -> list[np.ndarray]:
    """The numbers of each list."""
    counts = np.array([p.count for p in packed], np.int64)
    _, lengths = _blocks(counts)
    begins, places = _places(lengths)
    if not len(lengths):
        return [np.zeros(0, np.uint64) for _ in packed]
    words = np.concatenate([p.words for p in packed]).astype(np.uint64)
    sizes = [len(p.words) for p in packed]
    block_words = np.concatenate([np.diff(np.append(p.offsets.astype(np.int64), n)) for p, n in zip(packed, sizes)])
    selectors = (words >> np.uint64(60)).astype(np.int64)
    taken = SLOTS[selectors]
    before = np.cumsum(taken) - taken
    first_words = np.cumsum(block_words) - block_words
    starts = before + np.repeat(begins - before[first_words], block_words)
    numbers = np.zeros(int((lengths + PAD).sum()), np.uint64)
    for selector in range(1, len(SLOTS)):
        mine = np.flatnonzero(selectors == selector)
        if len(mine):
            held, to = words[mine], starts[mine]
            width = int(WIDTHS[selector])
            mask = np.uint64((1 << width) - 1)
            for slot in range(int(SLOTS[selector])):
                numbers[to + slot] = (held >> np.uint64(slot * width)) & mask
    escaped = np.flatnonzero(selectors == ESCAPE)
    if len(escaped):
        escape_begins = np.cumsum([len(p.escapes) for p in packed]) - [len(p.escapes) for p in packed]
        escapes = np.concatenate([p.escapes for p in packed]).astype(np.uint64)
        places_of = words[escaped].astype(np.int64) + np.repeat(escape_begins, sizes)[escaped]
        numbers[starts[escaped]] = escapes[places_of]
    flat = numbers[places]
    return np.split(flat, np.cumsum(counts)[:-1])


def unpack_block(packed: Packed, block: int) -> np.ndarray:
    """The numbers of one block, without reading the others' words."""
    last = block + 1 == len(packed.offsets)
    begin, end = int(packed.offsets[block]), len(packed.words) if last else int(packed.offsets[block + 1])
    count = packed.count - block * BLOCK if last else BLOCK
    return unpack([Packed(count, np.zeros(1, "<u4"), packed.words[begin:end], packed.escapes)])[0]
