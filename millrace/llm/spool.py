"""Records of one task that may outgrow its memory: kept in chunks, the full ones in a spill file."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator


def spill_dir() -> str | None:
    """Where Spark's own sorts and shuffles spill on this executor, or the default folder outside of a task."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)), None)


class Spool:
    """A list that is read from either end, of which at most ``chunk_bytes`` are in memory.

    What is beyond goes to a nameless file that belongs to the running task, as the spills of Spark's own sorts do: no
    other task reads it, a task that starts again writes its own, and it is gone when the task ends however it ends.
    """

    def __init__(self, chunk_bytes: int = 4 << 20):
        self.chunk_bytes = chunk_bytes
        self.file, self.places = None, []
        self.clear()

    def clear(self) -> None:
        self.rows, self.held, self.count = [], 0, 0
        if self.places:
            self.file.seek(0)
            self.file.truncate()
            self.places = []

    def add(self, row, size: int) -> None:
        """Append a row that takes about ``size`` bytes."""
        self.rows.append(row)
        self.count += 1
        self.held += size
        if self.held >= self.chunk_bytes:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=spill_dir())
            self.places.append(self.file.seek(0, os.SEEK_END))
            pickle.dump(self.rows, self.file, pickle.HIGHEST_PROTOCOL)
            self.rows, self.held = [], 0

    def _chunk(self, place: int) -> list:
        self.file.seek(place)
        return pickle.load(self.file)

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator:
        for place in list(self.places):
            yield from self._chunk(place)
        yield from self.rows

    def __reversed__(self) -> Iterator:
        yield from reversed(self.rows)
        for place in reversed(self.places):
            yield from reversed(self._chunk(place))
