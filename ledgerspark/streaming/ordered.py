"""Rows of one group in order, however many there are: what is beyond a bound waits as sorted runs in files of the task."""

from __future__ import annotations

import heapq
import itertools
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import IO, Any

#: Rows that are read back from a run at once, and runs that are made one of the next level.
BLOCK, FAN = 500, 32


def in_order(chunks: Iterable[list[tuple[Any, ...]]], key: Callable[[tuple[Any, ...]], Any], limit: int) -> Iterator[tuple[Any, ...]]:
    """Rows of all chunks by ``key``, those of equal keys as they came, with no more than about ``limit`` rows and a block of each run in memory."""
    levels: list[list[Iterator[tuple[Any, ...]]]] = [[]]
    held: list[tuple[Any, ...]] = []

    def add(rows: Iterable[tuple[Any, ...]], level: int) -> None:
        levels[level].append(_put_away(iter(rows)))
        if len(levels[level]) == FAN:
            full, levels[level] = levels[level], []
            if level + 1 == len(levels):
                levels.append([])
            add(heapq.merge(*full, key=key), level + 1)

    for chunk in chunks:
        held += chunk
        if len(held) >= limit:
            held.sort(key=key)
            add(held, 0)
            held = []
    held.sort(key=key)
    return heapq.merge(*itertools.chain.from_iterable(reversed(levels)), held, key=key)


def _put_away(rows: Iterator[tuple[Any, ...]]) -> Iterator[tuple[Any, ...]]:
    file = tempfile.TemporaryFile()
    while block := list(itertools.islice(rows, BLOCK)):
        pickle.dump(block, file)
    file.seek(0)
    return _read(file)


def _read(file: IO[bytes]) -> Iterator[tuple[Any, ...]]:
    with file:
        while True:
            try:
                block = pickle.load(file)
            except EOFError:
                return
            yield from block
