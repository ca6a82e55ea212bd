"""A worker's table of what a model says of each distinct word it has met.

Documents repeat their words, so a model of words is asked once per word and worker. The
table is bounded: when it is full it is emptied and filled anew, which changes the work,
not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from lectern.llm.caches import claim

KEPT = 400_000
#: Bytes of the table's words, their places and their rows, about.
KEPT_BYTES = 96 << 20
WORD_BYTES = 130


class WordTable:
    def __init__(self, answer: Callable[[list[str]], np.ndarray], kept: int = KEPT, kept_bytes: int = KEPT_BYTES):
        """``answer`` gives a row of numbers per word."""
        self.answer, self.kept, self.kept_bytes = answer, kept, kept_bytes
        self.size = 0
        self.places: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def of(self, docs: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """For each document the rows of its words, in order."""
        places = self.places
        fresh = {w for words in docs for w in words if w not in places}
        if fresh:
            row = 0 if self.rows is None else self.rows[:1].nbytes
            if len(places) + len(fresh) > self.kept or self.size + sum(WORD_BYTES + row + len(w) for w in fresh) > self.kept_bytes:
                places.clear()
                self.rows, self.size = None, 0
                fresh = {w for words in docs for w in words}
            new = sorted(fresh)
            found = self.answer(new)
            self.size += sum(WORD_BYTES + found[:1].nbytes + len(w) for w in new)
            start = 0 if self.rows is None else len(places)
            if self.rows is None:
                self.rows = found
            else:
                if start + len(found) > len(self.rows):
                    grown = np.empty((max(start + len(found), 2 * len(self.rows)), found.shape[1]), found.dtype)
                    grown[:start] = self.rows[:start]
                    self.rows = grown
                self.rows[start:start + len(found)] = found
            places.update(zip(new, range(start, start + len(new))))
        rows = self.rows
        empty = np.empty(0, np.int64)
        return [rows[np.fromiter(map(places.__getitem__, words), np.int64, len(words))] if len(words)
                else (rows[empty] if rows is not None else np.empty((0, 0))) for words in docs]


_tables: dict[str, WordTable] = {}


def table_for(key: str, answer: Callable[[list[str]], np.ndarray]) -> WordTable:
    """The worker's table for the model named by ``key``; another model's table is dropped."""
    claim("words", _tables.clear)
    if key not in _tables:
        _tables.clear()
        _tables[key] = WordTable(answer)
    return _tables[key]
