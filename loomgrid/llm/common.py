"""What the corpus operators share: names that don't clash, and workers' caches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..storage import Scratch, delete_table, lean_batches, materialize, meet, shared_dir, small, table

__all__ = ["SMALL_CACHE_BYTES", "Scratch", "WordCache", "delete_table", "fresh", "lean_batches", "materialize", "meet", "shared_dir", "small", "table"]

#: Bytes that either generation of a worker's cache may hold, and what an entry costs besides its text and value.
CACHE_BYTES, ENTRY_BYTES = 52 << 20, 170
#: The same, for caches that save little.
SMALL_CACHE_BYTES = 12 << 20


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class WordCache(dict):
    """word -> value of ``make(word)``. ``trim``, called between documents, starts a new generation once this one's
    bytes are spent; words asked for again move over from the last one, so frequent words stay and memory is bounded.
    A worker holds one cache at a time: ``take``, called for each batch, empties the one that another operator has
    left. ``size``: bytes of a word and its value, if these are more than the word's length."""

    taken: WordCache | None = None

    def __init__(self, make, limit: int = CACHE_BYTES, size=None):
        super().__init__()
        self.make, self.limit, self.size, self.last, self.held = make, limit, size, {}, 0

    def __missing__(self, word):
        value = self.last.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        self.held += ENTRY_BYTES + (len(word) if self.size is None else self.size(word, value))
        return value

    def add(self, word, value) -> None:
        self[word] = value
        self.held += ENTRY_BYTES + (len(word) if self.size is None else self.size(word, value))

    def take(self) -> WordCache:
        if WordCache.taken is not self:
            WordCache.release()
        WordCache.taken = self
        return self

    @staticmethod
    def release() -> None:
        """Empty the cache that this worker holds."""
        if WordCache.taken is not None:
            WordCache.taken.trim(0)
            WordCache.taken.last = {}
            WordCache.taken = None

    def trim(self, limit: int | None = None) -> None:
        if self.held > (self.limit if limit is None else limit):
            self.last = dict(self)
            self.clear()
            self.held = 0
