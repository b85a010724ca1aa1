"""Shared plumbing of the operators that work on one document at a time inside ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: How pyarrow names the column types that the operators return.
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(),
}


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text as ``id`` and ``text``; every other column, however named, is left behind."""
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Apply a row function inside Arrow batches.

    ``make()`` runs once per task and returns the function of a row's values; the function returns the rows
    that replace it. Rows are handed on in batches of a bounded number of bytes of input, so a task holds
    one batch, never its partition.
    """
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    out = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in bounded(batch):
                rows = [r for values in zip(*[c.to_pylist() for c in part.columns], strict=True) for r in f(*values)]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``most`` bytes; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def broadcast_if_small(df: DataFrame, most: int = 400_000) -> DataFrame:
    """A stored table of narrow rows, with a broadcast hint where it has at most ``most`` rows (about 10 MB); else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of an operator's own beside ``columns``: the wanted ones, underlined where they are taken."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


class WordCache(dict):
    """What ``make`` gives for a word, kept for the words met lately.

    Two generations of at most ``most`` words: when the younger is full it becomes the older, so frequent
    words stay and memory is bounded however many words the data hold.
    """

    LONGEST = 64

    def __init__(self, make: Callable[[str], object], most: int = 250_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) > self.LONGEST:
            return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found
