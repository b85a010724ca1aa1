"""Benchmark decontamination by suffix arrays of the training texts.

Each task holds a shard of the training texts as numbers of the benchmark's words and sorts the suffixes of that shard: a
suffix array. Every suffix of the benchmark is looked up in it by binary search, which gives its longest verbatim match and
where it lies. Suffixes that begin with a word the benchmark hasn't, or that meet one before the shortest match that counts,
can't match and are left out of the array. A shard is bounded in size, so a task holds one shard, never its partition, and
nothing is shuffled; the benchmark travels with the tasks in pieces of a bounded size, one pass over the texts for each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilume.llm.arrow_rows import bounded, texts_of

#: Runs of digits, lower-case letters and everything beyond ASCII, as UTF-8 bytes.
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return text.encode().lower()


@dataclass(frozen=True)
class Windows:
    """A piece of the benchmark: its words, and its windows as rows of word numbers, padded with 0."""

    items: tuple
    words: tuple[bytes, ...]
    rows: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray
    width: int


def windows_of(items: list[tuple[object, bytes]], width: int) -> Windows:
    """Windows of ``width`` consecutive words of each item; an item of fewer words, but not none, is one window."""
    found: dict[bytes, int] = {}
    rows, lengths, owner = [], [], []
    for k, (_, text) in enumerate(items):
        numbers = [found.setdefault(w, len(found) + 1) for w in WORD.findall(text)]
        for at in range(max(len(numbers) - width + 1, min(len(numbers), 1))):
            part = numbers[at : at + width]
            rows.append(part + [0] * (width - len(part)))
            lengths.append(len(part))
            owner.append(k)
    shape = np.array(rows, np.uint32).reshape(-1, width)
    return Windows(tuple(i for i, _ in items), tuple(found), shape, np.array(lengths, np.int64), np.array(owner, np.int64), width)


class Lookup:
    """Turns texts into numbers of benchmark words; built once for each task."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.powers = np.ones(1, np.uint64)
        hashes, _ = self.hashes(np.frombuffer(b" ".join(windows.words) + b" ", np.uint8))
        order = np.argsort(hashes, kind="stable")
        self.sorted, self.number = hashes[order], (order + 1).astype(np.uint32)
        self.keys = self._keys(windows.rows)

    def hashes(self, raw: np.ndarray, block: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit number for each word, equal for equal words, and where words begin; worked out block by block."""
        out, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while at < len(raw):
            stop = min(at + block, len(raw))
            while stop < len(raw) and WORD_BYTES[raw[stop]]:  # don't cut a word
                stop += 1
            inside = WORD_BYTES[raw[at:stop]]
            edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if len(starts):
                self._lengthen(int((ends - starts).max()))
                position = np.flatnonzero(inside)
                place = position - np.repeat(starts, ends - starts)
                # bytes are mixed first, so that sums of neighbouring letters don't cancel
                mixed = (raw[at:stop][position].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
                mixed *= self.powers[place]
                sums = np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
                sums ^= sums >> np.uint64(32)
                out.append(sums * np.uint64(0x94D049BB133111EB))
                begins.append(starts + at)
            at = stop
        return np.concatenate(out), np.concatenate(begins)

    def _lengthen(self, n: int) -> None:
        if n > len(self.powers):
            steps = np.full(1 << n.bit_length(), 0x9E3779B97F4A7C15, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)

    def numbers(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the text its number in the benchmark, 0 if it has none; and where words begin."""
        hashes, begins = self.hashes(raw)
        if not len(self.sorted):
            return np.zeros(len(begins), np.uint32), begins
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.number[at], 0).astype(np.uint32), begins

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        """Rows of numbers as byte strings in the same order; trailing zeros are as good as absent."""
        if not len(rows):
            return np.zeros(0, f"S{4 * max(rows.shape[1], 1)}")
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()

    def matches(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence of a window: binary search in the shard's suffix array."""
        w = self.windows
        if not len(w.lengths) or not len(numbers):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # how many known words follow from each position on
        unknown = np.flatnonzero(np.append(numbers == 0, True))
        run = unknown[np.searchsorted(unknown, np.arange(len(numbers)))] - np.arange(len(numbers))
        suffixes = np.flatnonzero(run >= w.lengths.min())
        if not len(suffixes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.concatenate([numbers, np.zeros(w.width, np.uint32)])
        rows = padded[suffixes[:, None] + np.arange(w.width)]
        rows[np.arange(w.width) >= run[suffixes][:, None]] = 0  # what follows an unknown word can't match
        keys = self._keys(rows)
        order = np.argsort(keys, kind="stable")
        array, keys = suffixes[order], keys[order]
        low = np.searchsorted(keys, self.keys, "left")
        upper = w.rows.copy()
        upper[np.arange(w.width) >= w.lengths[:, None]] = 0xFFFFFFFF
        high = np.searchsorted(keys, self._keys(upper), "right")
        count = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(count)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return window, array[low[window] + inner]


def _shards(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Hit:
    """Of one text: its number of words, which of them are hit, and the items that occur in it."""

    n_words: int
    hit: np.ndarray
    items: set
    spans: list[tuple[int, int]]


def search(texts: list[bytes], lookup: Lookup, most: int = 2 << 20) -> Iterator[Hit]:
    """Look the windows up in lower-cased texts; texts are searched in shards of about ``most`` bytes."""
    w = lookup.windows
    for start, stop in _shards(texts, most):
        shard = texts[start:stop]
        joined = b" ".join(shard) + b" "
        numbers, begins = lookup.numbers(np.frombuffer(joined, np.uint8))
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in shard])])
        first = np.searchsorted(begins, offsets)  # of each text its first word
        # a number of its own between texts: no match crosses from one into the next
        spaced = np.insert(numbers, first[1:], 0)
        window, at = lookup.matches(spaced)
        text_of = np.searchsorted(first + np.arange(len(first)), at, "right") - 1
        at = at - text_of  # without the separators
        cover = np.zeros(len(numbers) + 1, np.int64)
        keep = np.ones(len(at), bool)
        for m, (k, p) in enumerate(zip(window.tolist(), at.tolist(), strict=True)):
            # numbers stand for words by hash: compare the words themselves
            n = w.lengths[k]
            last = begins[p + n] if p + n < len(begins) else len(joined)
            keep[m] = WORD.findall(joined[begins[p] : last])[:n] == [w.words[x - 1] for x in w.rows[k, :n]]
        window, at, text_of = window[keep], at[keep], text_of[keep]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + w.lengths[window], -1)
        hit = np.cumsum(cover)[:-1] > 0
        items: dict[int, set] = {}
        for t, k in zip(text_of.tolist(), window.tolist(), strict=True):
            items.setdefault(t, set()).add(w.items[w.owner[k]])
        for t in range(len(shard)):
            part = hit[first[t] : first[t + 1]]
            edge = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0, append=0))
            yield Hit(len(part), part, items.get(t, set()), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))


def pieces_of(benchmark: DataFrame, width: int, most: int, id_col: str, text_col: str) -> Iterator[Windows]:
    """The benchmark in pieces of at most about ``most`` bytes of text, fetched one after the other."""
    rows = texts_of(benchmark, id_col, text_col).where("text is not null").orderBy("id", "text").toLocalIterator()
    piece, size = [], 0
    for i, text in rows:
        raw = lowered(text)
        if piece and size + len(raw) > most:
            yield windows_of(piece, width)
            piece, size = [], 0
        piece.append((i, raw))
        size += len(raw)
    yield windows_of(piece, width)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, piece_bytes: int = 16 << 20, id_col: str = "doc_id",
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans).

    ``spans``: where hit words lie, as first:end in words, comma-joined. A NULL text has no words and is not contaminated;
    NULL item texts match nothing, an item without an id hits words but is not
    listed, and items with equal ids count once. Repeated rows are each searched; an empty benchmark
    contaminates nothing; other columns are left behind.
    """
    found = texts_of(docs, id_col, text_col).select(
        "id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<long>").alias("edges"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    for piece in pieces_of(benchmark, width, piece_bytes, item_id, item_text):
        found = _search_piece(found, piece)

    def digest(batches):
        for batch in batches:
            out = []
            for i, n, edges, items in zip(*[batch.column(c).to_pylist() for c in ("id", "n_words", "edges", "items")], strict=True):
                spans = list(zip(edges[::2], edges[1::2], strict=True)) if edges else []
                ids = sorted(set(items or []))
                n_hit = sum(b - a for a, b in spans)
                sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
                out.append((i, n, n_hit, len(ids), sha, n_hit > 0, ",".join(f"{a}:{b}" for a, b in spans)))
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    return found.drop("text").mapInArrow(digest, schema)


def _search_piece(found: DataFrame, piece: Windows) -> DataFrame:
    """One pass over the texts: adds what this piece of the benchmark hits to what earlier pieces did."""

    def run(batches):
        lookup = Lookup(piece)
        for batch in batches:
            for part in bounded(batch, 4 << 20):
                texts = part.column("text").to_pylist()
                n_words, edges, items = [], [], []
                before = zip(part.column("edges").to_pylist(), part.column("items").to_pylist(), strict=True)
                for hit, (old, held) in zip(search([lowered(t or "") for t in texts], lookup), before, strict=True):
                    mask = hit.hit
                    if old:
                        mask = mask.copy()
                        for a, b in zip(old[::2], old[1::2], strict=True):
                            mask[a:b] = True
                    n_words.append(hit.n_words)
                    edges.append(np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist())
                    items.append(sorted({*(held or []), *(str(x) for x in hit.items if x is not None)}))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text"), pa.array(n_words, pa.int64()), pa.array(edges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    ["id", "text", "n_words", "edges", "items"],
                )

    return found.mapInArrow(run, found.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, piece_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the benchmark occurs."""
    for piece in pieces_of(benchmark, width, piece_bytes, "item_id", "text"):

        def run(batches, piece=piece):
            lookup = Lookup(piece)
            for batch in batches:
                for part in bounded(batch, 4 << 20):
                    texts = [lowered(t or "") for t in part.column(text_col).to_pylist()]
                    yield part.filter(pa.array([not h.spans for h in search(texts, lookup)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
