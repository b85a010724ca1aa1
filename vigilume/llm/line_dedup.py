"""Removal of repeated runs of lines by winnowing.

Lines are hashed, and every line starts a gram: the shortest run of lines from it on that has ``noise`` characters. Winnowing looks
at windows of consecutive grams, each as long as it takes to have ``window`` characters, and selects the gram with the least hash in
each, the last of several. A line of at least ``noise`` and ``window`` characters is a gram and a window of its own, so it is always
selected and meets its repeats whatever stands beside it. Shorter lines need neighbours: two texts that share a run of at least
``noise`` + ``window`` characters (and the rest of the line it ends in) share a selected gram.

Fingerprints are joined with the first place where they occur, in the order of ids and lines, and matches are extended line by line
both ways as far as the two places agree, up to where the next window's fingerprint takes over. Lines so covered are later repeats
and go. A line is removed only if the same line stands earlier, so its first occurrence stays wherever it is.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vigilume.llm.arrow_rows import bounded, free_names
from vigilume.session import stored

SPACES = re.compile(r"\s+")


@dataclass(frozen=True)
class Winnow:
    """``noise``: characters a repeat must have to count. ``window``: characters between fingerprints at most.

    Sixteen characters are about three words: from there on equal lines are copied rather than met by chance, while shorter ones
    (brackets, numbers, "Yes.", single words) recur in texts of their own and go only with the lines beside them.
    """

    noise: int = 16
    window: int = 16


def line_hashes(lines: list[str]) -> tuple[list[int], list[int]]:
    """(hash, weight) of each line; white space is one space, and none at the ends. Weight: the characters left."""
    plain = [SPACES.sub(" ", line).strip() for line in lines]
    return [xxhash.xxh3_64_intdigest(p.encode()) for p in plain], [len(p) for p in plain]


def grams(hashes: list[int], weights: list[int], noise: int) -> list[tuple[bytes, int]]:
    """For each line the gram that starts there, (hash, end), as long as the lines left have enough characters."""
    out, end, size = [], 0, 0
    for start in range(len(hashes)):
        if end < start:
            end, size = start, 0
        while end < len(hashes) and size < noise:
            size += weights[end]
            end += 1
        if size < noise:
            break
        out.append((xxhash.xxh3_128_digest(struct.pack(f"<{end - start}Q", *hashes[start:end])), end))
        size -= weights[start]
    return out


def fingerprints(hashes: list[int], weights: list[int], rule: Winnow) -> list[tuple[bytes, int, int]]:
    """(hash, start, end) of the selected grams, by start. Lines without characters start none."""
    found = [(h, start, end) for start, (h, end) in enumerate(grams(hashes, weights, rule.noise)) if weights[start]]
    chosen = set()
    stop, size = 0, 0
    for first in range(len(found)):
        # the grams that start within ``window`` characters from this one on
        while stop < len(found) and (stop == first or size < rule.window):
            size += weights[found[stop][1]]
            stop += 1
        chosen.add(min(range(first, stop), key=lambda k: (found[k][0], -k)))
        if stop == len(found) and size < rule.window:
            break  # the last window; later ones are parts of it
        size -= weights[found[first][1]]
    return [found[k] for k in sorted(chosen)]


def around(hashes: list[int], weights: list[int], start: int, end: int, rule: Winnow) -> tuple[list[int], list[int]]:
    """Hashes of the lines before and after a fingerprint, nearest first, up to where another one must have taken over."""
    most = 2 * (rule.noise + rule.window)
    before, size, k = [], 0, start - 1
    while k >= 0 and size < most:
        before.append(hashes[k])
        size += weights[k]
        k -= 1
    after, size, k = [], 0, end
    while k < len(hashes) and size < most:
        after.append(hashes[k])
        size += weights[k]
        k += 1
    return before, after


def _packed(values: list[int]) -> bytes:
    return struct.pack(f"<{len(values)}Q", *values)


def _agree(a: bytes, b: bytes) -> int:
    """How many 8-byte hashes two strings have in common from their beginning on."""
    n = 0
    while 8 * n + 8 <= min(len(a), len(b)) and a[8 * n : 8 * n + 8] == b[8 * n : 8 * n + 8]:
        n += 1
    return n


def _place(doc_id: int | None, text_hash: int, line: int) -> bytes:
    """Where a line stands, as bytes in the order of first occurrence: id (NULL last), hash of the text, line."""
    return struct.pack(">?QqI", doc_id is None, (doc_id or 0) + (1 << 63), text_hash, line)


def _placed(place: bytes) -> tuple[int | None, int, int]:
    null, number, text_hash, line = struct.unpack(">?QqI", place)
    return None if null else number - (1 << 63), text_hash, line


def mark_fingerprints(docs: DataFrame, rule: Winnow, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(print, place, last, before, after): each fingerprint, where it begins and ends, and the lines around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["print", "place", "last", "before", "after"]
        types = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for part in bounded(batch, 4 << 20):
                out = []
                for i, h, text in zip(*[part.column(c).to_pylist() for c in ("id", "h", "text")], strict=True):
                    hashes, weights = line_hashes(text.split("\n"))
                    for mark, start, end in fingerprints(hashes, weights, rule):
                        before, after = around(hashes, weights, start, end, rule)
                        out.append((mark, _place(i, h, start), end, _packed(before), _packed(after)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    text = F.col(text_col)
    rows = docs.where(F.length(text) > 0).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(run, "print binary, place binary, last long, before binary, after binary")


def repeated_lines(marks: DataFrame) -> DataFrame:
    """(of, h, runs): of each document, given by id and hash of its text, the runs of lines that repeat earlier ones.

    ``marks``: fingerprints, stored. Of all places of a fingerprint only the first is kept, and every other one meets that one alone;
    the first ones are stored, so that the join can split a fingerprint that very many documents share.
    """
    place = F.struct("place", "before", "after")
    firsts = stored(
        marks.groupBy("print").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("print", F.col("first.place").alias("place0"), F.col("first.before").alias("before0"), F.col("first.after").alias("after0")),
        "first-prints",
    )
    pairs = marks.join(firsts, "print").where("place > place0")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("place", "last", "before", "after", "before0", "after0")]
            for place, last, before, after, before0, after0 in zip(*columns, strict=True):
                i, h, start = _placed(place)
                out.append((i, h, start - _agree(before, before0), last + _agree(after, after0)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["of", "h", "begin", "end"])

    runs = pairs.mapInArrow(extend, "of long, h long, begin long, end long")
    # bounded by the lines of one document; rows with equal id and text agree
    return runs.groupBy("of", "h").agg(F.collect_set(F.struct("begin", "end")).alias("runs"))


def remaining(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """The text without the lines of the runs, its number of lines before, and how many went."""
    lines = text.split("\n")
    gone = {k for r in runs for k in range(r["begin"], min(r["end"], len(lines)))}
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), len(lines), len(gone)


def dedup_lines(docs: DataFrame, rule: Winnow = Winnow(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, text, n_lines, n_removed), the text without later repeats of runs of lines.

    The first occurrence is the one with the least (id, hash of the text, line), NULL ids last; rows with equal id and text are one
    document, and each gets its result. A NULL text stays NULL and an empty one empty, with 0 lines; a text all of whose lines go
    becomes empty. Other columns are left behind.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    runs = repeated_lines(stored(mark_fingerprints(rows, rule), "fingerprints"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("h"))
    return rows.join(runs, same, "left").select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, text string, n_lines long, n_removed long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        out = []
        for i, text, runs in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")], strict=True):
            out.append((i, *remaining(text, runs)) if runs else (i, text, text.count("\n") + 1 if text else 0, 0))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "text", "n_lines", "n_removed"])


def keep_first_lines(docs: DataFrame, rule: Winnow = Winnow(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns and the texts that ``dedup_lines`` leaves; documents that lose their last character are dropped.

    A column ``n_chars``, where there is one, follows the text.
    """
    columns, schema = docs.columns, docs.schema
    of, text_hash, own = free_names(columns, "of", "text_hash", "runs")
    runs = repeated_lines(stored(mark_fingerprints(docs, rule, id_col, text_col), "fingerprints")).toDF(of, text_hash, own)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(text_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 4 << 20):
                texts, found = part.column(text_col).to_pylist(), part.column(own).to_pylist()
                after = [remaining(t, runs)[0] if runs else t for t, runs in zip(texts, found, strict=True)]
                keep = pa.array([not runs or bool(t.strip()) for t, runs in zip(after, found, strict=True)], pa.bool_())
                new = {text_col: pa.array(after, part.schema.field(text_col).type)}
                if "n_chars" in columns:
                    counts = [len(t) if runs else n for t, runs, n in zip(after, found, part.column("n_chars").to_pylist(), strict=True)]
                    new["n_chars"] = pa.array(counts, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in columns], columns).filter(keep)

    return docs.join(runs, same, "left").select(*columns, own).mapInArrow(run, schema)
