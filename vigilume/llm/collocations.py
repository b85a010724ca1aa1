"""Collocations by an FM-index of each shard of the corpus.

A shard is a bounded stretch of texts of one language. Its words become numbers, and words that the whole corpus has too seldom
for any phrase become separators, as ends of pieces do. The Burrows-Wheeler transform of that sequence is all that is kept of
it. Its LF mapping extends the intervals of all phrases of a depth by one word to the left in one sweep; as an interval lies within the
one of its phrase without the last word, the same sweep tells what that one is extended by to the right. Both extensions have to be
frequent, or the longer phrase can't be.

Phrases grow by one word a round. The sizes of the intervals are their counts; these are summed over the shards, and the next round
extends only the intervals of phrases that are frequent in the whole corpus. All sums are exact; shards only ever leave out
what can't reach the least count. Phrases of three words are first counted in hashed buckets, a fixed number; those in a
bucket that all of them together don't fill to the least count aren't sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from vigilume.functions.ordering import ranked
from vigilume.session import stored

#: Lower-cases A-Z, makes tabs spaces and ends of pieces line feeds; other bytes stay.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
#: Rows in a batch that goes back to Spark.
ROWS = 65_536
#: Buckets in which phrases are counted by hash, and the parts in which a task sends its counts.
BUCKETS, PARTS = 1 << 20, 64


@dataclass(frozen=True)
class Phrases:
    """``least``: occurrences of a phrase; ``longest``: words in it; ``top``: phrases of a language in the report; ``closed``: a
    phrase goes when a longer one that holds it has so many percent of its occurrences. ``shard``: bytes of text in a shard.
    ``sent``: frequent words, and frequent pairs, that every task gets at most (about 32 MB each); if there are more, each shard gets
    its own by a join."""

    least: int = 100
    longest: int = 5
    top: int = 2000
    closed: int = 100
    shard: int = 8 << 20
    sent: int = 2_000_000


# --- shards ------------------------------------------------------------------------------------


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def words_and_sequence(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, how often each occurs, and the texts as numbers of words, -1 between pieces."""
    plain = b"\n".join(t.encode().translate(PLAIN) for t in texts).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([plain], pa.large_binary()).cast(pa.large_string(), safe=False), " ").flatten()
    coded = tokens.dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    names = words.to_pylist()
    # numbers of words only, empty tokens dropped
    number = np.full(len(names), -1, np.int64)
    real = np.array([name not in ("", "\n") for name in names], bool)
    number[real] = np.arange(real.sum())
    blank = np.array([name == "" for name in names], bool)
    sequence = number[at[~blank[at]]]
    counts = np.bincount(sequence[sequence >= 0], minlength=int(real.sum()))
    return words.filter(pa.array(real)).cast(pa.string()), counts, sequence.astype(np.int32)


def shards_of(docs: DataFrame, size: int) -> DataFrame:
    """(shard, lang, words, counts, sequence): of each task's texts of a language, every ``size`` bytes or so a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def row(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            sizes.pop(lang)
            words, counts, sequence = words_and_sequence(held.pop(lang))
            listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + made - 1], pa.int64()), pa.array([lang]), listed(words),
                    listed(pa.array(counts, pa.int64())), pa.array([packed(sequence)], pa.binary()),
                ],
                names=["shard", "lang", "words", "counts", "sequence"],
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= size:
                    yield row(lang)
                elif sum(sizes.values()) >= 2 * size:
                    yield row(max(sizes, key=sizes.get))
        for lang in list(held):
            yield row(lang)

    return docs.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, sequence binary")


# --- the index of a shard ----------------------------------------------------------------------


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of symbols in order, read up to the next separator (0), which come by place."""
    n = len(symbols)
    at = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(at)
    rank[at] = np.arange(len(at))
    step = 1
    while True:
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        changes = np.diff(key[order], prepend=key[order[:1]] - 1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(changes) - 1
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


@dataclass
class Index:
    """``first``: the word with which a row's suffix begins, ``before``: the word in front of it (the transform), 0: a separator;
    words as numbers of the shard from 1 on. ``to_left``: the row of the suffix one word longer; ``to_right``: its inverse."""

    before: np.ndarray
    first: np.ndarray
    to_left: np.ndarray
    to_right: np.ndarray

    @classmethod
    def of_transform(cls, before: np.ndarray) -> Index:
        to_right = np.argsort(before, kind="stable")
        to_left = np.empty(len(before), np.int64)
        to_left[to_right] = np.arange(len(before))
        return cls(before, before[to_right], to_left, to_right)

    def left(self, rows: np.ndarray, same: np.ndarray, valid: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Extend all intervals of a depth by the word before.

        ``same``: an interval's number for each row; ``rows``: the rows to extend. The longer phrase's interval lies in the one
        of ``outer`` (its phrase without the last word, also numbers), where that is ``valid``. Returns (interval starts, sizes,
        number of the new interval for each row, -1 for rows in none).
        """
        rows = rows[self.before[rows] > 0]
        to = self.to_left[rows]
        kept = valid[to]
        rows, to = rows[kept], to[kept]
        order = np.argsort(to)
        rows, to = rows[order], to[order]
        new = np.full(len(self.before), -1, np.int64)
        if not len(to):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), new
        begins = np.append(True, (np.diff(to) != 1) | (np.diff(same[rows]) != 0) | (np.diff(outer[to]) != 0))
        starts = np.flatnonzero(begins)
        new[to] = np.cumsum(begins) - 1
        return to[starts], np.diff(np.append(starts, len(to))), new

    def words(self, rows: np.ndarray, length: int) -> list[np.ndarray]:
        """The first words of the rows' suffixes."""
        out = []
        for _ in range(length):
            out.append(self.first[rows])
            rows = self.to_right[rows]
        return out


def transform(symbols: np.ndarray) -> np.ndarray:
    """The word before each suffix, suffixes in order; the sequence begins with a separator and is read as a circle."""
    return symbols[suffix_order(symbols) - 1]


def pairs_of(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Interval starts and sizes of all phrases of two words."""
    rows = np.flatnonzero(index.first > 0)
    starts, sizes, _ = index.left(rows, index.first, index.first > 0, index.first)
    return starts, sizes


def longer_of(index: Index, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval starts and sizes of the phrases of one word more whose parts without the first and without the last word are both
    among the given intervals, which are of phrases of one length."""
    same = np.full(len(index.before), -1, np.int64)
    rows = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    same[rows] = np.repeat(np.arange(len(starts)), sizes)
    at, n, _ = index.left(rows, same, same >= 0, same)
    return at, n


def runs_of_words(sequence: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The sequence with global numbers of words, 0 for what has none; runs of one word go, and a run of zeros is one."""
    known = np.where(sequence >= 0, numbers[np.maximum(sequence, 0)], 0) if len(numbers) else np.zeros(len(sequence), np.int64)
    some = known > 0
    beside = np.append(some[1:], False) | np.append(False, some[:-1])
    kept = np.where(some & beside, known, 0) if len(known) else known
    kept = np.append(0, kept)
    return kept[(kept > 0) | np.append(True, kept[:-1] > 0)]


# --- counts over all shards --------------------------------------------------------------------


def indexed(shards: DataFrame, words: DataFrame, sent: int) -> DataFrame:
    """(shard, alphabet, before): the index of each shard; ``words`` has (lang, word, id), the words that count."""
    schema = "shard long, alphabet binary, before binary"

    def index_row(shard: int, data: bytes, numbers: np.ndarray) -> pa.RecordBatch:
        known = runs_of_words(unpacked(data, np.int32), numbers)
        alphabet, symbols = np.unique(known, return_inverse=True)
        before = transform(symbols.astype(np.int32))
        return _rows(schema, 1, shard=shard, alphabet=packed(alphabet), before=packed(before.astype(np.int32)))

    known = words.limit(sent + 1).collect()
    if len(known) <= sent:
        langs = {lang: ([], []) for lang in {r.lang for r in known}}
        for r in known:
            langs[r.lang][0].append(r.word)
            langs[r.lang][1].append(r.id)
        table = shards.sparkSession.sparkContext.broadcast({k: (pa.array(w, pa.string()), np.array(i, np.int64)) for k, (w, i) in langs.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own = batch.column(2)[k].values
                    names, ids = table.value.get(batch.column(1)[k].as_py(), (pa.array([], pa.string()), np.zeros(0, np.int64)))
                    at = pc.index_in(own, value_set=names)
                    numbers = np.zeros(len(own), np.int64)
                    among = at.is_valid().to_numpy(zero_copy_only=False)
                    numbers[among] = ids[at.drop_null().to_numpy()]
                    if among.any():
                        yield index_row(batch.column(0)[k].as_py(), batch.column(3)[k].as_py(), numbers)

        return shards.select("shard", "lang", "words", "sequence").mapInArrow(run, schema)

    # a shard's vocabulary is joined with them, not the texts
    local = shards.select("shard", "lang", F.posexplode("words").alias("at", "word")).join(words, ["lang", "word"])
    numbered = local.groupBy("shard").agg(F.collect_list("at").alias("ats"), F.collect_list("id").alias("ids"))
    both = shards.select("shard", F.size("words").alias("n"), "sequence").join(numbered, "shard").select("shard", "n", "sequence", "ats", "ids")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, n, data, ats, ids = (batch.column(c)[k] for c in range(5))
                numbers = np.zeros(n.as_py(), np.int64)
                numbers[ats.values.to_numpy()] = ids.values.to_numpy()
                yield index_row(shard.as_py(), data.as_py(), numbers)

    return both.mapInArrow(run_joined, schema)


def bucket_of(words: list[np.ndarray]) -> np.ndarray:
    """One of ``BUCKETS`` for each phrase (a column for each word)."""
    key = np.zeros(len(words[0]), np.uint64)
    for w in words:
        key = (key ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key % np.uint64(BUCKETS)).astype(np.int64)


def full_buckets(counted: DataFrame, least: int) -> np.ndarray:
    """Which buckets hold ``least`` occurrences, from (part, counts): parts of the tasks' tables, summed part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = unpacked(data, np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            yield _rows("part long, full binary", 1, part=part, full=np.packbits(counts >= least).tobytes())

    full = np.zeros(BUCKETS, bool)
    width = BUCKETS // PARTS
    # one bit for each bucket, a fixed number
    for part, bits in counted.repartition("part").mapInArrow(run, "part long, full binary").collect():
        full[part * width : (part + 1) * width] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return full


def intervals(
    index: DataFrame, length: int, tables: list, held: DataFrame | None = None, placed: bool = False, full: Broadcast | None = None, buckets: bool = False
) -> DataFrame:
    """(w1, ..., n): counts of phrases of ``length`` words, all parts of which are frequent, in parts to be summed; with
    ``placed`` each shard's intervals, (shard, w1, ..., start, n).

    Frequent phrases of fewer words are known to every task (``tables``: broadcast arrays, one for each length from 2 on), or
    ``held`` has the intervals of those of one word less by shard. With ``buckets`` the counts are those of hashed buckets,
    (part, counts); phrases in buckets that aren't ``full`` are left out, as such a phrase can't be frequent.
    """
    names = [f"w{i + 1}" for i in range(length)]
    schema = ", ".join(f"{c} long" for c in (["shard", *names, "start", "n"] if placed else [*names, "n"]))
    joined = held is not None
    if buckets:
        schema = "part long, counts binary"

    def of_shard(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        alphabet, own = unpacked(batch.column(1)[k].as_py(), np.int64), Index.of_transform(unpacked(batch.column(2)[k].as_py(), np.int32))
        if joined:
            starts, sizes = longer_of(own, *(batch.column(c)[k].values.to_numpy() for c in (3, 4)))
        else:
            starts, sizes = pairs_of(own)
            for at, table in enumerate(tables, 2):
                kept = among([alphabet[w] for w in own.words(starts, at)], table.value, alphabet)
                starts, sizes = longer_of(own, starts[kept], sizes[kept])
        words = [alphabet[w] for w in own.words(starts, length)]
        if full is not None:
            kept = full.value[bucket_of(words)]
            starts, sizes, words = starts[kept], sizes[kept], [w[kept] for w in words]
        return starts, sizes, words

    def rows(words: list[np.ndarray], **more: object) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(words[0]), ROWS):
            part = slice(i, i + ROWS)
            cut = {c: v[part] if isinstance(v, np.ndarray) else v for c, v in more.items()}
            yield _rows(schema, len(words[0][part]), **cut, **{c: w[part] for c, w in zip(names, words)})

    def tables_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                _, sizes, words = of_shard(batch, k)
                np.add.at(counts, bucket_of(words), sizes)
        for part, some in enumerate(np.split(counts, PARTS)):
            if some.any():
                yield _rows(schema, 1, part=part, counts=packed(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = []
            for k in range(batch.num_rows):
                starts, sizes, words = of_shard(batch, k)
                if placed:
                    yield from rows(words, shard=batch.column(0)[k].as_py(), start=starts, n=sizes)
                elif length == 2:
                    yield from rows(words, n=sizes)
                else:
                    few.append((*words, sizes))
            if few:  # longer phrases are few: a batch's shards are summed before they are sent
                *words, sizes = (np.concatenate(column) for column in zip(*few, strict=True))
                first, sums = summed_phrases(words, sizes)
                yield from rows([w[first] for w in words], n=sums)

    source = index if not joined else index.join(held, "shard").select("shard", "alphabet", "before", "starts", "sizes")
    return source.mapInArrow(tables_of if buckets else run, schema)


def summed_phrases(words: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase (a column for each word), and the sum of its sizes."""
    key = np.zeros(len(sizes), np.int64)
    for column in words:
        _, word = np.unique(column, return_inverse=True)
        _, first, key = np.unique(key * (int(word.max(initial=0)) + 1) + word, return_index=True, return_inverse=True)
    return first, np.bincount(key, sizes, len(first)).astype(np.int64)


def among(words: list[np.ndarray], table: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Which phrases (a column for each word) are rows of ``table``; only rows of words in ``alphabet`` matter."""
    table = table[np.isin(table, alphabet).all(axis=1)]
    n = len(words[0])
    key = np.zeros(n + len(table), np.int64)
    for w, column in zip(words, table.T):
        word = np.searchsorted(alphabet, np.concatenate([w, column]))
        _, key = np.unique(key * len(alphabet) + word, return_inverse=True)
    return np.isin(key[:n], key[n:])


def _rows(schema: str, count: int, **values: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = []
    for name, kind in fields:
        value = values.get(name)
        arrays.append(pa.array(value, kinds[kind]) if isinstance(value, np.ndarray) else pa.array([value] * count, kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def frequent_phrases(docs: DataFrame, how: Phrases) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, f): phrases of one word to ``longest``, as arrays of word numbers, that occur ``least`` times; (id, lang, word); and
    (lang, n): occurrences of all words."""
    spark = docs.sparkSession
    shards = stored(shards_of(docs, how.shard), "shards")
    total = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    counted = (
        shards.select("lang", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("c"))
        .groupBy("lang", F.col("c.word").alias("word")).agg(F.sum("c.n").alias("f")).where(F.col("f") >= how.least)
    )
    words = stored(ranked(counted.select("lang", "word", "f", F.struct("lang", "word").alias("by")), "by", "id").drop("by"), "frequent-words")
    index = stored(indexed(shards, words.select("lang", "word", "id"), how.sent), "word-index")
    found = [words.select(F.array("id").alias("key"), "f")]
    tables: list = []
    held = None
    for length in range(2, how.longest + 1):
        names = [f"w{i + 1}" for i in range(length)]
        full = None
        if length == 3:  # phrases of more words hold frequent ones of three, and are few
            full = spark.sparkContext.broadcast(full_buckets(intervals(index, length, tables, held, buckets=True), how.least))
        rows = intervals(index, length, tables, held, full=full)
        summed = stored(rows.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= how.least), f"phrases-{length}")
        found.append(summed.select(F.array(*names).alias("key"), "f"))
        if length == how.longest:
            break
        if held is None:
            known = summed.select(*names).limit(how.sent + 1).collect()
            if not known:
                break
            if len(known) <= how.sent:
                tables.append(spark.sparkContext.broadcast(np.array(known, np.int64)))
                continue
        rows = intervals(index, length, tables, held, placed=True, full=full)
        kept = rows.join(summed.select(*names), names).groupBy("shard").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
        held = stored(kept, "kept-intervals")
    phrases = found[0]
    for part in found[1:]:
        phrases = phrases.unionByName(part)
    return stored(phrases, "phrases"), words.select("id", "lang", "word"), total


def collocations(docs: DataFrame, how: Phrases = Phrases(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score, left, right).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. A NULL text is
    empty, a NULL language ``und``. ``a``, ``l``, ``r``: occurrences of the phrase and of its parts at the cut with the lowest score
    floor(1000 a n / (l r)), the first of equal ones; ``n``: occurrences of all words of the language. ``left``, ``right``: occurrences of the
    most frequent phrase of a word more before or after, 0 where none has ``least`` occurrences; phrases whose words such a
    phrase holds ``closed`` percent as often are dropped. (An extension by more words occurs at most as often as one by fewer, so one word
    decides.) Equal scores go by ``a``, then by the phrase's bytes. Repeated rows count as often as they occur; an empty table, or one
    without frequent phrases, gives no rows. Other columns are left behind.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    phrases, words, total = frequent_phrases(rows, how)
    length = F.size("key")
    several = phrases.where(length > 1)
    longer = several.where(length > 2)
    beyond = (
        longer.select(F.slice("key", 2, how.longest).alias("key"), F.col("f").alias("left"), F.lit(0).cast("long").alias("right"))
        .unionByName(longer.select(F.slice(F.col("key"), F.lit(1), length - 1).alias("key"), F.lit(0).cast("long").alias("left"), F.col("f").alias("right")))
        .groupBy("key").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    )
    none = F.lit(0).cast("long")
    kept = several.join(beyond, "key", "left").select("key", F.col("f").alias("a"), F.coalesce("left", none).alias("left"), F.coalesce("right", none).alias("right"))
    kept = kept.where(F.greatest("left", "right") * 100 < F.col("a") * how.closed)
    named = (
        kept.select("key", F.posexplode("key").alias("at", "id")).join(words, "id").groupBy("key")
        .agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    )
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("cut")).select(
        "*", F.slice(F.col("key"), F.lit(1), F.col("cut")).alias("head"), F.slice(F.col("key"), F.col("cut") + 1, F.size("key") - F.col("cut")).alias("tail")
    )
    parts = (
        cuts.join(phrases.select(F.col("key").alias("head"), F.col("f").alias("l")), "head")
        .join(phrases.select(F.col("key").alias("tail"), F.col("f").alias("r")), "tail")
        .select("key", "a", "left", "right", "cut", "l", "r").join(named, "key").join(total, "lang")
    )
    # up to 38 digits, so that products of three counts stay exact
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over = (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    scored = parts.withColumn("over", over.cast("decimal(38,0)")).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    lowest = scored.groupBy("key", "lang", "phrase", "a", "n", "left", "right").agg(
        F.min(F.struct(F.expr("over div under").cast("long").alias("score"), "cut", "l", "r")).alias("best")
    )
    best_first = W.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    return (
        lowest.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= how.top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score", "left", "right")
    )
