"""Similarity join of word shingles: size bands, tiles of equal segments, bitmap bounds, exact intersection.

Two sets with a Jaccard similarity of at least t differ in at most d = (|A| + |B|) (1 - t) / (1 + t) elements. Sets are put into
bands by size, and in each band the elements are dealt by hash into somewhat more than d + 1 segments: two similar sets then
have segments in common, whole and unchanged. Sets that agree in a segment form a tile; no other pair needs to be looked at.

A segment that very many sets share says little (a common line, alone in its segment), and one without elements says nothing. A set
with more than d other segments does without them: one of the others is unchanged in any similar set. The few sets left, near copies
of many others above all, meet in the common tiles too, but only each other.

In small tiles every pair is tested: bitmaps of the sets bound the overlap from above, and most pairs end there. Pairs that pass, and
stars over the common tiles, connect nodes into clusters; members of a cluster are compared in blocks of a bounded size, again by
bitmaps and then by exact intersection of the sorted arrays, leaving out what is connected already. Large clusters begin with a
few hubs. A block reports a spanning forest of its links, never all pairs. Copies (equal sets) are one node from the start.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilume.llm.arrow_rows import bounded, broadcast_if_small, free_names, texts_of
from vigilume.llm.components import components
from vigilume.session import discard, release, stored

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@dataclass(frozen=True)
class Join:
    """``width`` words to a shingle; sets are linked when ``over`` * intersection >= ``least`` * union.

    ``growth``: ratio of the sizes at a band's ends. ``bits``: width of the bitmaps. ``block``: members compared at once.
    ``hubs``: about how many members of a large cluster all others are compared with first. ``common``: rows from which a tile
    counts as common. None of these but the first three changes a result.
    """

    width: int = 3
    least: int = 90
    over: int = 100
    growth: float = 1.5
    bits: int = 2048
    block: int = 1024
    hubs: int = 64
    common: int = 8

    @property
    def differs(self) -> Fraction:
        """Share of |A| + |B| in which similar sets may differ."""
        t = Fraction(self.least, self.over)
        return (1 - t) / (1 + t)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixing function of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers; fewer words than ``width`` are one shingle, none are none."""
    words = WORD.findall(text.encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    width = min(width, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)] + np.uint64(k + 1))
    return np.unique(total)


@lru_cache(maxsize=4)
def band_tops(growth: float) -> tuple[int, ...]:
    """The largest size in each band; the bands of the smallest sizes hold one size each."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, int(tops[-1] * growth)))
    return tuple(tops)


def segment_keys(values: np.ndarray, join: Join) -> list[tuple[np.ndarray, int]]:
    """Keys of a set's tiles in its own band, and in the next one if that can hold similar sets; each with the number of segments
    that it can do without.

    Similar sets have at most d changed segments. The number of segments follows the largest d in the band; a set's own d
    follows its size, and that of the largest set similar to it. Segments without elements make no key, unless d or fewer
    others are left; then a similar set that shares none of these is in the same state.
    """
    size, out, tops = len(values), [], band_tops(join.growth)
    own, similar = bisect_left(tops, size), size * join.over // join.least
    for b in (own, own + 1):
        if b > own and similar <= tops[own]:
            break
        most = int(2 * tops[b] * join.differs)
        n = most + 2 + most // 8 if most else 1
        d = int((size + min(similar, tops[b])) * join.differs)
        place = (mixed(values + np.uint64(b + 1)) % np.uint64(n)).astype(np.int64)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, place, mixed(values ^ np.uint64(0xD6E8FEB86659FD93)))
        filled = np.flatnonzero(np.bincount(place, minlength=n))
        used = filled if len(filled) > d else np.arange(n)
        head = np.uint64((b * 0x9E3779B97F4A7C15) & (2**64 - 1))
        out.append((mixed(sums[used] + mixed(used.astype(np.uint64) + head)), max(len(filled) - d, 0)))
    return out


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, np.uint64)
    at = (values >> np.uint64(8)) % np.uint64(bits)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits for each element; a power of two, so that it folds onto narrower ones."""
    return bitmap(values, max(64, min(1 << (2 * len(values)).bit_length(), 1 << 16)))


def may_link(size_a: int, a: np.ndarray, size_b: int, b: np.ndarray, join: Join) -> bool:
    """Whether bit counts leave the wanted similarity possible: an element whose bit the other set hasn't is not in it."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    most = min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))
    return join.over * most >= join.least * (size_a + size_b - most)


def linked(a: np.ndarray, b: np.ndarray, join: Join) -> bool:
    """Exact: intersect the sorted arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return join.over * common >= join.least * (len(a) + len(b) - common)


def node_of(values: np.ndarray) -> int:
    """A set as one signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_of(docs: DataFrame, join: Join) -> DataFrame:
    """(id, h, node, size, own, own_spare, next, next_spare, bits) of (id, text): hash of the text, number of its set, its tiles, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 4 << 20):
                found = [shingles(t or "", join.width) for t in part.column("text").to_pylist()]
                tiles = [segment_keys(v, join) if len(v) else [] for v in found]
                column = lambda k, i, none: [t[k][i] if len(t) > k else none for t in tiles]  # noqa: E731, B023
                lists = [pa.array([x if x is None else x.view(np.int64) for x in column(k, 0, None)], pa.list_(pa.int64())) for k in (0, 1)]
                spare = [pa.array(column(k, 1, 0), pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("h"), pa.array([node_of(v) for v in found], pa.int64()),
                        pa.array([len(v) for v in found], pa.int64()), lists[0], spare[0], lists[1], spare[1],
                        pa.array([signature(v).tobytes() for v in found], pa.binary()),
                    ],
                    ["id", "h", "node", "size", "own", "own_spare", "next", "next_spare", "bits"],
                )

    rows = docs.select("id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(
        run, "id long, h long, node long, size long, own array<long>, own_spare int, next array<long>, next_spare int, bits binary"
    )


def elements_of(docs: DataFrame, join: Join) -> DataFrame:
    """(node, values) of (id, text): number of each text's set, and its sorted elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 4 << 20):
                found = [shingles(t or "", join.width) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(v) for v in found], pa.int64()), pa.array([v.view(np.int64) for v in found], pa.list_(pa.int64()))],
                    ["node", "values"],
                )

    return docs.select("text").mapInArrow(run, "node long, values array<long>")


def maybe_shared(sets: DataFrame, shared: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """(node, kind, spare, tile): the tiles of ``sets`` that are among ``shared``, and a few others.

    A bitmap of the shared tiles goes to every task: 16 to 32 bits for each of them, ``most_bits`` (32 MB) in all. Fewer bits let
    more tiles through, and never lose one.
    """
    bits = 64
    while bits < min(16 * shared.count(), most_bits):
        bits *= 2
    words = shared.groupBy(F.expr(f"shiftright(tile & {bits - 1}L, 6)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(tile & 63L as int)))").alias("word")
    ).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("at").to_numpy()] = words.column("word").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in ("own", "next"):
                lists = batch.column(k)
                tile = lists.flatten().to_numpy()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
                hit = (bitmap[(tile & (bits - 1)) >> 6] >> (tile & 63)) & 1 == 1
                row = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(row), pa.array([k], pa.string()).take(pa.array(np.zeros(len(row), np.int64))),
                     batch.column(f"{k}_spare").take(row), pa.array(tile[hit])],
                    ["node", "kind", "spare", "tile"],
                )

    rows = sets.select("node", "own", "own_spare", "next", "next_spare")
    return rows.mapInArrow(run, "node long, kind string, spare int, tile long")


def near_pairs(sets: DataFrame, join: Join) -> DataFrame:
    """(node, head): pairs that connect all nodes which similar sets may connect."""
    # of copies one row is enough; rows that share the id as well may stay, which only makes a tile look shared
    first = broadcast_if_small(stored(sets.where("size > 0").groupBy("node").agg(F.min("id").alias("least")), "first-rows"))
    once = sets.where("size > 0").join(first.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")), "left_semi")
    kinds = [
        once.select("node", F.lit(k).alias("kind"), F.col(f"{k}_spare").alias("spare"), F.explode(k).alias("tile"))
        for k in ("own", "next")
    ]
    tiles = kinds[0].unionAll(kinds[1])
    # stored, so that joins can split a tile with very many members
    shared = stored(tiles.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1"), "tiles")
    # most tiles have one set: those go before anything is joined, and sent, by tile
    tiles = stored(maybe_shared(once, shared), "shared-tiles")
    # small tiles: all pairs of at most ``common`` members, tested by their bitmaps
    small = broadcast_if_small(shared.where(F.col("n") <= join.common).select("tile"))
    members = stored(tiles.join(small, "tile").groupBy("tile").agg(F.collect_set("node").alias("nodes")).where("size(nodes) > 1"), "tile-members")
    pairs = members.select(F.explode("nodes").alias("a"), "nodes").select("a", F.explode("nodes").alias("b")).where("a < b").distinct()
    meet = stored(members.select(F.explode("nodes").alias("node")).distinct(), "tile-nodes")
    bits = stored(once.join(broadcast_if_small(meet), "node", "left_semi").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits")), "bitmaps")
    both = pairs.join(bits.toDF("a", "size_a", "bits_a"), "a").join(bits.toDF("b", "size_b", "bits_b"), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("size_a", "bits_a", "size_b", "bits_b")], strict=True)
            keep = [may_link(m, np.frombuffer(x, np.uint64), n, np.frombuffer(y, np.uint64), join) for m, x, n, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["node", "head"]).filter(pa.array(keep, pa.bool_()))

    tested = stored(both.mapInArrow(test, "node long, head long"), "tested-pairs")
    discard(members, meet, bits)
    # common tiles: only sets that need them, each with the least of these
    common = broadcast_if_small(shared.where(F.col("n") > join.common).select("tile"))
    held = stored(tiles.join(common, "tile").distinct(), "common-tiles")
    needy = held.groupBy("node", "kind").agg(F.count("*").alias("n"), F.first("spare").alias("spare")).where("n >= spare").select("node", "kind")
    meeting = stored(held.join(needy, ["node", "kind"]).select("tile", "node").distinct(), "meetings")
    heads = stored(meeting.groupBy("tile").agg(F.min("node").alias("head")), "heads")
    met = stored(meeting.join(heads, "tile").where("node != head").select("node", "head").distinct(), "met-pairs")
    discard(shared, tiles, held, meeting, heads)
    return tested.unionAll(met)


def forest(nodes: list[int], sets: list[np.ndarray], join: Join) -> Iterator[tuple[int, int]]:
    """Links that connect every two of these sets that are connected by links among them."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], np.int64)
    maps = np.array([bitmap(s, join.bits) for s in sets]).reshape(n, -1)
    label = np.arange(n)
    for i in range(n - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        small, large = np.minimum(sizes[i], sizes[other]), np.maximum(sizes[i], sizes[other])
        other = other[join.over * small >= join.least * large]
        if not len(other):
            continue
        # elements whose bit the other set hasn't are not in it
        most = np.minimum(
            sizes[i] - np.bitwise_count(maps[i] & ~maps[other]).sum(1, dtype=np.int64),
            sizes[other] - np.bitwise_count(maps[other] & ~maps[i]).sum(1, dtype=np.int64),
        )
        for j in other[join.over * most >= join.least * (sizes[i] + sizes[other] - most)].tolist():
            if label[j] != label[i] and linked(sets[i], sets[j], join):
                label[label == label[j]] = label[i]
                yield nodes[i], nodes[j]


def compare_groups(members: DataFrame, by: list[str], join: Join) -> DataFrame:
    """Links (a, b) among the members of each group, which are of a bounded number; (by..., node, values) are needed."""
    ordered = members.repartition(*by).sortWithinPartitions(*by, "node").select(*by, "node", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in streamed_groups(batches, by):
            nodes, sets, last = [], [], None
            for node, values in rows:
                if node != last:
                    nodes.append(node)
                    sets.append(values.view(np.uint64))
                    last = node
            links = list(forest(nodes, sets, join))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def streamed_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, list[tuple[int, np.ndarray]]]]:
    """Groups of rows that follow each other with equal keys: (key, [(node, values)]). Holds one group."""
    key, rows = None, []
    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True)
        lists = batch.column("values")
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for k, (at, node) in enumerate(zip(keys, batch.column("node").to_pylist(), strict=True)):
            if at != key:
                if rows:
                    yield key, rows
                key, rows = at, []
            rows.append((node, flat[ends[k] : ends[k + 1]].copy()))
    if rows:
        yield key, rows


def set_links(docs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) between nodes, enough to connect all that are connected.

    ``docs`` has (id, text); ``sets`` is ``sets_of(docs, join)``, stored.
    """
    release(docs.sparkSession)
    # nodes that tiles connect; similar sets are always in one such cluster
    clusters = components(near_pairs(sets, join), "node", "head")
    size = stored(clusters.groupBy("component").agg(F.ceil(F.count("*") / join.block).cast("int").alias("blocks")), "cluster-sizes")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = stored(clusters.join(size, "component").withColumn("block", block), "clusters")
    least = sets.where("size > 0").groupBy("node").agg(F.min("id").alias("wanted"))
    wanted = stored(least.join(placed, "node").select("wanted").distinct(), "wanted")
    some = docs.join(broadcast_if_small(wanted), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    elements = elements_of(some, join)
    members = stored(elements.join(broadcast_if_small(placed), "node").select("component", "node", "values", "blocks", "block"), "members")
    # every block with the cluster's hubs, the nodes that a hash puts first
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks") * join.block) < join.hubs)
    hubs = members.where(hub).select("component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("with"), "node", "values")
    blocks = members.select("component", F.col("block").alias("with"), "node", "values")
    links = stored(compare_groups(hubs.unionByName(blocks), ["component", "with"], join), "set-links")
    large = size.where("blocks > 1")
    if large.isEmpty():
        return links
    # in large clusters: what isn't connected with the largest component, with everything
    parts = (
        placed.join(large.select("component"), "component", "left_semi")
        .join(components(links, "a", "b").withColumnRenamed("component", "part"), "node", "left")
        .select("component", "node", F.coalesce("part", "node").alias("part"))
    )
    counts = parts.groupBy("component", "part").agg(F.count("*").alias("n"))
    main = counts.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    left = main.where("all > most").withColumn("rest", F.ceil((F.col("all") - F.col("most")) / join.block).cast("int"))
    state = stored(parts.join(left, "component").select("node", (F.col("part") != F.col("main")).alias("outside"), "rest"), "parts")
    open_ = members.join(broadcast_if_small(state), "node")
    each = lambda upto, name: F.explode(F.expr(f"sequence(0, {upto} - 1)")).alias(name)
    outside = open_.where("outside").select(
        "component", F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("rest")).cast("int").alias("own"), each("blocks", "with"), "node", "values",
    )
    against = open_.select("component", each("rest", "own"), F.col("block").alias("with"), "node", "values")
    more = compare_groups(outside.unionByName(against), ["component", "own", "with"], join)
    return stored(links.unionAll(more), "set-links")


def similarity_classes(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_shingles, component_id).

    ``component_id``: the least id reachable by links between texts whose sets have the wanted similarity, the row's own
    id included. NULL and empty texts, and texts without words, have empty sets, which link with nothing. Repeated rows and
    equal texts are linked; a row without an id takes part, and gets the least id of its component, NULL if there is none.
    Other columns are left behind. Words, shingles and sets are compared as 64-bit hashes.
    """
    texts = texts_of(docs, id_col, text_col)
    sets = stored(sets_of(texts, join), "sets")
    links = set_links(texts, sets, join)
    return classes(sets, links)


def named_nodes(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(node, least, component): of each set the least id that has it, and the component."""
    least = sets.where("size > 0").groupBy("node").agg(F.min("id").alias("least"))
    return least.join(components(links, "a", "b"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))


def classes(sets: DataFrame, links: DataFrame) -> DataFrame:
    named = named_nodes(sets, links)
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(first, "component").select(F.col("node").alias("of"), "component_id")
    return sets.join(by_node, (F.col("node") == F.col("of")) & (F.col("size") > 0), "left").select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: one row of each.

    It is the row with the least id (NULL last), of several the one with the least set and hash of its text, of equal rows any.
    Rows with empty sets link with nothing and all stay.
    """
    texts = texts_of(docs, id_col, text_col)
    sets = stored(sets_of(texts, join), "sets")
    nodes = named_nodes(sets, set_links(texts, sets, join)).select("node", "component")
    placed = sets.where("size > 0").select("id", "h", "node").join(nodes, "node")
    rank = F.struct(F.col("id").isNull(), "id", "node", "h")
    chosen = placed.groupBy("component").agg(F.min(rank).alias("m"), F.count("*").alias("n")).where("n > 1")
    rows = stored(placed.join(chosen, "component").select("id", "h", (F.col("id").eqNullSafe(F.col("m.id")) & (F.struct("node", "h") == F.struct("m.node", "m.h"))).alias("first")), "kept-rows")
    # rows with equal ids and texts can't be told apart here; they are all first or all not
    lost = stored(rows.groupBy("id", "h").agg(F.max("first").alias("first"), F.count("*").alias("n")).where("not first or n > 1"), "lost-rows")
    of, text_hash, is_first = free_names(docs.columns, "of", "text_hash", "is_first")
    lost = lost.toDF(of, text_hash, is_first, free_names(docs.columns, "rows")[0])
    same = F.col(id_col).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(text_hash))
    alone = docs.join(lost, same, "left_anti")
    repeated = lost.where(F.col(is_first))
    if repeated.isEmpty():
        return alone
    return alone.unionByName(docs.join(repeated, same).dropDuplicates([of, text_hash]).select(*docs.columns))
