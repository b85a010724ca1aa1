"""Reply trees as chat transcripts.

Messages form trees by the id of the message they answer. Root-to-leaf paths are enumerated by iterative self-joins that double
their reach: round k joins every message's ancestor 2^k steps up with that ancestor's own, and adds up depth and score on the way,
so a branch of n messages takes log2(n) joins. Branches of a tree are ranked by score, and the messages of the chosen ones are found
by walking the same tables down again.

Each path is written as one conversation in segments: rows of a bounded size, in order, with the loss mask as spans of code points
(one in the assistant's texts, none elsewhere). Segments stream through a task in order, so a conversation is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilume.functions.ordering import running_totals
from vigilume.session import shared_dir, stored

#: The template's control strings: the begin of a turn, the end of its role, the end of the turn, and marks that models of this
#: kind give a meaning to.
BEGIN, HEAD, END = "<s>", "[/ROLE]", "</s>"
ROLE = "[ROLE]"
CONTROL = (BEGIN, END, ROLE, HEAD, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(BEGIN + ROLE) + "(.*?)" + re.escape(HEAD) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of every control string, so none is left."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def written_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text lies in it."""
    head = f"{BEGIN}{ROLE}{escape(role)}{HEAD}"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def reply_paths(messages: DataFrame, chosen: int | None = 1) -> DataFrame:
    """(tree, path, rank, depth, node): the messages of each tree's branches, from the root (depth 0) to the leaf.

    ``messages`` has tree, node (unique), parent (NULL for a root; a parent that is missing makes a root too) and score (NULL
    counts as 0). A branch scores the sum of its messages; ``rank`` orders the branches of a tree by falling score, then by
    leaf, and ``chosen`` keeps the first so many (None: all). ``path`` is the leaf. Messages on a cycle reach no root and make
    no path.
    """
    from pyspark.sql import Window as W

    base = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = base.select(F.col("node").alias("is"))
    base = base.join(known, F.col("parent") == F.col("is"), "left").select("tree", "node", F.col("is").alias("up"), "score")
    # up: the ancestor 2^k steps above, NULL past the root; depth and total: of the messages from the node up to there
    level = stored(base.select("node", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "replies")
    levels, most = [level.select("node", "up")], level.count()
    # branches are no longer than the number of messages: whatever is open then runs in a circle
    while 1 << len(levels) <= 2 * most and not level.where("up is not null").isEmpty():
        above = level.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        further = level.where("up is not null").join(above, "up").select(
            "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total"),
        )
        level = stored(level.where("up is null").unionAll(further), "replies")
        levels.append(level.select("node", "up"))
    done = level.where("up is null").drop("up")
    leaves = base.select("tree", "node").join(base.select(F.col("up").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    ranked = leaves.join(done, "node").withColumn(
        "rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node"))
    )
    if chosen is not None:
        ranked = ranked.where(F.col("rank") <= chosen)
    # walk down the tables again: the ancestors of a leaf at all distances
    walk = stored(ranked.select("tree", F.col("node").alias("path"), "rank", "node", (F.col("depth") - 1).alias("depth")), "paths")
    for k in range(len(levels) - 1, -1, -1):
        step = walk.join(levels[k].where("up is not null"), "node").select(
            "tree", "path", "rank", F.col("up").alias("node"), (F.col("depth") - F.lit(1 << k)).alias("depth")
        )
        walk = stored(walk.unionAll(step), "paths")
    return walk


def format_paths(turns: DataFrame, segment: int = 1 << 20, trained: str = "assistant") -> DataFrame:
    """(path, segment, text, mask): the turns (path, depth, role, text) of each path in the template, in segments.

    A segment ends after the turn that brings it to ``segment`` characters. ``mask`` has start and end, in code points of the
    segment, of each text of the role that is trained on. NULL roles and texts count as empty.
    """
    ordered = turns.select("path", "depth", "role", "text").repartition("path").sortWithinPartitions("path", "depth")
    names = ["path", "segment", "text", "mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, number, parts, mask, size = None, 0, [], [], 0

        def batch_of():
            return pa.RecordBatch.from_arrays(
                [pa.array([path], pa.int64()), pa.array([number], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([mask], pa.list_(pa.int64()))], names
            )

        for batch in batches:
            for at, role, text in zip(*[batch.column(c).to_pylist() for c in ("path", "role", "text")], strict=True):
                if parts and (at != path or size >= segment):
                    yield batch_of()
                    number, parts, mask, size = (number + 1 if at == path else 0), [], [], 0
                path = at
                turn, start, end = written_turn(role or "", text or "")
                if role == trained:
                    mask += [size + start, size + end]
                parts.append(turn)
                size += len(turn)
        if parts:
            yield batch_of()

    return ordered.mapInArrow(run, "path long, segment long, text string, mask array<long>")


def read_back(segments: DataFrame) -> DataFrame:
    """(path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted segments.

    Digests run over the segments of a path in order; nothing but the state of the digests is kept between them.
    """
    ordered = segments.select("path", "segment", "text", "mask").repartition("path").sortWithinPartitions("path", "segment")
    names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            out = []
            for at, text, mask in zip(*[batch.column(c).to_pylist() for c in ("path", "text", "mask")], strict=True):
                if state is None or at != path:
                    if state is not None:
                        out.append(_closed(path, state))
                    path, state = at, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in _TURN.findall(text):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for start, end in zip(mask[::2], mask[1::2], strict=True):
                    learnt = unescape(text[start:end])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(_closed(path, state), types, strict=True)], names)

    schema = "path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema)


def _closed(path, state) -> tuple:
    return path, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def chains(conversations: DataFrame, score: Column | None = None) -> DataFrame:
    """Conversations as reply trees without branches: (tree, node, parent, score, role, text).

    Rows are ordered by (conv_id, turn, role, text), NULL first, and each answers the row before it; rows that are equal in all
    four stay as many turns. A tree is a conversation, numbered by its first row, since its id may be NULL.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    single = counted.withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).drop("n")
    # NULL sorts first inside a struct
    key = F.struct("conv_id", "turn", "role", "text", "copy")
    numbered = running_totals(single.withColumn("key", key), "key", {"node": F.lit(1).cast("long")}, previous=["conv_id"])
    return numbered.select(
        "conv_id", "node", F.when(F.col("prev_conv_id").eqNullSafe(F.col("conv_id")) & (F.col("node") > 1), F.col("node") - 1).alias("parent"),
        (F.length(F.coalesce("text", F.lit(""))).cast("double") if score is None else score).alias("score"), "role", "text",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the formatted output: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). Rows without a conv_id are one conversation of their own; other columns are left behind."""
    spark = conversations.sparkSession
    nodes = stored(chains(conversations), "messages")
    paths = reply_paths(nodes.select(F.coalesce("conv_id", F.lit(-(1 << 63))).alias("tree"), "node", "parent", "score"))
    turns = paths.select("path", "depth", "node").join(nodes.select("node", "role", "text"), "node")
    folder = shared_dir(spark, "chat")
    format_paths(turns).write.parquet(folder)
    read = read_back(spark.read.schema("path long, segment long, text string, mask array<long>").parquet(folder))
    ids = nodes.select(F.col("node").alias("path"), "conv_id")
    return read.join(ids, "path").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
