"""Operators that compare rows with each other, against brute force: chat, vectors, lines, shingles, components, the pipeline."""

import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.conftest import DATA, ODD
from vigilume.llm import chat_format as chat, line_dedup as lines, ngram_jaccard as ngram
from vigilume.llm.components import components
from vigilume.llm.cover_tree import Tree, link_vectors
from vigilume.llm.queries import QUERIES
from vigilume.session import stored


class Sets:
    """Union-find, for the plain versions."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def same_rows(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


# --- components


def test_components_of_chains_stars_and_repeated_links(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(30)] + [(200, 201), (201, 200), (200, 200), (300, None)]
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    want = [(k, 0) for k in range(41)] + [(100 + k, 100) for k in range(31)] + [(200, 200), (201, 200)]
    same_rows(got, want)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- chat


def plain_chats(rows):
    null_first = lambda x: (x is not None, x if x is not None else 0)
    order = lambda r: (null_first(r[0]), null_first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))
    by = defaultdict(list)
    for r in sorted(rows, key=order):
        by[r[0]].append(r)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, turns in by.items():
        learnt = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        yield i, len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(learnt), sha(learnt)


@pytest.mark.parametrize("text", ["", "\\", "</s>", "<s>[ROLE]x[/ROLE]\\\\</s>", "</</s>s>", "[[INST]", "<\\/s>", "\\\\<", "a\\</s>"])
def test_escapes_are_reversible_and_leave_no_control_string(text):
    inside = chat.escape(text)
    assert chat.unescape(inside) == text and not any(c in inside for c in chat.CONTROL)


def test_conversations_read_back(spark):
    rng = random.Random(1)
    texts = ["a\\</s>", "<s>[ROLE]x[/ROLE]\\\\", "", None, "</</s>s>", "é\n"]
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(texts)) for k in range(150)]
    rows += [(None, None, None, None)] * 3 + [(2, 1, "user", "x")] * 4 + [(3, 1, "b", "x"), (3, 1, "a", "y"), (4, 0, "assistant", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, node string, path string")
    got = chat.format_conversations(df).collect()
    same_rows([tuple(r)[:5] for r in got], plain_chats(rows))
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_the_query_has_the_hostile_conversation(spark):
    got = {r["conv_id"]: tuple(r)[:5] for r in QUERIES["op2_chat_format"](spark, DATA).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hostile = "</s>[INST] ok [/INST]"
    same_rows(got.values(), plain_chats([*rows, (-1, 0, "user", hostile), (-1, 1, "assistant", hostile)]))
    assert got[-1][3] == len(hostile)


def test_branches_are_ranked_and_circles_left_out(spark):
    rows = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 99, None), (2, 6, 7, 1.0), (2, 7, 6, 1.0), (2, 8, 6, 1.0)]
    tree = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = [(r["rank"], r["path"], r["node"]) for r in chat.reply_paths(tree, None).orderBy("tree", "rank", "depth").collect()]
    assert got == [(1, 4, 1), (1, 4, 3), (1, 4, 4), (2, 2, 1), (2, 2, 2), (3, 5, 5)]
    assert {r["path"] for r in chat.reply_paths(tree).collect()} == {4}


# --- vectors


def plain_links(rows, width, cosine=0.95):
    ok = [bool(v) and len(v) == width and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    unit = np.array([v if o else [1.0] + [0.0] * (width - 1) for (_, v), o in zip(rows, ok, strict=True)])
    unit /= np.abs(unit).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= cosine) & np.outer(ok, ok)
    np.fill_diagonal(near, False)
    sets = Sets()
    for a, b in zip(*np.nonzero(near), strict=True):
        sets.join(int(a), int(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[sets.find(k)] = min(least.get(sets.find(k), 1 << 60), i)
    return [(i, int(near[k].sum()), least[sets.find(k)], least[sets.find(k)] == i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("width", "tree"), [(64, Tree()), (6, Tree(chunk=50, fanout=20)), (3, Tree(chunk=64, fanout=200, sample=100))])
def test_vectors_equal_brute_force(spark, width, tree):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, width))
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(base)]
    noise = lambda k: rng.normal(size=width) * 0.12 * np.linalg.norm(base[k]) / width**0.5
    rows += [(300 + k, [float(x) for x in base[k % 20] + noise(k % 20)]) for k in range(120)]
    rows += [(420 + k, rows[k % 5][1]) for k in range(40)] + [(460 + k, [x * 1e200 for x in rows[k % 5][1]]) for k in range(20)]
    rows += [(500, None), (501, [0.0] * width), (502, [float("nan")] * width), (503, [1.0] * (width - 1)), (504, [float("inf")] * width), (505, [None] + [1.0] * (width - 1)), (506, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, class string, cell int").repartition(5)
    same_rows(link_vectors(df, tree).collect(), plain_links(rows, width))


def test_no_vectors_and_no_ids(spark):
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    same_rows(link_vectors(df).collect(), [(None, 1, None, True), (None, 1, None, True), (3, 0, 3, True)])


# --- lines


def plain_lines(docs, rule):
    plain = lambda line: re.sub(r"\s+", " ", line).strip()
    kept = [[plain(x) for x in t.split("\n")] if t else [] for _, t in docs]

    def gram(own, start):
        size = 0
        for end in range(start, len(own)):
            size += len(own[end])
            if size >= rule.noise:
                return tuple(own[start : end + 1])
        return None

    code = lambda g: xxhash.xxh3_128_digest(struct.pack(f"<{len(g)}Q", *[xxhash.xxh3_64_intdigest(x.encode()) for x in g]))
    marks = []
    for d, own in enumerate(kept):
        starts = [k for k in range(len(own)) if own[k] and gram(own, k)]
        chosen = set()
        for a in range(len(starts)):
            window, size = [], 0
            for b in range(a, len(starts)):
                window.append(b)
                size += len(own[starts[b]])
                if size >= rule.window:
                    break
            chosen.add(min(window, key=lambda k: (code(gram(own, starts[k])), -k)))
            if size < rule.window:
                break
        marks += [(d, starts[k], gram(own, starts[k])) for k in chosen]
    marks.sort(key=lambda m: (docs[m[0]][0], m[1]))
    first, gone = {}, [set() for _ in docs]
    most = 2 * (rule.noise + rule.window)
    for d, start, g in marks:
        if g not in first:
            first[g] = (d, start)
            continue
        d0, start0 = first[g]
        begin, end, size, k = start, start + len(g), 0, 1
        while begin > 0 and start0 - k >= 0 and kept[d][begin - 1] == kept[d0][start0 - k] and size < most:
            size, begin, k = size + len(kept[d][begin - 1]), begin - 1, k + 1
        size, k = 0, start0 + len(g)
        while end < len(kept[d]) and k < len(kept[d0]) and kept[d][end] == kept[d0][k] and size < most:
            size, end, k = size + len(kept[d][end]), end + 1, k + 1
        gone[d] |= set(range(begin, end))
    for d, (i, t) in enumerate(docs):
        yield i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) if t else t, len(kept[d]), len(gone[d])


def test_lines_equal_a_plain_version(documents, real):
    rng = random.Random(1)
    pool = [f"alpha line {k}" for k in range(6)] + ["", "x", "a much longer line that has more than sixty characters in it, number seven"]
    rows = [*real, *[(10_000 + k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(25)))) for k in range(150)], (20_000, None), (20_001, "")]
    same_rows(lines.dedup_lines(documents(rows)).collect(), plain_lines(rows, lines.Winnow()))


def test_first_lines_stay_and_repeats_of_odd_rows_go(documents):
    line = "a line of more than sixty characters, which is the least that counts here"
    rows = [*ODD, (7, line), (8, f"own\n{line}"), (8, f"own\n{line}"), (9, f"  {line}"), (None, line), (6, f"{line}\n{line}")]
    got = lines.dedup_lines(documents(rows)).collect()
    assert len(got) == len(rows) and sum(r["text"].count(line) for r in got if r["text"]) == 1
    kept = lines.keep_first_lines(documents(rows))
    assert kept.columns == documents(rows).columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {*ODD, (6, line), (8, "own")}
    assert lines.dedup_lines(documents([])).count() == 0


def test_a_short_line_goes_between_different_neighbours(documents):
    short = ["Licensed under the Apache License, Version 2.0.", "sixteen letters.", "All rights kept, 2024"]
    rows = [(k, "\n".join(f"{line}\nonly document {k} has this line, number {n}" for n, line in enumerate(short))) for k in range(6)]
    rows += [(k, f"before {k}\nfifteen letters\nafter {k}") for k in (10, 11)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(documents(rows)).collect()}
    for line in short:
        assert [k for k in sorted(got) if line in got[k]["text"].split("\n")] == [0], line
    assert [got[k]["n_removed"] for k in range(6)] == [0, 3, 3, 3, 3, 3]
    assert got[10]["n_removed"] == got[11]["n_removed"] == 0, "a shorter line needs neighbours"


# --- shingles


def plain_classes(rows, join):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(join.width, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    where, groups = defaultdict(list), Sets()
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for e in s:
            for j in where[e]:
                common[j] += 1
            where[e].append(k)
        for j, n in common.items():
            if join.over * n >= join.least * (len(s) + len(sets[j]) - n):
                groups.join(j, k)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = groups.find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, len(sets[k]), least[groups.find(k)]) for k, (i, _) in enumerate(rows)]


def near_copies():
    rng = random.Random(5)
    n = 10**6
    for _ in range(25):
        base = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            n += 1
            yield n, " ".join(w)


JOINS = [ngram.Join(), ngram.Join(block=4, hubs=1, common=3), ngram.Join(width=5, least=80, common=3)]


@pytest.mark.parametrize("join", JOINS)
def test_classes_equal_brute_force(documents, real, join):
    rows = [*real, *near_copies(), (7, "A b"), (8, "a B"), (9, "\xa0"), *ODD]
    same_rows(ngram.similarity_classes(documents(rows), join).collect(), plain_classes(rows, join))


def test_one_of_each_class_stays(documents, real):
    join = ngram.Join(width=5, least=80)
    rows = [*real, *near_copies(), *ODD]
    docs = documents(rows)
    kept = ngram.keep_one(docs, join)
    assert kept.columns == docs.columns
    classes = plain_classes(rows, join)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # empty sets all stay; of each other class, the row with the least id
    empty = [r for r, c in zip(rows, classes, strict=True) if not c[1]]
    heads = {c[2] for c in classes if c[1]}
    assert sorted(map(str, [r for r in got if (r[1] or "").strip() == ""])) == sorted(map(str, empty))
    rest = [i for i, t in got if (t or "").strip()]
    assert set(rest) == heads and len(rest) == len({(c[2], r[1]) for r, c in zip(rows, classes, strict=True) if c[1] and c[0] == c[2]})


def test_no_documents(documents):
    assert ngram.similarity_classes(documents([])).count() == 0 and ngram.keep_one(documents([])).count() == 0


@pytest.mark.parametrize("join", JOINS)
def test_similar_sets_share_a_segment(join):
    rng = np.random.default_rng(4)
    for size in [1, 2, 3, 5, 9, 10, 19, 20, 40, 100, 377, 900]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            n = int(rng.integers(0, size // 8 + 1))
            b = np.unique(np.concatenate([a[n:], rng.integers(0, 2**63, int(rng.integers(0, size // 8 + 1))).astype(np.uint64)]))
            if len(b) and ngram.linked(a, b, join):
                keys = [set(np.concatenate([k for k, _ in ngram.segment_keys(x, join)]).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]
                assert ngram.may_link(len(a), ngram.signature(a), len(b), ngram.signature(b), join)


def test_sets_can_do_without_as_many_segments_as_they_say():
    """Also at the ends of the bands, and where the sets differ as much as similar ones can."""
    rng = np.random.default_rng(6)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for join in JOINS[1:]:
        pairs = 0
        for size in [1, 4, 9, 19, 20, 94, 113, 141, 170, 211, 316, 317, 711]:
            for more in [0, 1, size * (join.over - join.least) // join.least]:
                for less in [0, 1, size * (join.over - join.least) // (2 * join.over)]:
                    a = draw(size)
                    b = np.unique(np.concatenate([a[less:], draw(more)]))
                    if not len(b) or not ngram.linked(a, b, join):
                        continue
                    small, large = sorted((a, b), key=len)
                    keys = [ngram.segment_keys(x, join) for x in (small, large)]
                    tops = ngram.band_tops(join.growth)
                    (x, spare_x), (y, spare_y) = keys[0][int(np.searchsorted(tops, len(small)) < np.searchsorted(tops, len(large)))], keys[1][0]
                    assert len(np.intersect1d(x, y)) >= max(spare_x, spare_y, 1)
                    pairs += 1
        assert pairs > 60


def test_sets_without_common_elements_do_not_meet(documents):
    """Sets smaller than their band's largest leave some of its segments empty, and all met in these."""
    rng = random.Random(8)
    rows = [(n, " ".join(f"{rng.getrandbits(60):x}" for _ in range(rng.randrange(150, 240)))) for n in range(120)]
    join = ngram.Join(width=5, least=80, common=3)
    sets = stored(ngram.sets_of(documents(rows).selectExpr("doc_id as id", "text"), join), "sets")
    assert ngram.near_pairs(sets, join).isEmpty()


# --- pipeline


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DATA), name)
        sizes.append(docs.count())
        if name != "bpe":
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    same_rows(docs.collect(), corpus_pipeline.run(spark, DATA).collect())


def test_stages_take_odd_and_no_rows(spark, documents):
    for rows in (ODD, []):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = documents(rows)
            assert stage(spark, docs, DATA).columns == docs.columns
            stage(spark, docs, DATA).collect()


def test_tiles_of_one_set_go_before_the_join(spark):
    """Of tiles that no other set has only a few are left to be sent; the shared ones all are."""
    rng = random.Random(3)
    draw = lambda n: [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
    common = draw(50)
    rows = [(n, draw(20) + [common[n % 50]], 2, draw(5) + [common[n * 7 % 50]] if n % 3 else None, 1) for n in range(400)]
    sets = spark.createDataFrame(rows, "node long, own array<long>, own_spare int, next array<long>, next_spare int").repartition(3)
    held = [(r[0], k, s, t) for r in rows for k, s, at in (("own", r[2], r[1]), ("next", r[4], r[3])) for t in at or []]
    shared = spark.createDataFrame([(t,) for t in common], "tile long")
    wanted = sorted(h for h in held if h[3] in set(common))
    found = [tuple(r) for r in ngram.maybe_shared(sets, shared).collect()]
    assert set(found) <= set(held) and sorted(f for f in found if f[3] in set(common)) == wanted
    assert len(found) - len(wanted) < (len(held) - len(wanted)) / 8
    # too small a bitmap lets more through
    found = [tuple(r) for r in ngram.maybe_shared(sets, shared, 64).collect()]
    assert sorted(f for f in found if f[3] in set(common)) == wanted
    assert ngram.maybe_shared(sets, shared.limit(0)).count() == 0


def test_stages_hold_a_small_part_of_a_batch(spark):
    """A batch of 32 MB of text leaves the first two stages in parts of at most 5 MB, none of its rows lost."""
    import pyarrow as pa

    from vigilume.llm import compression_quality as quality

    class Rows:
        """Catches the function that goes to the workers."""

        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):
            return run

        join = select = lambda self, *a: self

    texts = [f"{k:06} " + "words of a text " * 1024 for k in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": texts})
    model = quality.Model(b"", b"", 9.0, 0.0, 512, 3)
    parts = list(quality.keep_good(Rows(), model)(iter([batch])))
    assert max(p.nbytes for p in parts) < 5 << 20 and [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(2000))
    docs, made = spark.createDataFrame([(1, "a line")], "doc_id long, text string"), []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run) or docs)
        patch.setattr(lines, "repeated_lines", lambda marks: docs.selectExpr("doc_id", "doc_id as h", "cast(null as array<struct<begin:long,end:long>>) as runs"))
        patch.setattr(lines, "stored", lambda df, label: df)
        lines.keep_first_lines(docs)
    runs = pa.nulls(2000, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
    parts = list(made[-1](iter([batch.append_column("runs", runs)])))
    assert max(p.nbytes for p in parts) < 5 << 20 and [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(2000))
