"""Collocations against counting in plain Python; the index against sorted suffixes; odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from vigilume.llm.collocations import BUCKETS, PARTS, Index, Phrases, among, bucket_of, collocations, frequent_phrases, full_buckets, longer_of, packed, pairs_of, runs_of_words, summed_phrases, transform, words_and_sequence

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(docs, how):
    counts = {}
    for _, text, lang in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for words in pieces(text):
            for k in range(1, 6):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if 2 <= len(p) <= how.longest and c >= how.least}
        held = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * c >= how.closed * a and held(p, q) for q, c in candidates.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(rows[: how.top])]
    return sorted(out)


def found(spark, docs, how):
    rows = collocations(spark.createDataFrame(docs, SCHEMA).repartition(4), how).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["a", "b", "été", "Straße", "x-y", "(c)", "d", "𝒳", "e", " f", "G", "g"]
    docs = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!?", " ; "]) for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            text += "the Quick brown fox jumps " * rng.randint(1, 3)
        docs.append((k, text, rng.choice(["en", "en", "de", None])))
    return docs


@pytest.mark.parametrize("how", [Phrases(least=12, top=40, shard=2000), Phrases(least=5, closed=80, sent=3), Phrases(least=3, top=1000, longest=3, shard=500)])
def test_rows_equal_brute_force(spark, how):
    docs = corpus(how.least)
    expected = brute(docs, how)
    assert found(spark, docs, how) == expected and len(expected) > 30


def test_extensions_are_those_of_the_corpus(spark):
    docs = corpus(1)
    how = Phrases(least=8, closed=101, top=10_000)
    full = Counter()
    for _, text, lang in docs:
        for words in pieces(text):
            full.update((lang or "und", tuple(words[i : i + k])) for k in range(2, 6) for i in range(len(words) - k + 1))
    rows = collocations(spark.createDataFrame(docs, SCHEMA), how).collect()
    for r in rows:
        p = tuple(r.phrase.split(" "))
        more = {q: c for (lang, q), c in full.items() if lang == r.lang and len(q) == len(p) + 1 and c >= how.least}
        assert r.left == max((c for q, c in more.items() if q[1:] == p), default=0)
        assert r.right == max((c for q, c in more.items() if q[:-1] == p), default=0)


def test_shards_of_any_size_give_the_same(spark):
    docs = corpus(7)
    results = [found(spark, docs, Phrases(least=6, shard=size)) for size in (1, 700, 1 << 20)]
    assert results[0] == results[1] == results[2] and results[0]


def test_index_equals_sorted_suffixes():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (2, 2), (300, 3), (400, 2)):
        symbols = np.append(0, rng.integers(0, kinds, n - 1)) if n > 1 else np.zeros(1, int)
        index = Index.of_transform(transform(symbols.astype(np.int32)))
        text = "".join("|abc"[s] for s in symbols)
        grams = Counter(text[i : i + k] for k in range(2, 6) for i in range(n - k + 1) if "|" not in text[i : i + k])
        starts, sizes = pairs_of(index)
        spell = lambda at, k: ["".join("|abc"[s] for s in w) for w in zip(*index.words(at, k))]
        assert dict(zip(spell(starts, 2), sizes.tolist())) == {g: c for g, c in grams.items() if len(g) == 2}
        frequent = grams
        for k in range(3, 6):
            kept = sizes >= 20
            frequent = {g for g, c in grams.items() if len(g) == k - 1 and c >= 20}
            starts, sizes = longer_of(index, starts[kept], sizes[kept])
            expected = {g: c for g, c in grams.items() if len(g) == k and g[1:] in frequent and g[:-1] in frequent}
            assert dict(zip(spell(starts, k), sizes.tolist())) == expected


def test_a_long_run_without_pieces():
    symbols = np.array([0, *([1, 2] * 5000), 1], np.int32)
    index = Index.of_transform(transform(symbols))
    starts, sizes = pairs_of(index)
    assert sorted(sizes.tolist()) == [5000, 5000]
    for expected in ([4999, 5000], [4999, 4999]):
        starts, sizes = longer_of(index, starts, sizes)
        assert sorted(sizes.tolist()) == expected


def test_phrases_among_a_table():
    alphabet = np.array([0, 5, 7, 9])
    table = np.array([[5, 7, 9], [9, 9, 9], [5, 8, 9]])
    words = [np.array([5, 9, 5, 7]), np.array([7, 9, 9, 7]), np.array([9, 9, 9, 7])]
    assert among(words, table, alphabet).tolist() == [True, True, False, False]


def test_buckets_never_lose_a_frequent_phrase(spark):
    """Parts of two tasks' tables add up; equal phrases share a bucket."""
    words = [np.array([4, 9, 4, 4]), np.array([1, 1, 1, 2])]
    assert bucket_of(words)[0] == bucket_of(words)[2] != bucket_of(words)[3]
    counts = np.zeros((2, BUCKETS), np.int64)
    counts[0, 5], counts[1, 5], counts[0, BUCKETS - 1] = 2, 3, 4
    rows = [(part, packed(some)) for table in counts for part, some in enumerate(np.split(table, PARTS)) if some.any()]
    full = full_buckets(spark.createDataFrame(rows, "part long, counts binary"), 5)
    assert np.flatnonzero(full).tolist() == [5]


def test_phrases_are_summed():
    words = [np.array([4, 9, 4, 4]), np.array([1, 1, 1, 2])]
    first, sums = summed_phrases(words, np.array([5, 6, 7, 8]))
    assert {(int(words[0][i]), int(words[1][i]), int(n)) for i, n in zip(first, sums)} == {(4, 1, 12), (9, 1, 6), (4, 2, 8)}


def test_words_and_runs():
    words, counts, sequence = words_and_sequence(["A b\tb. ", "", "c,,A "])
    names = words.to_pylist()
    assert [names[s] if s >= 0 else "." for s in sequence] == ["a", "b", "b", ".", ".", ".", "c", ".", ".", "a "] and counts.tolist() == [1, 2, 1, 1]
    assert runs_of_words(np.array([0, 1, -1, 2, -1, -1, 0, 2, 1, 0]), np.array([5, 7, 0])).tolist() == [0, 5, 7, 0, 7, 5]
    assert runs_of_words(np.array([], np.int32), np.array([], np.int64)).tolist() == [0]


def test_odd_rows(spark, documents):
    how = Phrases(least=2)
    docs = [(None, None, None), (1, "", "en"), (2, "x y", "en"), (2, "x y", "en"), (3, " \t.\n", None), (4, "x y", ""), (5, "word " * 30_000, "en")]
    assert found(spark, docs, how) == brute(docs, how)
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert frequent_phrases(spark.createDataFrame([("", "en")], "text string, lang string"), how)[0].collect() == []
    clash = spark.createDataFrame([("x y", "en", 1, "k", 2)] * 3, "text string, lang string, n int, key string, shard int")
    assert [(r.phrase, r.a) for r in collocations(clash, how).collect()] == [("x y", 3)]
