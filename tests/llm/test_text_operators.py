"""Operators that look at one text at a time: secrets, pages, token files, BPE, quality, decontamination."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import DATA, ODD
from vigilume.llm import bpe_automaton, compression_quality as quality, decontaminate as deco, html_extract, secret_scan, token_files
from vigilume.session import shared_dir

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def strange_texts(n):
    rng = random.Random(5)
    wide = [chr(rng.choice([rng.randrange(0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(800)]
    pools = [[chr(c) for c in range(0x250)], list(" \n\t\rab's1\x1c\x85\xa0!"), wide, list("the re'd of ")]
    ends = ["", "", "", "<|endoftext|>", "<|startoftext|> a<|endoftext|>"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) + rng.choice(ends) for pool in rng.choices(pools, k=n)]


# --- secrets


def test_base_spans_and_their_order():
    text = 'é API_KEY: "abcdefgh" token=short password = x1234567 AKIAABCDEFGHIJKL AKIASHORT ' + "0123456789abcdef" * 2
    found = secret_scan.base_spans(text)
    assert [(k, text[a:b]) for a, b, k in sorted(found)] == [
        ("assign", 'API_KEY: "abcdefgh'), ("assign", "password = x1234567"), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0123456789abcdef" * 2)
    ]
    assert secret_scan.written([(3, 9, "hex"), (3, 8, "assign"), (1, 2, "hex")]) == "hex:1:2,assign:3:8,hex:3:9"
    assert secret_scan.base_spans("paſſword=abcdefgh") == [], "letters of either case are ASCII letters"
    assert secret_scan.base_spans("token=api_key:abcdefgh1") == [], "a match that fails is not looked into again"


@pytest.mark.parametrize(("weak", "strong"), [
    ("password", "pqzsxord"), ("aaaaaaaaaaaa", "akdjwmqpzbxn"), ("qwertyuiop", "qjfwyxuzop"), ("20240131", "83920571"),
    ("abcabcabcabc", "abzqkmwncxpt"), ("p4ssw0rd", "p4kz8w0q"), ("abcdefghij", "akcdqfwhxj"),
])
def test_cheaper_cuts_are_found(weak, strong):
    ranks = secret_scan.word_ranks("")
    assert secret_scan.guess_cost(weak, ranks) < secret_scan.guess_cost(strong, ranks)


def test_cost_equals_the_least_over_all_cuts():
    """On short values without patterns but words, against trying every cut."""
    ranks = {"cat": 3, "sand": 9, "and": 1, "castle": 30}
    value = "catsandq"

    def cheapest(text):
        if not text:
            return 0.0
        best = min(secret_scan.PIECE + k * secret_scan._charset(value) + cheapest(text[k:]) for k in range(1, len(text) + 1))
        for w, r in ranks.items():
            if text.startswith(w):
                best = min(best, secret_scan.PIECE + np.log10(r + 1) + cheapest(text[len(w) :]))
        return best

    assert secret_scan.guess_cost(value, ranks) == pytest.approx(cheapest(value))
    assert secret_scan.guess_cost("", ranks) == 0


def test_guessed_values_in_context():
    text = "pwd = Tr0ub4dor&3x!kq, passphrase -> 'zX9#kLm2$vQ8'; the password: is important. token: qwertyuiop"
    assert [text[a:b] for a, b, *_ in secret_scan.guess_spans(text, 8.0)] == ["Tr0ub4dor&3x!kq", "zX9#kLm2$vQ8"]


@pytest.mark.parametrize(("text", "want"), [
    ('pwd="QmWnEbRvTcYxUzIo" and secret="LpOkMjNiUhBvGyCf"', ["QmWnEbRvTcYxUzIo", "LpOkMjNiUhBvGyCf"]),
    ('secret="LpOkMjNiUhBvGyCf" and pwd="QmWnEbRvTcYxUzIo"', ["LpOkMjNiUhBvGyCf", "QmWnEbRvTcYxUzIo"]),
    ('pwd="QmWnEbRvTcYxUzIo" or, again, pwd="QmWnEbRvTcYxUzIo"', ["QmWnEbRvTcYxUzIo"] * 2),
    ('old pwd="QmWnEbRvTcYxUzIo", new pwd="QmWnEbRvTcYxUzIo7"', ["QmWnEbRvTcYxUzIo", "QmWnEbRvTcYxUzIo7"]),
    ("pwd: QmWnEbRvTcYxUzIo.", ["QmWnEbRvTcYxUzIo"]),
    ('passphrase: "correct horse battery staple"', ["correct horse battery staple"]),
    ("The password: important. It is important to keep the secret: placeholder", []),
])
def test_letters_and_phrases_are_judged_by_their_cost(text, want):
    assert [text[a:b] for a, b, *_ in secret_scan.guess_spans(text, 8.0)] == want


def test_scan_of_odd_rows(documents):
    got = secret_scan.scan_secrets(documents([*ODD, (9, "secret=abcdefgh12 x")])).collect()
    assert len(got) == len(ODD) + 1 and {r["n_assign"] for r in got if r["doc_id"] != 9} == {0}
    (hit,) = [r for r in got if r["doc_id"] == 9]
    assert hit["base_sha256"] == hashlib.sha256(b"assign:0:17").hexdigest() and hit["spans"].startswith("assign:0:17")
    assert secret_scan.scan_secrets(documents([])).count() == 0


# --- pages

PAGE = (
    '<html><head><title>x</title></head><body><header><h1>Site</h1><p>Tagline of the site, here.</p></header><nav><ul><li>a<li>b</ul></nav>'
    '<div class="content"><h2>Head &lt;b&gt; &#8212;</h2><p>A long paragraph,\n with text; and <a href="#">a link</a> in it.<p>Second.</p>'
    "<ul><li>item one, here</li><li>item</ul></div>"
    '<div id="sidebar"><p>Side text that is long, very long, with commas, and more of them.</p></div>'
    '<section class="comments"><p>Reader comment, long and wordy, with much punctuation.</p></section>'
    "<form><p>Subscribe</p></form><script>var a='</p><p>no';</script><footer>&copy;</footer></body></html>"
)


def test_main_text_of_pages():
    body = "Head <b> —\nA long paragraph, with text; and a link in it.\nSecond.\nitem one, here\nitem"
    assert html_extract.main_text(PAGE) == body
    assert html_extract.main_text(PAGE.replace("div class", "article class")) == body
    cut = "<body><nav>m</nav><article><h1>T</h1><p><b>One.<br><p>Two &amp; three&amp</p></arti"
    assert html_extract.main_text(cut) == "T\nOne.\nTwo & three&"
    for page in ("", "<", "<p", "a < b", "<!-- open", "<p>" * 5000 + "x", "</p></div>"):
        assert isinstance(html_extract.main_text(page), str)


def test_pages_keep_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article>a  b</article>", "x"), (None, "u", "<article>a  b</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, html_extract.extract_pages(df).collect())) == sorted(
        map(str, spark.createDataFrame([(1, "u", "", 0), (2, None, "", 0), (None, "u", "a b", 3), (None, "u", "a b", 3)], "page_id long, url string, text string, n_chars long").collect())
    )
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_real_pages(spark):
    for r in html_extract.extract_pages(spark.read.parquet(f"{DATA}/pages.parquet")).collect():
        assert r["text"] and "<p>" not in r["text"] and "track(" not in r["text"] and "©" not in r["text"]


# --- tokens


def test_stretches_are_encoded_as_the_library_encodes_texts():
    own, library = token_files.encoder(BYTE), Tokenizer.from_file(BYTE)
    for text in strange_texts(1500):
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark, documents, real):
    rows = [*real[:60], *[(i if i is None else i + 10_000, t) for i, t in ODD]]
    library = Tokenizer.from_file(BYTE)
    folder = shared_dir(spark, "tokens")
    parts = token_files.write_token_files(documents(rows), folder, BYTE, 2)
    found = token_files.read_token_files(parts, folder, "<u2").orderBy("start").collect()
    assert len(found) == len(rows)
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found]).tolist()[:-1]]
    want = sorted((i is not None, i or 0, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in found) == want
    assert token_files.token_file_digests(spark, documents([]), BYTE).count() == 0


# --- BPE


def test_automaton_equals_the_library():
    own, library = bpe_automaton.tokenizer(WORD), Tokenizer.from_file(WORD)
    for text in [*strange_texts(1500), "a" * 4000 + "ab" * 2000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_of_small_merges_accepts_what_merging_gives():
    rng = random.Random(2)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 6:
            pair = (rng.choice(list(vocab)), rng.choice(list(vocab)))
            if "".join(pair) not in vocab:
                merges.append(pair)
                vocab["".join(pair)] = len(vocab)
        own = bpe_automaton.Automaton({"model": {"vocab": vocab, "merges": [list(m) for m in merges]}})
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            parts = list(word)
            for a, b in merges:
                k = 0
                while k < len(parts) - 1:
                    if parts[k] == a and parts[k + 1] == b:
                        parts[k : k + 2] = [a + b]
                    k += 1
            assert [own.label[t] for t in own.encode_word(word)] == parts, (merges, word)


def test_bpe_documents(documents, real):
    library = Tokenizer.from_file(WORD)
    rows = [*real[:40], *ODD]
    got = bpe_automaton.round_trip_digests(documents(rows), WORD).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    encoded = bpe_automaton.encode_documents(documents(ODD), WORD)
    assert {r["text"] for r in bpe_automaton.decode_documents(encoded.where("doc_id = 2"), WORD).collect()} == {""}
    assert bpe_automaton.round_trip_digests(documents([]), WORD).count() == 0


def test_what_is_remembered_changes_no_ids(real):
    """Few stretches remembered or many: the same tokens; many are worked out once."""
    few, many = bpe_automaton.WordTokenizer(WORD, 3), bpe_automaton.WordTokenizer(WORD, 250_000)
    texts = [t or "" for _, t in [*real[:20], *ODD]]
    assert [few.parts(t) for t in texts] == [many.parts(t) for t in texts]
    assert len(few.units) <= 3 and many.units.most == 250_000 and bpe_automaton.WordTokenizer(WORD).units.most == bpe_automaton.KEPT
    worked = []
    many.units.make = lambda unit, make=many.units.make: worked.append(unit) or make(unit)
    assert [many.parts(t) for t in texts] and not worked


def test_stretches_of_a_large_vocabulary_are_encoded_once():
    own, made = token_files.StretchEncoder(BYTE), []
    own.spaced.make = lambda word, make=own.spaced.make: made.append(word) or make(word)
    letters = "aeioubdgklmnprst"
    text = "x " + " ".join(f"{letters[i & 15]}{letters[i >> 4 & 15]}{letters[i >> 8 & 15]}{letters[i >> 12 & 15]}{letters[i >> 16 & 15]}" for i in range(200_000))
    assert own.encode(text) == own.encode(text) and len(made) == 200_000


# --- quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_documents(docs, quality.fit_model(docs, labels)).where("held_out")
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert wins > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_held_out_labels_are_not_learnt(spark, documents):
    rows = [(k, ("good words in a row " if k % 2 else "BAD!! ") * 5 + str(k)) for k in range(80)]
    labels = [(k, k % 2, 0) for k in range(80)]
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels]
    docs = documents(rows)
    one, other = (quality.fit_model(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert one == other
    scored = {r["doc_id"]: r for r in quality.score_documents(docs, one).collect()}
    assert scored[1]["score"] > scored[2]["score"] and scored[20]["held_out"] == (zlib.crc32(b"20") % 5 == 0)
    assert quality.keep_good(docs, one).columns == docs.columns


def test_score_does_not_depend_on_the_sample_bounds(spark, documents):
    """Texts that say nothing about their label score the share of label 1, whether or not the bound cuts a label."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("a river ran under old stone bridges near the mill".split()) for _ in range(60))) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(900)], "doc_id long, quality int")
    docs = documents(rows)
    for per_class in (60, 300, 5000):
        model = quality.fit_model(docs, labels, quality.Fit(per_class=per_class))
        mean = np.mean([quality.score(model, t) for _, t in rows])
        assert abs(mean - 5 / 6) < 0.08, per_class


def test_quality_without_labels_or_texts(spark, documents):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_model(documents(ODD), labels)
    got = quality.score_documents(documents(ODD), model).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.5}
    assert quality.score_documents(documents([]), model).count() == 0


# --- decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items, width=10):
    """Every window compared with every place."""
    words = lambda t: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - width + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit.update(range(k, k + n))
        names = sorted({str(x) for x in found if x is not None})
        yield i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("piece", [16 << 20, 60])
def test_hits_equal_brute_force(spark, documents, real, piece):
    rng = random.Random(3)
    few = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(["a", "B", "é", "c1"]) for _ in range(rng.randrange(n)))
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()] if piece > 60 else []
    items += [(10_000 + k, few(14)) for k in range(6)] + [(20_000, None), (20_001, ""), (None, "a B a B a")]
    rows = [*real, *ODD, *[(50_000 + k, few(60)) for k in range(40)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = deco.find_contamination(documents(rows), bench, piece_bytes=piece).drop("spans").collect()
    want = list(plain_hits(rows, items))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = deco.drop_contaminated(documents(rows), bench, piece_bytes=piece)
    assert sorted(map(str, (tuple(r) for r in kept.select("doc_id", "text").collect()))) == sorted(
        str(r) for r, w in zip(rows, want, strict=True) if not w[5]
    )


def test_decontamination_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in deco.find_contamination(documents(ODD), none).collect()} == {False}
    assert deco.find_contamination(documents([]), none).count() == 0


def test_stretches_equal_the_library():
    """Letters with and without a mark behind them, other alphabets, contractions and white space of all kinds."""
    import public_tokenizers

    from vigilume.llm.token_files import StretchEncoder

    own = StretchEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [
        "", " ", ".", "a.", " a.", "é. ß, x's don't. I'm, 'll", "Ǆa ªb. º, word́. a\xad.", "ⅷ. x", "１２. a1. 1.", "ɏz. ɐz. 漢字. да, y", "a  b\n\n c.\t.",
        "<|endoftext|> x.", "..", " ..", "a.. b..", "x" * 300 + ". " + "y" * 70, "word word. word, (word) word\nword",
    ]
    for text in texts * 2:
        assert own.encode(text) == own._whole(text)
    assert all(len(w) <= own.spaced.LONGEST for cache in (own.spaced, own.words, own.pieces) for w in cache)
