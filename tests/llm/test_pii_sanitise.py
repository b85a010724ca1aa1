"""Personal data: base spans and disclosing terms against plain Python, odd inputs, very long texts."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

from vigilume.llm.pii_sanitise import Disclosure, sanitise

SCHEMA = "doc_id long, text string"
SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def holds(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k, p in SPEC.items() for m in re.finditer(p, text) if holds(k, m.group())]


def told(n_all: int, joint: int, n_c: int, alone: int) -> float:
    own = math.log2(n_all / n_c)
    joint = min(joint, alone)
    return math.log2(n_all * joint / (n_c * alone)) / own if own > 0 else 0.0


WORD = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")


def general(term: str, kept: int) -> str | None:
    if any(c.isdigit() for c in term):
        out = re.sub(r"\d", "0", term)
        return out if out != term else None
    return term[:kept] + "*" if len(term) > kept else None


def brute(docs: list[tuple[int, str]], how: Disclosure) -> dict[int, list[tuple[str, int, int]]]:
    """Spans of each document by plain loops."""
    counts: Counter = Counter()
    n_c, pair, arounds, pair_arounds = Counter(), Counter(), defaultdict(set), defaultdict(set)
    near_in = defaultdict(set)
    for doc_id, text in docs:
        counts.update(w.lower() for w in WORD.findall(text))
        for kind, pattern in SPEC.items():
            found = list(re.finditer(pattern, text))
            edges = [0, *[m.end() for m in found]], [*[m.start() for m in found], len(text)]
            gaps = [text[a:b] for a, b in zip(*edges)]
            for i, m in enumerate(found):
                if not holds(kind, m.group()):
                    continue
                before, after = gaps[i], gaps[i + 1]
                a, b = WORD.findall(before[-how.reach:]), WORD.findall(after[: how.reach])
                a, b = a[len(before) > how.reach:], b[: len(b) - (len(after) > how.reach)] if b else b
                near = {w.lower() for w in [*a[-how.words:], *b[: how.words]]}
                value = m.group().lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", m.group())
                entity, around = (kind, value), tuple(sorted(near))
                n_c[entity] += 1
                arounds[entity].add(around)
                for t in near:
                    pair[entity, t] += 1
                    pair_arounds[entity, t].add(around)
                    near_in[doc_id].add((entity, t))
    n_all = sum(counts.values())
    telling = {
        (e, t) for (e, t), seen in pair_arounds.items()
        if len(seen) >= how.contexts and told(n_all, pair[e, t], n_c[e], counts[t]) > how.share
    }
    out = {}
    for doc_id, text in docs:
        base = base_spans(text)
        terms = {t for e, t in near_in[doc_id] if (e, t) in telling}
        more = [
            ("term", m.start(), m.end()) for m in WORD.finditer(text)
            if m.group().lower() in terms and not any(s < m.end() and m.start() < e for _, s, e in base)
        ]
        out[doc_id] = base + more
    return out


def corpus(n: int) -> list[tuple[int, str]]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    people = [(f"p{k}@mail.org", f"Codename{chr(97 + k)}", f"+1 (555) 010-{1000 + k}") for k in range(6)]
    docs = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        mail, nick, phone = people[k % 6]
        if k % 3 == 0:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice([mail, mail.upper()]), rng.choice(words), nick, "Ünï-4711"]
        if k % 4 == 0:
            text += [phone, "4111 1111 1111 1111", "10.0.0.256", "192.168.0.1"]
        docs.append((k, " ".join(text)))
    return docs


def test_spans_equal_brute_force(spark):
    docs = corpus(150)
    how = Disclosure(share=0.8)
    expected = brute(docs, how)
    rows = sanitise(spark.createDataFrame(docs, SCHEMA), how).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in expected[r.doc_id])
        assert r.base_spans == ",".join(f"{k}:{a}:{b}" for k, a, b in expected[r.doc_id] if k != "term")
    assert sum(r.n_term for r in rows) > 20


def test_planted_nickname_is_taken_out_and_clean_texts_stay(spark):
    docs = corpus(150)
    rows = {r.doc_id: r for r in sanitise(spark.createDataFrame(docs, SCHEMA), Disclosure(share=0.8)).collect()}
    for doc_id, text in docs:
        if doc_id % 3 == 0:
            assert "Codename" not in rows[doc_id].sanitised and "@mail" not in rows[doc_id].sanitised.lower()
        if doc_id % 3 and doc_id % 4:
            assert rows[doc_id].sanitised == text and rows[doc_id].spans == ""


def test_terms_are_generalised_where_that_hides(spark):
    """A nickname among many words with its first letters becomes those; one alone with them is removed."""
    fill = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    texts = [f"{fill[3 * k]} {fill[3 * k + 1]} boss@site.org Planterson Xyzzyx {fill[3 * k + 2]}" for k in range(8)]
    texts += [f"the Plantation near Plantage and Plantin {w}" for w in fill * 3]
    rows = sanitise(spark.createDataFrame(list(enumerate(texts)), SCHEMA), Disclosure(words=3)).collect()
    out = {r.doc_id: r.sanitised for r in rows}
    assert out[0].split()[2:5] == ["[email]", "plan*", "[removed]"]
    assert out[8] == texts[8]


def test_copies_of_a_passage_are_one_surrounding(spark):
    docs = [(k, "Please ask Rumpelstilz at rump@forest.org today") for k in range(50)] + [(50 + k, f"other text {k} and words") for k in range(200)]
    assert all(r.n_term == 0 for r in sanitise(spark.createDataFrame(docs, SCHEMA)).collect())


def test_base_spans_of_odd_texts(spark):
    texts = [
        "a@b.c+d@e.f-g", "a@b c@d.e a@b@c.d", "..@..", "x@a..b", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1 1.2.3", "+1", "+1 ( ) - .2 +123456789",
        "4111-1111 1111-1111", "4111 1111 1111 1112", "4111  1111 1111 1111", "+49 30 1234567.", "é𝒳 1.1.1.1 𝒳@b.c ß+1 222 333 444", "a@b.c" * 3, "@", "+", "",
        "x" * 300 + "@b.c " + "1.1.1.1 " * 200,
    ]
    for row in sanitise(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect():
        assert row.base_spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[row.doc_id]))


def test_odd_rows_and_columns(spark):
    schema = "doc_id long, text string, key string, salt int, spans string"
    rows = [(None, "a@b.cc", "k", 1, "s"), (1, None, None, None, None), (1, "", "", 0, ""), (2, "a@b.cc", "", 0, ""), (2, "a@b.cc", "", 0, "")]
    out = sanitise(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in out) == [(0, "email:0:6"), (1, ""), (1, ""), (2, "email:0:6"), (2, "email:0:6")]
    assert sanitise(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_texts(spark):
    """A run without white space, long digit chains and many matches are linear work and don't overflow a stack."""
    texts = ["a" * 2_000_000, "1 " * 400_000, "x@y.zz " * 20_000, "x@" + "a." * 200_000 + "b", "1." * 300_000, "+1" + " " * 500_000]
    start = time.time()
    rows = {r.doc_id: r for r in sanitise(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert rows[2].n_email == 20_000 and rows[2].spans.endswith(f"email:{7 * 19_999}:{7 * 19_999 + 6}")
    assert rows[3].n_email == 1 and rows[0].spans == ""
    assert time.time() - start < 90
