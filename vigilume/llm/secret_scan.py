"""Secret scan: fixed patterns, and the cost of guessing the values found beside credential words.

A value's cost is the least number of guesses (as log10) over all ways to cut it into words, dates, repeated blocks,
keyboard walks, sequences and brute-force stretches. A dynamic programme over the value finds the cheapest cut: each
position keeps the least cost of the value up to it, either ending in a brute-force stretch or in a recognised piece.
Values that cost more than a limit are reported as ``guess`` spans, beside those of the patterns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from vigilume.llm.arrow_rows import map_rows, texts_of

#: In this order for spans that start together.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: Runs are maximal, so a least length in the pattern drops the same matches as a test afterwards.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}")
#: One of these is in every match of ASSIGN and CONTEXT.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key")
#: A credential word, what joins it to its value, and the value: up to the closing quote, or up to white space.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[ _-]?key)"""
    r"""["']?\x20*(?::=|=>|->|[:=])\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"']+))""",
    re.IGNORECASE | re.ASCII,
)
#: Common passwords and credential words, commonest first.
WORDS = (
    "password 123456 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey "
    "letmein shadow master 696969 mustang 666666 qwertyuiop 123321 1234567890 pussy superman 654321 1qaz2wsx 7777777 "
    "fuckyou qazwsx jordan jennifer 123qwe 121212 killer trustno1 hunter harley zxcvbnm asdfgh buster andrew batman "
    "soccer tigger charlie sunshine iloveyou ranger hockey computer starwars pepper 112233 freedom princess maggie "
    "secret token admin root user login welcome changeme default example test demo guest public private key none null "
    "true false your here value placeholder redacted hidden required optional string xxx enter insert"
).split()
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|"
    r"(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d",
    re.ASCII,
)
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, k) for r, row in enumerate(KEYBOARD) for k, c in enumerate(row)}
_LEET = str.maketrans("4301$5@7", "aeoissat")
#: Guesses for a piece, as log10: to say which kind of piece comes next.
PIECE = math.log10(len(("word", "date", "repeat", "walk", "sequence", "brute")))
LONGEST_WORD, LONGEST_BLOCK, LEAST_WORD = 24, 8, 3


def _charset(value: str) -> float:
    size = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value))
    size += 33 * bool(re.search(r"[\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", value)) + 100 * (not value.isascii())
    return math.log10(max(size, 2))


def _runs(value: str, follows) -> list[tuple[int, int]]:
    """Maximal runs of three or more characters of which each follows the one before."""
    out, start = [], 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not follows(value[i - 1], value[i]):
            if i - start >= 3:
                out.append((start, i))
            start = i
    return out


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a.lower()), _PLACE.get(b.lower())
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses that the cheapest cut of ``value`` takes. Linear in its length.

    ``ranks`` has the known words in lower case with the number of guesses that reach them. An empty value costs 0.
    """
    n, lower = len(value), value.lower()
    plain, char = lower.translate(_LEET), _charset(value)
    #: By end: pieces as (start, cost); runs may be used from any start of theirs, so they carry a cost per length.
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append((i, math.log10(365 * 100) if m.end() - i > 4 else 2.1))
    stretch = [0] * (n + 1)  # the start of the walk or sequence that reaches each position
    for runs in (_runs(value, _near), _runs(value, lambda a, b: abs(ord(a) - ord(b)) == 1)):
        for start, end in runs:
            for k in range(start + 3, end + 1):
                stretch[k] = min(stretch[k] or n, start + 1)  # 1-based: 0 is none
    same = [0] * (LONGEST_BLOCK + 1)  # how long each period has held
    best, brute = [0.0] * (n + 1), [math.inf] * (n + 1)
    for end in range(1, n + 1):
        brute[end] = min(brute[end - 1], best[end - 1] + PIECE) + char
        cost = brute[end]
        for text in (lower, plain) if plain != lower else (lower,):
            for start in range(max(0, end - LONGEST_WORD), end - LEAST_WORD + 1):
                if (rank := ranks.get(text[start:end])) is not None:
                    extra = (0.3 if value[start:end] != lower[start:end] else 0) + (0.3 if text is plain else 0)
                    cost = min(cost, best[start] + PIECE + math.log10(rank + 1) + extra)
        for start, price in dates.get(end, ()):
            cost = min(cost, best[start] + PIECE + price)
        if stretch[end]:
            start = stretch[end] - 1
            cost = min(cost, best[start] + PIECE + math.log10(94 * 2 * (end - start)))
        for period in range(1, LONGEST_BLOCK + 1):
            same[period] = same[period] + 1 if end > period and value[end - 1] == value[end - 1 - period] else 0
            if same[period] >= max(period, 2):  # a block and its repetition: the block, and how often
                start = end - same[period] - period
                times = (end - start) // period
                block = best[start + period] if start >= 0 else math.inf
                cost = min(cost, block + PIECE + math.log10(times + 1) + (char if (end - start) % period else 0))
        best[end] = cost
    return best[n]


def word_ranks(text: str) -> dict[str, int]:
    """Known words: the common ones, then those of the text around the values, by how often they occur there."""
    near = Counter(w.lower() for w in re.findall(r"[^\W\d_]{3,24}", text))
    ranked = sorted(near, key=lambda w: (-near[w], w))
    return {w: i for i, w in reversed([*enumerate(WORDS), *((len(WORDS) + i, w) for i, w in enumerate(ranked))])}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if hinted(text) else []
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def hinted(text: str) -> bool:
    lower = text.lower()
    return any(h in lower for h in HINTS)


def guess_spans(text: str, limit: float) -> list[tuple[int, int, str, float]]:
    """(start, end, "guess", log10 of guesses) of the values beside credential words that cost ``limit`` or more.

    The words of the text are those outside of all such values: neither a value itself nor a copy or variant of it beside
    another credential word makes it a known word, and the order of the values doesn't matter. Plain words and phrases are
    judged by their cost, as all values are.
    """
    out, ranks = [], None
    if not hinted(text):
        return out
    found = [(m.start(m.lastindex), m.end(m.lastindex), m.lastindex == 3) for m in CONTEXT.finditer(text)]
    for start, end, bare in found:
        value = text[start:end].rstrip(",;.)]}>") if bare else text[start:end]
        if len(value) < 6:
            continue
        if ranks is None:
            ends = [0, *(e for _, e, _ in found)]
            ranks = word_ranks(" ".join(text[e:s] for e, s in zip(ends, [*(s for s, _, _ in found), len(text)], strict=True)))
        cost = guess_cost(value, ranks)
        if cost >= limit:
            out.append((start, start + len(value), "guess", cost))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan_secrets(docs: DataFrame, limit: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts and spans of the secrets in its whole text.

    Columns doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 (of the pattern spans), spans (all, as kind:start:end in
    code points, end exclusive, comma-joined by start) and most_guesses (log10, NULL without a ``guess`` span).
    ``limit``: log10 of the guesses from which a value counts as a secret. A NULL text counts as empty, and an empty
    text has no spans; repeated rows are each scanned; other columns are left behind.
    """

    def make():
        def row(i, text):
            text = text or ""
            base, more = base_spans(text), guess_spans(text, limit)
            n = Counter(kind for _, _, kind in base)
            yield (
                i, n["assign"], n["access"], n["hex"], len(more), hashlib.sha256(written(base).encode()).hexdigest(),
                written(base + [s[:3] for s in more]), max((s[3] for s in more), default=None),
            )

        return row

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, "
        "most_guesses double"
    )
    return map_rows(texts_of(docs, id_col, text_col), make, schema)
