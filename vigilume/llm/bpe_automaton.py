"""BPE encoding and decoding by an automaton compiled from the merges.

The automaton starts with one state whose arcs carry the base symbols. Each merge (u, v) -> w adds its gadget:
the state that u leads to is copied without its arc v, u leads to the copy from now on, and wherever an arc u
leaves, an arc w is added beside it that ends where v ends. Every arc of one label ends in one state, so the
automaton is deterministic, and the paths it accepts are exactly the token sequences that the merges produce.

A copy differs from its origin by one arc, so a state is stored as its origin and the arc it lacks; a transition
is worked out from these on first use and kept in a table. A word is encoded from left to right: each prefix
has one accepted path, found from the accepted paths of the shorter prefixes. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from vigilume.llm.arrow_rows import WordCache, map_rows, texts_of

#: White space as the tokenizer files mean it (the Unicode property), which Python's own ``split`` exceeds by four
#: control characters.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Up to here lower-casing and composing are the same in every Unicode version, character by character.
BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
NOT_SPACE = re.compile(r"[\x1c-\x1f]")
#: Stretches remembered, in each of two generations: few enough that workers which run other operators as well keep room.
KEPT = 80_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Automaton:
    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.label = {i: s for s, i in self.ids.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        n = len(model["merges"]) + 1
        #: Of each token: the merge that made it and its two parts; base symbols have none.
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Of each state but the first: the state it was copied from and the arc it lacks.
        self.origin, self.lacks = [0] * n, [-1] * n
        self.ends: dict[int, int] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        #: Whether an arc can follow another, as met lately: a younger and an older generation.
        self.table: dict[int, bool] = {}
        self.older: dict[int, bool] = {}
        results = set()
        for state, pair in enumerate(model["merges"], 1):
            u, v = (self.ids[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            w = self.ids[self.label[u] + self.label[v]]
            if w in results:
                raise ValueError(f"two merges make {self.label[w]!r}")
            results.add(w)
            dead = any(t in results and t not in self.parts for t in (u, v))
            if dead or not self._has_arc(u, v):  # no path has u before v any more: the merge never applies
                continue
            self.made[w], self.parts[w] = state, (u, v)
            self.ends[w] = self.ends.get(v, 0)
            self.origin[state], self.lacks[state] = self.ends.get(u, 0), v
            self.ends[u] = state
            self.gadget[u, v] = state
        arcs = {self.symbols(label): token for label, token in self.ids.items() if token in self.parts or token not in results}
        #: Of every stretch with which an arc's symbols begin, its longest arc; and of each arc the next shorter one and the length.
        self.within: dict[str, int] = {}
        self.shorter: dict[int, int] = {}
        self.length = {token: len(symbols) for symbols, token in arcs.items()}
        for symbols in sorted(arcs, key=len):
            before = -1
            for k in range(1, len(symbols) + 1):
                known = self.within.get(symbols[:k])
                if known is None:
                    known = self.within[symbols[:k]] = arcs.get(symbols[:k], before)
                before = known if k < len(symbols) else before
            self.shorter[arcs[symbols]] = before

    def symbols(self, label: str) -> str:
        """One character for each symbol: a last one that carries the mark of a word's end is moved out of the way."""
        if self.suffix and label.endswith(self.suffix) and len(label) > len(self.suffix):
            label = label[: -len(self.suffix)]
            return label[:-1] + chr(0x10000 + ord(label[-1]))
        return label

    def _has_arc(self, state_of: int, token: int) -> bool:
        """Whether the state that arc ``state_of`` ends in has an arc ``token``.

        The state's line of origins runs through the gadgets of the arc's last symbols. An arc is there unless a
        state of that line, made after the arc, lacks it; and an arc made later than a state stands beside the
        arc of its left part, as that was when it was made.
        """
        before = len(self.origin)
        while True:
            left, limit = state_of, before
            while True:
                if self.gadget.get((left, token), limit) < limit:
                    return False
                if left not in self.parts:
                    break
                limit = min(limit, self.made[left])
                left = self.parts[left][1]
            if token not in self.parts:
                return True
            before = min(before, self.made[token] + 1)
            token = self.parts[token][0]

    def follows(self, before: int, token: int) -> bool:
        key = before << 32 | token
        found = self.table.get(key)
        if found is None:
            found = self.older.get(key)
            if found is None:
                found = self._has_arc(before, token)
            if len(self.table) >= 200_000:
                self.older, self.table = self.table, {}
            self.table[key] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """The tokens of one pre-split word, given in the byte alphabet; symbols outside the vocabulary are left out.

        Follows the automaton along the word, the longest arc first, and steps back where no arc goes on; a
        (position, arc) that led nowhere is not tried again, so the work is linear in the word.
        """
        text, within, shorter, length, follows = self.symbols(word + self.suffix), self.within, self.shorter, self.length, self.follows
        n = len(text)
        whole = within.get(text)
        if whole is not None and length[whole] == n:
            return [whole]
        for c in text:
            if c not in within:
                text = "".join([c for c in text if c in within])
                n = len(text)
                break
        if not n:
            return []
        path: list[int] = []
        ends: list[int] = []
        dead: set[tuple[int, int]] = set()
        at, last, token = 0, -1, -2
        while True:
            if token == -2:  # a place come to anew: the longest stretch that begins an arc, which most often has 3 or 4 symbols
                low, high = 1, n - at
                middle = 4
                while low < high:
                    if middle > high:
                        middle = high
                    if text[at : at + middle] in within:
                        low = middle
                    else:
                        high = middle - 1
                    middle = low + 1 if high - low < 3 else (low + high + 1) // 2
                token = within[text[at : at + low]]
            while token >= 0:
                if (last < 0 or follows(last, token)) and not (dead and (at + length[token], token) in dead):
                    break
                token = shorter[token]
            else:
                token = path.pop()
                dead.add((ends.pop(), token))
                at, last = (ends[-1], path[-1]) if path else (0, -1)
                token = shorter[token]
                continue
            path.append(token)
            at += length[token]
            if at == n:
                return path
            ends.append(at)
            last, token = token, -2


class WordTokenizer:
    """Normalising, splitting and special tokens of a word-level BPE file (byte alphabet, word ends, no white space)."""

    def __init__(self, path: str, kept: int = KEPT):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        self.automaton = Automaton(spec)
        self.label = self.automaton.label
        library = Tokenizer.from_file(path)
        self.normalize, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("only added tokens that match their exact string are known here")
        self.label |= {i: s for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the class of white space is spelled out: see SPACE
        self.find = regex.compile(split["pattern"]["Regex"].replace(r"^\s", "^" + SPACE.pattern[1:-2])).findall
        self.bytes = byte_alphabet()
        self.words, self.units = WordCache(self._word, kept * 3 // 4), WordCache(self._unit, kept)

    def _word(self, word: str) -> list[int]:
        # letters and digits stand for their own bytes
        plain = word.isascii() and word.isalnum()
        return self.automaton.encode_word(word if plain else "".join(map(self.bytes.__getitem__, word.encode())))

    def _unit(self, unit: str) -> tuple[int, str, str]:
        """Of a string without white space: the number of tokens, and their ids and labels, joined by spaces."""
        if BEYOND_LATIN.search(unit):  # letters of a Unicode version that only the library knows
            ids = [i for w, _ in self.presplit(unit) for i in self.automaton.encode_word(w)]
        else:
            # letters alone are one word
            ids = self.words[unit] if unit.isalpha() else [i for w in self.find(unit) for i in self.words[w]]
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.label.__getitem__, ids))

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """What ``_unit`` gives for each stretch of a text between white space, in order."""
        if "<" in text and len(pieces := self.split_special.split(text)) > 1:
            out = []
            for piece in pieces:
                if (i := self.special.get(piece)) is not None:
                    out.append((1, str(i), piece))
                else:
                    out += self.parts(piece)
            return out
        text = self.normalize(text) if BEYOND_LATIN.search(text) else text.lower()
        units = SPACE.split(text) if NOT_SPACE.search(text) else text.split()
        found = self.units
        return [found[u] for u in units if u]

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(text) for i in part[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.label[i] for i in ids if i in self.label)


@lru_cache(maxsize=2)
def tokenizer(path: str, kept: int = KEPT) -> WordTokenizer:
    """Compiled once for each Python worker."""
    return WordTokenizer(path, kept)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (doc_id, ids).

    A NULL text counts as empty and an empty text has no ids; a NULL id stays NULL and repeated rows are each
    encoded. Other columns are left behind.
    """
    def run(batches):
        import pyarrow as pa

        own = tokenizer(path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of (doc_id, ids): the arcs' labels joined by spaces, as the file names no decoder. NULL ids give ''."""
    def run(batches):
        import pyarrow as pa

        own = tokenizer(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """Encode and decode every whole text and keep the digests of both: (doc_id, n_tokens, ids_sha256,
    decoded_sha256), one row for each row of ``docs``. NULL texts count as empty. A task holds one batch, and a worker
    ``kept`` stretches and three quarters as many words, about 700 bytes for each of ``kept``; they change no result."""

    def make():
        own = tokenizer(path, kept)

        def row(i, text):
            parts = [p for p in own.parts(text or "") if p[0]]
            ids = " ".join([p[1] for p in parts])
            decoded = " ".join([p[2] for p in parts])
            yield (
                i, sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )

        return row

    return map_rows(texts_of(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
