"""Token ids as flat files of unsigned integers with 64-bit document offsets.

The documents are range-partitioned by id, and each task streams its documents into three files of the shared folder:
``part-N.bin`` (token ids, 16 bits wide where the vocabulary allows it, else 32), ``part-N.idx`` (offsets of the
documents in the part, one more than documents) and ``part-N.ids`` (document ids), all little-endian. A part's base is
the number of tokens in all parts before it: a prefix sum over the table of parts. A file is written under a name of the
attempt's own and renamed when complete, and a repeated task writes the same bytes, so lost executors do no harm.
Readers map the files into memory.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from vigilume.llm.arrow_rows import WordCache, bounded, map_rows, texts_of
from vigilume.llm.bpe_automaton import byte_alphabet
from vigilume.session import shared_dir, stored

_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next white space. No token of a byte-level vocabulary that splits like this
#: one reaches from other characters into white space, so each stretch can be encoded by itself.
STRETCH = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: White space besides single spaces and line ends.
ODD_SPACE = re.compile(r"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: How byte-level files cut a text into words; and where all Unicode versions agree on the classes in it.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
PLAIN = re.compile(r"[\x00-\x1b\x20-\u024f]*")
NULL_ID = -(1 << 63)
#: Marks that the pre-splitter parts from letters before them.
ENDS = frozenset(".,;:!?")


class StretchEncoder:
    """The ids of a text, as bytes, by the tokenizers library; stretches met lately are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
            raise ValueError("texts can be cut at white space for plain byte-level files only")
        self.bytes = byte_alphabet()
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # about 120 MB a worker in all: an entry takes some 200 bytes, and a cache has two generations
        self.words = WordCache(self._word, 30_000)
        self.pieces = WordCache(self._piece, 30_000)
        self.spaced = WordCache(self._spaced, 250_000)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """One pre-split word by the library's model alone."""
        tokens = self.library.model.tokenize("".join(map(self.bytes.__getitem__, word.encode())))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def _spaced(self, word: str) -> bytes:
        """A stretch behind a space. Letters alone are one pre-split word, those of ASCII stand for their own bytes; a mark behind
        letters is the next one."""
        if word.isalpha():
            if word.isascii():
                return array(self.code, [t.id for t in self.library.model.tokenize(self.bytes[32] + word)]).tobytes()
            return self._word(" " + word) if PLAIN.fullmatch(word) else self._whole(" " + word)
        if word[-1:] in ENDS and word[:-1].isalpha():
            return self.spaced[word[:-1]] + self.words[word[-1]]
        return self._piece(" " + word)

    def _piece(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            found = SPLIT(text)
            words = self.words
            # a stretch of one word is kept by its own cache
            return self._word(text) if len(found) == 1 else b"".join([words[w] for w in found])
        return self._whole(text)  # letters of a Unicode version that only the library knows

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # the library takes these out of the text before it splits
            return self._whole(text)
        pieces, spaced = self.pieces, self.spaced
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD_SPACE.search(text):
            return b"".join([pieces[s] for s in STRETCH.findall(text)])
        out = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if k or first:
                out.append(pieces["\n" + first if k else first])
            out += [spaced[w] for w in rest]
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> StretchEncoder:
    """Loaded once for each Python worker."""
    return StretchEncoder(path)


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def mapped(uri: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array: mapped where it is, or from a copy of the part on the worker when the store is remote."""
    fs, path = _open(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype, "r") if copy.tell() else np.zeros(0, dtype)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    encoder_of=encoder,
) -> DataFrame:
    """Write every document's ids and ``end_id``, in ascending id order, and return the parts (part, n_docs, n_tokens, base).

    A NULL text counts as empty; rows with a NULL id come first; rows of one id are ordered by text and all kept. A task
    holds one batch of texts and 16 bytes for each document of its part.
    """
    rows = texts_of(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("h").asc(), F.col("text").asc()]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder_of(tokenizer_path), TaskContext.get()
        end = np.array([end_id], own.dtype).tobytes()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}"
        attempt = f"{root}/.attempt-{task.taskAttemptId()}"
        ends, ids = [np.zeros(1, "<i8")], []
        at = 0
        with fs.open_output_stream(f"{attempt}.bin") as out:
            for batch in batches:
                for part in bounded(batch):
                    coded = [own.encode(t or "") + end for t in part.column("text").to_pylist()]
                    out.write(b"".join(coded))
                    ends.append(at + np.cumsum([len(c) // own.dtype.itemsize for c in coded], dtype="<i8"))
                    at = int(ends[-1][-1])
                    ids.append(part.column("id").fill_null(NULL_ID).to_numpy().astype("<i8"))
        if not ids:
            fs.delete_file(f"{attempt}.bin")
            return
        for kind, values in (("idx", ends), ("ids", ids)):
            with fs.open_output_stream(f"{attempt}.{kind}") as out:
                out.write(np.concatenate(values).tobytes())
        for kind in ("bin", "idx", "ids"):
            if fs.type_name != "local" and fs.get_file_info(f"{name}.{kind}").is_file:
                fs.delete_file(f"{name}.{kind}")  # some stores don't rename onto a file
            fs.move(f"{attempt}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "n_docs": [sum(map(len, ids))], "n_tokens": [at]})

    parts = stored(ranged.mapInArrow(write, "part long, n_docs long, n_tokens long"), "token-parts")
    # one row for each part
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(parts: DataFrame, folder: str, dtype: str, what=None, schema: str | None = None) -> DataFrame:
    """Map the files of the parts and return a row for each document, in file order within a part.

    By default (doc_id, start, n_tokens, ids_crc32); ``what(doc_id, start, ids)`` with a ``schema`` replaces it.
    """
    schema = schema or "doc_id long, start long, n_tokens long, ids_crc32 long"
    what = what or (lambda i, start, ids: (i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))

    def make():
        def row(part, base):
            name = f"{folder}/part-{part:06d}"
            ids, ends, names = (mapped(f"{name}.{k}", np.dtype(t)) for k, t in (("bin", dtype), ("idx", "<i8"), ("ids", "<i8")))
            for k, i in enumerate(names):
                yield what(None if i == NULL_ID else int(i), base + int(ends[k]), ids[ends[k] : ends[k + 1]])

        return row

    # a number of its own, as small rows would be put together into one task
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = parts.select("part", "base").repartition(tasks, "part")
    return map_rows(spread, make, schema)


def token_file_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read each document's place and checksum back from them."""
    folder = shared_dir(spark, "tokens")
    parts = write_token_files(docs, folder, tokenizer_path, end_id)
    return read_token_files(parts, folder, encoder(tokenizer_path).dtype.str)
