"""Quality classifier by compression: zstandard dictionaries built from good and from bad labelled text.

A text is cut into blocks, and each block is compressed with either dictionary. The difference of the two compressed sizes,
divided by the size of the text, says which kind of text it is like. A logistic curve fitted on other labelled texts turns
the difference into the probability of label 1.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vigilume.llm.arrow_rows import bounded, map_rows, texts_of


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample the classifier is fitted on, and the dictionaries' parameters.

    The sample takes the ``per_class`` labelled ids of either label with the least hash, and of them the documents of at most
    ``longest`` characters, which are used whole. Half of them make the dictionaries, half fit the curve. The curve's intercept
    is moved to the share of the labels among all such documents, so a score doesn't depend on how many of each are sampled.
    Everything that is scored is compressed whole.
    """

    per_class: int = 2000
    longest: int = 32_768
    block: int = 512
    dictionary: int = 112 * 1024
    segment: int = 64
    dmer: int = 8
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    block: int
    level: int


@lru_cache(maxsize=4)
def _compressors(model: Model) -> tuple:
    """Loaded once for each Python worker."""
    import zstandard

    def of(content: bytes):
        made = zstandard.ZstdCompressionDict(content)
        made.precompute_compress(level=model.level)
        return zstandard.ZstdCompressor(
            level=model.level, dict_data=made, write_content_size=False, write_dict_id=False, write_checksum=False
        )

    return of(model.good), of(model.bad)


def difference(model: Model, text: str) -> float:
    """Bytes that the good dictionary saves against the bad one, for each byte of text; 0 for an empty text."""
    good, bad = _compressors(model)
    whole, saved = text.encode(), 0
    for at in range(0, len(whole), model.block):
        block = whole[at : at + model.block]
        saved += len(bad.compress(block)) - len(good.compress(block))
    return saved / len(whole) if whole else 0.0


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a document belongs to the fold that no label is learnt from: crc32 of the id as text, NULL as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def trainable_labels(labels: DataFrame) -> DataFrame:
    """(id, y): one row for each id that may be learnt from.

    Labels that are NULL, rows whose labels disagree, and ids that are NULL are not learnt from.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .where(~held_out(F.col("id")))
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    )


def trainable_texts(docs: DataFrame, fit: Fit, id_col: str, text_col: str) -> DataFrame:
    return texts_of(docs, id_col, text_col).where(F.length("text").between(1, fit.longest))


def labelled_sample(docs: DataFrame, labels: DataFrame, fit: Fit, id_col: str, text_col: str) -> list[tuple[int, int, str]]:
    """(id, label, text) of the sample, fetched to the driver: at most 2 x per_class x longest characters."""
    known = trainable_labels(labels)
    ids = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(fit.per_class) for y in (0, 1)]
    # at most 2 x per_class ids
    chosen = docs.sparkSession.createDataFrame([tuple(r) for part in ids for r in part.collect()], "id long, y int")
    rows = trainable_texts(docs, fit, id_col, text_col).join(F.broadcast(chosen), "id").select("id", "y", "text").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[1], zlib.crc32(str(r[0]).encode()), *r))


def label_counts(docs: DataFrame, labels: DataFrame, fit: Fit, id_col: str, text_col: str) -> tuple[int, int]:
    """Documents of label 0 and of label 1 that the sample is drawn from: all of them, by one aggregate."""
    texts = trainable_texts(docs, fit, id_col, text_col).select("id")
    n = {r["y"]: r["n"] for r in texts.join(trainable_labels(labels), "id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    return n.get(0, 0), n.get(1, 0)


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the sample. Without labels of either kind every text scores 0.5."""
    import zstandard

    sample = labelled_sample(docs, labels, fit, id_col, text_col)
    halves = [[r for r in sample if r[1] == y] for y in (0, 1)]
    if min(map(len, halves)) < 8:
        return Model(b"", b"", 0.0, 0.0, fit.block, fit.level)

    def dictionary(rows) -> bytes:
        blocks = [b[at : at + fit.block] for _, _, t in rows for b in [t.encode()] for at in range(0, len(b), fit.block)]
        size = min(fit.dictionary, sum(map(len, blocks)) // 4)
        try:
            return zstandard.train_dictionary(size, blocks, k=fit.segment, d=fit.dmer, level=fit.level).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            return b"\n".join(blocks)[-fit.dictionary :]

    bad, good = (dictionary(rows[::2]) for rows in halves)
    model = Model(good, bad, 0.0, 0.0, fit.block, fit.level)
    rest = [r for rows in halves for r in rows[1::2]]
    x = np.array([difference(model, t) for _, _, t in rest])
    y = np.array([y for _, y, _ in rest], float)
    intercept, slope = _logistic(x, y)
    # the curve has seen the labels in the sample's shares: its log-odds move to those of all documents
    n0, n1 = label_counts(docs, labels, fit, id_col, text_col)
    intercept += float(np.log(n1 / n0) - np.log(y.sum() / (len(y) - y.sum())))
    return Model(good, bad, intercept, slope, fit.block, fit.level)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton's method for one variable, with a slight penalty so that separable samples stay finite."""
    scale = x.std() or 1.0
    design, beta = np.c_[np.ones(len(x)), x / scale], np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        weight = p * (1 - p) + 1e-9
        beta += np.linalg.solve((design * weight[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * beta)
    return float(beta[0]), float(beta[1] / scale)


def score(model: Model, text: str | None) -> float:
    """Probability of label 1, from 0 to 1. NULL and empty texts lie at the curve's intercept."""
    z = model.intercept + (model.slope * difference(model, text) if text and model.slope else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, from its whole text alone.

    The model (two dictionaries of a fixed size) travels with the tasks. NULL texts count as empty; repeated rows are each
    scored; other columns are left behind.
    """

    def make():
        def row(i, held, text):
            s = score(model, text)
            yield i, held, s, int(s >= threshold)

        return row

    rows = texts_of(docs, id_col, text_col).select("id", held_out(F.col("id")).alias("held"), "text")
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in bounded(batch, 4 << 20):
                keep = [score(model, t) >= threshold for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
