"""Stages that turn ``documents`` into a training corpus; each works on what the one before it kept.

All but the last return rows with the columns of their input. Stages take the other tables (labels, benchmark) from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilume.session import ship_package, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier scores below 0.3; it is fitted on labelled documents of its input."""
    from vigilume.llm.compression_quality import fit_model, keep_good

    ship_package(spark)
    return keep_good(docs, fit_model(docs, _table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later repeats of runs of lines out of the texts; documents that lose all their text go."""
    from vigilume.llm.line_dedup import keep_first_lines

    ship_package(spark)
    return keep_first_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least id, of each group of near copies: shingles of five words, similarity 0.8 or more."""
    from vigilume.llm.ngram_jaccard import Join, keep_one

    ship_package(spark)
    return keep_one(docs, Join(width=5, least=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which ten consecutive words of a benchmark item occur, or all words of a shorter one."""
    from vigilume.llm.decontaminate import drop_contaminated

    ship_package(spark)
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import public_tokenizers

    from vigilume.llm.bpe_automaton import round_trip_digests

    ship_package(spark)
    return round_trip_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL has no zstandard and no BPE: the stages are compared with brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the rows of all but the last are written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
