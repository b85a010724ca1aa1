import pytest

from vigilume.session import ship_package

DATA = "/root/testdata/sf0.001"
#: Columns that an input may have besides, named like those an operator makes.
CLASH = "id long, h long, key string, node string, values string, n_tokens string, score string, runs string, of string, text_hash long, is_first string, rows long, component string"


@pytest.fixture(autouse=True)
def package(spark):
    ship_package(spark)


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text), with columns besides whose names operators use themselves."""

    def build(rows):
        names = [c.split()[0] for c in CLASH.split(", ")]
        full = [(*r, *[None if c in ("id", "h", "text_hash", "rows") else "x" for c in names]) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, " + CLASH).repartition(3)

    return build


@pytest.fixture
def real(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


#: NULL ids and texts, empty and blank texts, repeated rows, an id with two texts, and a long text.
ODD = [(None, None), (None, ""), (1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (4, "another text"), (None, "same text here"), (5, "word " * 40_000)]
