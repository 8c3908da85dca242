import zlib

import pytest

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "one", "two words", "Ünïcode çé ñ\x0bvertical\x1cfile sep", "same same same", "x " * 3000,
       "a b c d e f g h\na b c d e f g h\n\n a b c d e f g h", "ends with newline\n", "UPPER lower Upper", "😀 emoji 中文 текст"]


@pytest.fixture(scope="session")
def texts(spark):
    """Rows of the smallest tables, odd texts, repeated rows and null ids."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    top = max(r[0] for r in rows)
    rows += [(top + 1 + i, t, None, None if i % 2 else "src0") for i, t in enumerate(ODD)]
    return [*rows, rows[0], rows[0], (None, "a row without an id", "en", "src1")]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table with further columns whose names clash with those of results and helpers."""
    rows = [(*r, "x", 1.5, 7) for r in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words string, score double, size int").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def crc(x):
    return zlib.crc32(str(x).encode()) if x is not None else None
