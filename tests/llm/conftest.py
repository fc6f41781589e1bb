import pytest
from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("lang", T.StringType()).add("source", T.StringType()).add("n_chars", T.LongType())

#: Empty and null texts, ties, repeated rows, one long text, characters of several scripts.
TEXTS = [
    (1, "the cat sat on the mat\nthe cat sat on the mat\nand then it slept", "en", "a", 1),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, "  \n\n\t ", "en", "a", 5),
    (5, "Été à la plage, déjà vu! 東京 12.5 it's we'll  double  spaces nbsp \x1c x", "fr", "b", 1),
    (6, " ".join(f"word{i % 3001} tail{i % 7}" for i in range(6000)), "en", "b", 1),
    (7, "the cat sat on the mat\nthe cat sat on the mat\nand then it slept", "en", "a", 1),
    (7, "the cat sat on the mat\nthe cat sat on the mat\nand then it slept", "en", "a", 1),
    (8, "# * $ % & | < > " * 20, "en", "c", 1),
    (9, " ".join(f"distinct{i}" for i in range(80)), "en", "c", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(TEXTS, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
