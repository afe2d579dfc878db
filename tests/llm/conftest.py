import pytest


@pytest.fixture
def docs_of(spark):
    def make(texts, start=0):
        rows = [(start + i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string")

    return make


# Null, empty and odd texts that every operator must take.
ODD = [None, "", " \n\t ", "a", "\n\n", "é" * 50, "the " * 4000, "x" * 70000, "A\x00b\x7f c", "x\n" * 300, "😀 𝒳 ﬁ ² Å"]


@pytest.fixture
def odd():
    return list(ODD)
