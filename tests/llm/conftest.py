import pytest
from pyspark.sql import types as T

from rankmart.llm.registry import prepare

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                    # clashes with names the operators use themselves
                    T.StructField("k", T.StringType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()),
                    T.StructField("quality", T.StringType()), T.StructField("length", T.LongType())])


@pytest.fixture()
def make_docs(spark):
    prepare(spark)

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, "q", 3) for i, t in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture()
def odd_docs(make_docs):
    """Nulls, empty and long texts, ties and repeated rows, extra columns."""
    base = " ".join(f"Word{i} and the of" for i in range(40)) + "."
    return make_docs([(1, base), (1, base), (2, None), (3, ""), (None, "a b c"), (None, None), (4, " \n\t "), (5, base + " more"),
                      (6, "the of and " * 20000), (7, "one two"), (8, base.upper())])
