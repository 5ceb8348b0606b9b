import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 97} item{i % 89}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, extra columns with names the operators use."""
    rows = [
        (1, "The same text here again and again ok.", "en", "a", 1, 0.5, "x", 1), (2, "the SAME text here again and again OK.", "en", "a", 1, 0.5, None, 1), (2, "the SAME text here again and again OK.", "en", "a", 1, 0.5, None, 1),
        (None, None, None, None, None, None, None, None), (None, "", None, "b", 0, 1.0, "y", 2), (5, "", "de", None, 0, None, "z", 3), (6, " \n\t ", "de", "b", 4, 0.0, "q", 4),
        (7, LONG, "en", "c", len(LONG), 0.1, "w", 5), (8, "Éa É É", "fr", "c", 6, 0.1, "w", 5), (9, "éa É É", "fr", "c", 6, 0.1, "w", 5), (2, "another text under an id met before", "en", "d", 3, 0.3, "r", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, verdict string, row long")


@pytest.fixture(scope="session")
def folder(spark, odd_docs, tmp_path_factory):
    """A folder of tables with those documents, all tables present, and one with empty tables."""
    full, none = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("none")
    turns = [(1, 0, "user", "a </s> [INST] \\ <|end|> b"), (1, 1, "assistant", "<|start|>x<|sep|>\\<|"), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", None), (None, None, "assistant", "n"), (3, 5, "user", "q\n"), (3, None, "system", "first")]
    chats = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 0, None), (None, 1, 1), (9, None, 0), (8, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for path, keep in ((full, True), (none, False)):
        for name, df in (("documents", odd_docs), ("conversations", chats), ("labels", labels)):
            (df if keep else df.where(F.lit(False))).write.parquet(f"{path}/{name}.parquet")
    return str(full), str(none)
