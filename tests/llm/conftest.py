import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, fp string, key string, size string, x string, tid string, rank string, seed string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    line = "A line that is long enough to be looked for in all documents"
    more = ("k", "f", "y", "z", "x", "t", "r", "s")
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "b", 10), (3, " \n\t ", "en", "a", 4), (4, long, "en", None, len(long))]
    rows += [(5, "same row twice\n" + line, "en", "a", 1)] * 2
    rows += [(10 + i, f"{line.upper()}  \nown text number {i} of this document", "de", "ab"[i % 2], 9) for i in range(6)]
    rows += [(20 + i, "x", "fr", "c", 1) for i in range(3)]
    return spark.createDataFrame([r + more for r in rows] + [(None,) * 13], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
