import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]


def passage(start, length=60, step=1):
    return " ".join(WORDS[(start * 37 + i * step) % 400] + ("x" if (start + i) % 3 else "y") + str(start % 7) for i in range(length))


@pytest.fixture(scope="session")
def make(spark):
    """Documents with a clashing extra column, from (doc_id, text[, lang[, source]])."""
    def rows(*data):
        full = [(*r, *["en", "s0"][len(r) - 2:]) for r in data]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string").withColumns(
            {"n_chars": F.length("text"), "node": F.lit("extra"), "key": F.lit(1), "size": F.lit("big"), "toxic": F.lit(None).cast("int")})
    return rows


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, wordless, short, long, repeated rows, copies."""
    long = " ".join(passage(k, 200) for k in range(100))
    return make((None, None), (1, None), (2, ""), (3, " \t\n"), (4, "Hi"), (5, "one two three"), (6, passage(1)), (6, passage(1)),
                (7, passage(1).upper()), (8, passage(2), None, None), (9, long), (10, long + " End."), (None, passage(3)))
