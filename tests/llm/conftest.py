import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, shard string"


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    some = "the of and to in river stone market people window letter garden winter music bridge the of and a is".split()
    return " ".join(r.choice(some) + r.choice(["", "", "", "ing", "er", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, white space, repeats, ties, long texts, clashing extra columns."""
    long = prose(1, 30_000)
    texts = [None, "", "  \n\t", "One", "one two", prose(2, 60), prose(2, 60), prose(2, 59) + " odd", prose(3, 200), long, long + " tail", "a\nb\na\n\nb\nc d",
             "Ünïcödé straße ŒUVRE 漢字 \U0001f600 ﬁn", "x" * 5000, "!!! ### $$$ 123", "same same same same same same same same same same same same"]
    rows = [(i, t, "en" if i % 3 else None, [None, "b", "a", "é"][i % 4], None, 1.0, "s", "t") for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, 1, None, None, None), rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
