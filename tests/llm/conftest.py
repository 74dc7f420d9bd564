import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _rid string, Size string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    rng = random.Random(3)
    base = words(rng, 400)
    other = words(rng, 90) + "\n" + words(rng, 90)
    near = base.split()
    near[200] = "changed"
    rows = [
        (1, base, "en", "a", 5, "x", "r", "s"), (2, base, "en", "a", 5, "x", "r", "s"), (3, " ".join(near), "en", None, None, None, None, None),
        (4, None, None, "b", 0, "x", "r", "s"), (5, "", "de", "b", 0, "x", "r", "s"), (6, " \n\t ", "de", "c", 0, "x", "r", "s"),
        (7, other, "de", "c", 5, "x", "r", "s"), (7, other, "de", "c", 5, "x", "r", "s"), (None, other, "fr", "a", 5, "x", "r", "s"),
        (8, words(rng, 60000), "fr", "b", 5, "x", "r", "s"), (9, "one two three", "fr", "a", 5, "x", "r", "s"), (10, "ONE two\x0bthree", "fr", "a", 5, "x", "r", "s"),
        (11, "x" * 2_500_000, "fr", "c", 5, "x", "r", "s"), (12, "é 中 😀 \0 a\u00a0b", "fr", None, 5, "x", "r", "s"), (13, "a " * 300, "en", "c", 5, "x", "r", "s"),
    ]
    return rows + [(100 + i, words(rng, rng.randrange(1, 300)), "en", f"s{i % 4}", 1, "x", "r", "s") for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
