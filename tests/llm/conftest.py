import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use for their own ends, and that a table may have as well.
EXTRA = "key long, part int, fp long, score double, fingerprint string, word string, n long, length long, place long, place_ string, y int, f string, p_clean double, rate double"


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    stop, parts = "the of and to in is that it for was on as with at by".split(), ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    return " ".join(rng.choice(stop) if rng.random() < 0.4 else "".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n)).capitalize() + "."


def awkward_rows() -> list[tuple]:
    long = " ".join(prose(i, 400) for i in range(60))
    return [
        (1, prose(1), "en", "a", 5),
        (1, prose(1), "en", "a", 5),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, prose(2), "en", "a", 5),
        (None, None, None, None, None),
        (4, prose(1), "de", "b", 5),
        (5, long, "en", "b", len(long)),
        (6, " \n\t \r\n", "fr", "b", 6),
        (7, "日本語の テキスト です é ß   x", None, "b", 10),
        (8, "a b c", "en", "a", 5),
        (9, "Write to jo.doe@mail.example.com or +1 (275) 555-5927, 10.0.0.1, 4111 1111 1111 1111.", "en", "a", 5),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    extra = tuple([None] * (EXTRA.count(",") + 1))
    return spark.createDataFrame([r + extra for r in awkward_rows()], f"{COLUMNS}, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"{COLUMNS}, {EXTRA}")


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A small folder of tables: real documents of the smallest size."""
    return "/root/testdata/sf0.001"
