import pytest

AWKWARD = [
    (1, None, "en", "s1", 0, "x"),
    (2, "", "en", "s1", 0, "x"),
    (3, " \n\t ", None, None, 3, None),
    (4, "one", "en", "s2", 3, "x"),
    (5, "Released under the MIT License. Licensed under CC BY-NC 4.0. under the mit license", "en", "s2", 80, "x"),
    (5, "Released under the MIT License. Licensed under CC BY-NC 4.0. under the mit license", "en", "s2", 80, "x"),
    (6, "word " * 30_000, "en", "s2", 150_000, "x"),
    (7, "x" * 50_000, "en", "s3", 50_000, "x"),
    (8, "ünï ΣΑΣ 日本語 😀 \x00\x1c end", "de", "s3", 20, "x"),
    (None, "no id at all", "en", "s3", 12, "x"),
    (None, None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture
def awkward(spark):
    """Documents with nulls, empty, long and repeated texts, and a column whose name clashes with results."""
    return named(spark.createDataFrame(AWKWARD, SCHEMA))


@pytest.fixture
def nothing(spark):
    return named(spark.createDataFrame([], SCHEMA))


#: Names that need quoting, and names that operators have used for helper columns.
CLASHING = ("a.b", "c`d", "__row", "__key", "__plan", "__m", "__upto", "__mark", "__copies", "carried_0", "uid", "row")


def named(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture
def rng():
    import random

    return random.Random(11)


def prose(rng, n, words=None):
    words = words or [f"{a}{b}" for a in ("ta", "lo", "mer", "vin", "sa", "ko", "ri", "ne") for b in ("ran", "tol", "mi", "des", "ga", "pon", "li", "rus")]
    return " ".join(rng.choice(words) for _ in range(n))
