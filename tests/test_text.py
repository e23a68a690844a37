import pytest
from pyspark.sql import functions as F

from lexichron.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("3600", 3600), ("45:30", 2730), ("1:02:03", 3723), ("  90 ", 90), ("", None), (None, None), ("about an hour", None), ("12d", None), ("-5", None), ("inf", None), ("1e400", None), ("1:2.9", 62)],
)
def test_duration(spark, raw, want):
    assert one(spark, T.duration_seconds(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("header", "hops", "trusted", "want"),
    [
        ("6.6.6.6, 198.51.100.7, 10.1.2.3", 2, True, "198.51.100.7"),
        ("198.51.100.7", 2, True, "198.51.100.7"),
        ("198.51.100.7", 1, False, "peer"),
        (" , ", 1, True, "peer"),
        (None, 1, True, "peer"),
    ],
)
def test_client_key(spark, header, hops, trusted, want):
    assert one(spark, T.client_key(F.lit("peer"), F.lit(header).cast("string"), F.lit(hops), F.lit(trusted))) == want


def test_nfkc_and_stems(spark):
    assert one(spark, T.nfkc(F.lit("ﬁne①"))) == "fine1"
    assert one(spark, T.stems(F.array(*map(F.lit, ["caresses", "ponies", "running", "relational", "hopeful", "cats", "agreed", "sky"])))) == ["caress", "poni", "run", "relat", "hope", "cat", "agre", "sky"]


def test_vector_literal_and_request(spark):
    assert one(spark, T.vector_literal(F.array(F.lit(0.5), F.lit(-1.0)))) == "[0.500000,-1.000000]"
    assert one(spark, T.valid_request(F.lit("why"), F.lit(None).cast("int"))) is True
    assert one(spark, T.valid_request(F.lit("no"), F.lit(5))) is False
    assert one(spark, T.valid_request(F.lit("why not"), F.lit(11))) is False


def test_vector_literal_rounds_exact_values(spark):
    """Halves go to the even neighbour; a number just under a half goes down."""
    v = F.lit("[-0.0703125, 0.0078125, 0.0234375, 1e22, NaN, -1e-9]")
    some = F.from_json(v, "array<double>", {"allowNonNumericNumbers": "true"})
    assert one(spark, T.vector_literal(some)) == "[-0.070312,0.007812,0.023438,10000000000000000000000.000000,nan,-0.000000]"
    assert one(spark, T.vector_literal(F.array(F.lit(1.0), F.lit(None).cast("double")))) == "[1.000000]"
    assert one(spark, T.vector_literal(F.lit(None).cast("array<float>"))) is None
