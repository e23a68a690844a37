"""One form for what is said and what is written."""

import pytest

from lexichron.functions.spoken import spoken_form
from lexichron.operators import evaluation as V
from lexichron.functions.spoken import spoken_words


@pytest.mark.parametrize("said, written", [
    ("DOCTOR WARREN SAW MISSUS BELL", "Dr. Warren saw Mrs. Bell."),
    ("SHE PAID FORTY FIVE POUNDS", "She paid £45."),
    ("it cost two hundred and six dollars", "It cost $206!"),
    ("four seven nine", "479"),
    ("nineteen eighty four", "1984"),
    ("two thousand and twenty one", "2021"),
    ("three hundred twelve thousand and five", "312,005"),
    ("two million five hundred thousand", "2.5 million"),
    ("six point two five", "6.25"),
    ("twelve percent", "12%"),
    ("the twenty third of may", "the 23rd of May"),
    ("the fifth and the twentieth", "the 5th and the 20th"),
    ("double seven three", "773"),
    ("they will not and can not go", "they won't and can't go"),
    ("we are sure he is late", "we're, um, sure he's late [laughs]"),
    ("the café closed", "the cafe closed"),
    ("zero zero seven", "007"),
])
def test_said_is_written(said, written):
    assert spoken_form(said) == spoken_form(written)


@pytest.mark.parametrize("text, form", [
    ("one two three", ["123"]),
    ("wait a second and point there", ["wait", "a", "second", "and", "point", "there"]),
    ("a hundred reasons", ["a", "hundred", "reasons"]),
    ("", []),
    ("%%% -- ... ''", []),
    ("5 dollars and 3 cents", ["$5", "and", "¢3"]),
    ("50% of 1,000", ["50%", "of", "1000"]),
])
def test_forms(text, form):
    assert spoken_form(text) == form


def test_numbers_below_a_hundred_thousand():
    from lexichron.functions.spoken import SMALL, TENS

    def name(n):
        if n < 20:
            return SMALL[n]
        if n < 100:
            return TENS[n // 10 - 2] + (" " + SMALL[n % 10] if n % 10 else "")
        if n < 1_000:
            return f"{SMALL[n // 100]} hundred" + (f" and {name(n % 100)}" if n % 100 else "")
        return f"{name(n // 1_000)} thousand" + (f" {name(n % 1_000)}" if n % 1_000 else "")

    for n in [*range(1_300), *range(1_300, 100_000, 37)]:
        assert spoken_form(f"so {name(n)} of them") == ["so", str(n), "of", "them"], name(n)


def test_error_rate_of_one_form(spark):
    p = spark.createDataFrame([(1, "MISTER LONG OWED THIRTY DOLLARS", "Mr. Long owed $30."), (2, "um", "x"), (3, None, "x")], "pair_id long, ref string, hyp string")
    rows = V.normalized_pairs(p, spoken_words)
    assert [r.pair_id for r in rows.collect()] == [1] and V.pooled_wer(rows).first().edits == 0
