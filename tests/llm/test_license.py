import re

import pytest

from lexichron.llm import license as L
from lexichron.llm.registry import ORACLES, QUERIES
from tests.oracle import SF, database, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = sorted((i, label) for phrase, label in L.BASE for n in [len(phrase.split())] for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(spark, awkward):
    got = sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_scan(awkward).collect()), key=str)
    assert got == sorted((brute(r.text) for r in awkward.collect()), key=str)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("licensed under the gnu LESSER general public license version 3", "gpl-3"),  # one word put in: the diagonals next to each other are merged
        ("the gnu general store is public", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit-text"),
        ("apache license version 2 apache license, version 2", "apache-2"),
        ("CC-BY-NC", "cc-by-nc"),
    ],
)
def test_labels(spark, text, labels):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = L.license_scan(df).first()
    assert r.labels == labels and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_native_and_empty(spark, nothing, capsys):
    out = L.license_scan(nothing)
    assert out.collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query_equals_its_sql(spark):
    same(QUERIES["op1_license"](spark, SF), ORACLES["op1_license"], database())
