import hashlib
import random
import zlib

import pytest

from lexichron.llm import periodic as P
from tests.llm.conftest import prose


def brute(words, shortest=6, exponent=4):
    """Every run by its definition: each stretch of agreeing words a period apart, smallest period first."""
    n, seen = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, exponent * q):
                seen.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def periodic(rng, letters, parts):
    out = []
    for _ in range(parts):
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8]))]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 40)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(4)
    rows = [[w.encode() for w in periodic(rng, "abc"[: rng.randint(1, 3)], rng.randint(0, 12))] for _ in range(400)]
    found, stay = P.runs_of(rows)
    at = 0
    for r, words in enumerate(rows):
        want = brute(words)
        assert [tuple(x[1:]) for x in found.tolist() if x[0] == r] == want
        left = [w for w, on in zip(words, stay[at : at + len(words)], strict=True) if on]
        assert left == kept(words, want)
        at += len(words)
    assert len(found) > 300


def test_parts_of_candidates_change_nothing(monkeypatch):
    rng = random.Random(5)
    rows = [[w.encode() for w in periodic(rng, "ab", 30)] for _ in range(5)]
    whole = P.runs_of(rows)[0].tolist()
    monkeypatch.setattr(P, "TOGETHER", 7)
    assert P.runs_of(rows)[0].tolist() == whole and P.runs_of([])[0].tolist() == []


@pytest.mark.parametrize("exponent, shortest", [(2, 2), (3, 4), (5, 10)])
def test_other_exponents(exponent, shortest):
    rng = random.Random(6)
    words = [w.encode() for w in periodic(rng, "abc", 40)]
    assert [tuple(x[1:]) for x in P.runs_of([words], shortest, exponent)[0].tolist()] == brute(words, shortest, exponent)


def test_agreement_climbs_and_descends():
    rng = random.Random(7)
    import numpy as np

    words = np.array([99, *(rng.randint(0, 1) for _ in range(300)), 100])
    fence = words > 1
    levels, _ = P.recompress(words, fence)
    pairs = [(a, b) for a in range(1, 300, 3) for b in range(a + 1, 301, 5)]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    for got, i, j in zip(P.agreement(levels, a, b).tolist(), a.tolist(), b.tolist(), strict=True):
        n = 0
        while j + n < 302 and words[i + n] == words[j + n]:
            n += 1
        assert got == n


def test_long_runs():
    words = [b"la"] * 200_000
    found, stay = P.runs_of([words, [b"x", b"y"] * 30_000 + [b"z"]])
    assert found.tolist() == [[0, 0, 200_000, 1], [1, 0, 60_000, 2]] and stay.sum() == 1 + 2 + 1


def test_query_rows(spark, awkward, nothing):
    got = {r.doc_id: r for r in P.run_digest(awkward).collect()}
    assert P.run_digest(awkward).count() == 11 and P.run_digest(nothing).collect() == []
    none = hashlib.sha256(b"").hexdigest()
    assert (got[1].n_runs, got[1].start, got[1].period, got[1].runs_sha256, got[1].collapsed_sha256) == (0, None, None, none, none)
    assert (got[6].start, got[6].length, got[6].period, got[6].exponent_milli) == (0, 30_000, 1, 30_000_000)
    assert got[6].collapsed_sha256 == hashlib.sha256(b"word").hexdigest()
    runs = {r.doc_id: r for r in P.periodic_runs(awkward).collect()}
    assert [tuple(x) for x in runs[6].runs] == [(0, 30_000, 1)] and runs[6].collapsed == "word" and runs[None].collapsed in ("", "no id at all")


def test_planted_tails(spark, rng):
    rows = [(i, prose(rng, rng.choice([0, 1, 3, 30, 90]))) for i in range(250)]
    got = {r.doc_id: r for r in P.run_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = 0
    for i, text in rows:
        words, h = text.split(), zlib.crc32(str(i).encode())
        n = len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute(words)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert got[i].n_runs == len(runs) and got[i].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert got[i].collapsed_sha256 == hashlib.sha256(" ".join(kept(words, runs)).encode()).hexdigest()
    assert planted > 10
