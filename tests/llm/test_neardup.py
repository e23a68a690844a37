import numpy as np
import pytest

from lexichron.llm import neardup as N
from lexichron.llm.common import Shelf
from lexichron.llm.graph import components
from lexichron.llm.registry import ORACLES, QUERIES
from tests.llm.conftest import prose
from tests.oracle import SF, database, same


def brute(rows, k, percent=80):
    """component of every (doc_id, text) by full comparison."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, text, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, rng, k):
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(5, 200))
        texts += [base] + [edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06])) for _ in range(rng.randint(0, 14))]
    texts += ["one", "one", "", None, "two words", "two words", "  ", "a b c d e f", "a b c d e f g"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.near_duplicates(df, k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_outsiders_of_a_crowded_bucket(spark, rng, monkeypatch):
    """A star's centre misses siblings that only another member links; small blocks force the outsiders over many tasks."""
    monkeypatch.setattr(N, "OUTSIDE", 3)
    monkeypatch.setattr(N, "INSIDE", 4)
    base = prose(rng, 150)
    rows = list(enumerate([base] + [edited(rng, base, 0.045) for _ in range(40)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df, 2).collect()) == brute(rows, 2)


def test_full_sets_are_in_order(spark, rng):
    """links_across searches in the sets."""
    df = spark.createDataFrame([(1, prose(rng, 300))], "doc_id long, text string")
    wanted = N.sketches(df, 2).select("__row", "__mark", "cls")
    members = N.full_sets(df, wanted, 2).first().members
    assert len(members) > 50 and members == sorted(members)


def common_part(rng, n, shared, own):
    """n texts with a large common part and words of their own: similarity shared / (shared + 2 own)."""
    part = prose(rng, shared, [f"part{i}" for i in range(10**5)])
    return [part + " " + " ".join(f"own{i}x{j}" for j in range(own)) for i in range(n)]


def test_a_bucket_of_unlinked_classes(spark, rng, monkeypatch):
    """Pages that share bands but not enough to link: none of their pairs is formed, and links among them are found."""
    monkeypatch.setattr(N, "OUTSIDE", 20)
    monkeypatch.setattr(N, "INSIDE", 15)
    texts = common_part(rng, 150, 140, 60)
    texts += [edited(rng, t, 0.03) for t in texts[:12]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df, 2).collect()) == brute(rows, 2)


@pytest.mark.parametrize(("k", "short"), [(2, "a b c d e"), (5, "a b c d e f g h")])
def test_four_shingles_within_five(spark, k, short):
    rows = [(1, short), (2, short + " i"), (3, " ".join(short.split()[:-1])), (4, "z " + short)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k) == [(1, 4, 1), (2, 5, 1), (3, 3, 3), (4, 5, 1)]


def test_awkward_rows(spark, awkward, nothing):
    got = N.near_duplicates(awkward, 2).collect()
    assert len(got) == 11
    assert [r.component_id for r in got if r.doc_id == 5] == [5, 5]
    assert [r.n_shingles for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert N.near_duplicates(nothing, 2).collect() == []
    kept = N.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and sum(r.doc_id == 5 for r in kept.collect()) == 1
    assert N.drop_near_duplicates(nothing).collect() == []


def test_near_copies_without_an_id(spark, rng):
    """A class that only rows without a doc_id hold joins components like any other; also two such classes."""
    a, b, c = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    rows = [(1, a), (None, a + " more"), (None, "more " + b), (None, b), (None, b), (2, c), (None, ""), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df, 2).collect()]
    assert (None, 40, 1) in got and (1, 39, 1) in got and sum(x[2] is None for x in got) == 6
    kept = sorted(N.drop_near_duplicates(df, 2).collect(), key=str)
    assert len(kept) == 5 and {r.doc_id for r in kept} == {1, 2, None}
    assert sum(r.doc_id is None and r.text in (b, "more " + b) for r in kept) == 1


def test_repeated_id_with_other_text(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (1, "z y x w v u"), (2, "a b c d e f g h")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.near_duplicates(df, 2).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_bins_and_densification():
    few = N.shingle_set("a b c d e f", 2)
    assert len(few) == 5 and len(set(N.band_hashes(few).tolist())) == N.BANDS
    many = N.shingle_set(" ".join(map(str, range(5000))), 2)
    direct = [many[(many >= N.EDGES[b]) & (many < N.EDGES[b + 1])].min() for b in range(N.BINS)]
    rows = np.array(direct, np.uint64).reshape(N.BANDS, N.ROWS)
    out = N.BAND_SEED.copy()
    for r in range(N.ROWS):
        out = N.mixed(out * N.U(0x9E3779B97F4A7C15) + rows[:, r])
    assert (out == N.band_hashes(many)).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges, Shelf(spark)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_query_equals_its_sql(spark):
    same(QUERIES["op2_minhash"](spark, SF), ORACLES["op2_minhash"], database())


def test_rows_of_one_id_are_told_apart(spark, rng):
    """Different texts under one doc_id all stay; near copies under one doc_id leave one row; no text takes another's place."""
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a, "p"), (1, b, "q"), (1, a + " more", "r"), (2, c, "s"), (2, b, "t"), (3, c, "u"), (3, "", "v"), (3, None, "w"), (1, b, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    kept = N.drop_near_duplicates(df, 2)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == df.columns and len(got) == 5 and len(set(got)) == 5
    assert (1, b) in got and (2, c) in got and (3, "") in got and (3, None) in got and sum(x in ((1, a), (1, a + " more")) for x in got) == 1


def test_bands_meet_at_every_small_size():
    """Pairs of the least similarity that links, of every size from four on: none in 3,000 misses all bands."""
    rng = np.random.default_rng(1)
    for n in (4, 5, 8, 12, 20, 40):
        extra = n // 4
        for _ in range(500):
            s = np.unique(rng.integers(0, 2**64, n + extra, dtype=np.uint64))
            assert (N.band_hashes(s) == N.band_hashes(np.sort(rng.choice(s, n, replace=False)))).any()
