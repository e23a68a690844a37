import numpy as np

from lexichron.llm import media as M


def tune(seed, n=64):
    return M.melody(np.random.default_rng(seed).normal(0, 0.125, n))


def test_integral_image_equals_plain_sums():
    samples = tune(1).astype(float)
    c = M.chroma(samples)
    assert np.allclose((c**2).sum(1), 1)
    prints = M.fingerprint(samples)
    assert len(prints) == len(c) - M.WIDTH + 1
    # the last filter by plain sums over the frames
    shape, p, h, w = M.FILTERS[-1]
    assert shape == 3
    for t in range(len(prints)):
        a, b = c[t : t + w, p : p + h].sum() * 12 / h, c[t : t + w].sum()
        level = int(np.searchsorted(M.CUTS, np.log((a + 0.05) / (b + 0.05))))
        assert prints[t] & 3 == M.GRAY[level]


def brute_groups(recordings):
    prints = {i: M.fingerprint(np.frombuffer(a, "<i2")).view(np.int32) if a else np.zeros(0, np.int32) for i, a in recordings}
    ids, root = list(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            x, y = prints[a], prints[b]
            if a < b and len(x) and len(y):
                for o in range(-len(y), len(x)):
                    rate, met = M.error_rate(x, y, o)
                    if rate <= M.BIT_ERRORS and met >= M.OVERLAP * min(len(x), len(y)):
                        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, tune(i).astype("<i2").tobytes()) for i in range(12)]
    quiet = (tune(2) * 0.4 + rng.normal(0, 60, len(tune(2)))).astype("<i2")
    late = np.concatenate([np.zeros(M.HOP * 5, "<i2"), tune(3)]).astype("<i2")
    rows += [(20, quiet.tobytes()), (21, late.tobytes()), (22, tune(4).astype("<i2").tobytes()), (23, None), (24, b""), (25, b"\x01\x00" * 100)]
    df = spark.createDataFrame([(i, bytearray(a) if a is not None else None) for i, a in rows], "rec_id long, audio binary").repartition(3)
    got = {r.rec_id: r.group_id for r in M.aligned_groups(df).collect()}
    assert got == brute_groups(rows)
    assert got[20] == 2 and got[21] == 3 and got[22] == 4


def test_awkward_vectors(spark):
    v = [0.1 * (i % 7) - 0.3 for i in range(64)]
    rows = [(1, v, "x"), (1, v, "x"), (2, v, "x"), (3, None, "x"), (4, [], "x"), (5, [1.0, None], "x"), (6, [float("nan")], "x"), (7, v[:3], "x"), (None, v, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cls string")
    got = M.aligned_groups(M.rendered(df)).collect()
    assert len(got) == 9 and all(r.group_id == 1 for r in got if r.rec_id in (1, 2, None))
    assert sorted((r.n_ints, r.group_id) for r in got if r.rec_id in (3, 4, 5, 6, 7)) == [(0, i) for i in (3, 4, 5, 6, 7)]
    assert M.aligned_groups(M.rendered(df.limit(0))).collect() == []


def grouped(spark, monkeypatch, prints):
    """group_id by rec_id of fingerprints given as they are; a class's hash is its rec_id."""
    rows = [(i, i, [int(x) for x in p]) for i, p in prints.items()]
    df = spark.createDataFrame(rows, "rec_id long, cls long, ints array<int>").repartition(3)
    monkeypatch.setattr(M, "fingerprints", lambda recordings: recordings)
    return {r.rec_id: r.group_id for r in M.aligned_groups(df).collect()}


def test_links_between_others_than_the_smallest_of_a_bucket(spark, monkeypatch):
    """Every integer that near copies share also stands in an unrelated recording of smaller hash; blocks of all sizes."""
    rng = np.random.default_rng(5)
    ints = lambda n: rng.integers(-(2**31), 2**31, n)
    base, prints = ints(40), {}
    for i in range(10):
        prints[i] = np.concatenate([ints(30), base[4 * i : 4 * i + 4], ints(30)])
    for i in range(100, 112):
        prints[i] = np.concatenate([ints(i % 3), base])
        prints[i][-(i % 7 + 1)] ^= 1
    want = dict.fromkeys(range(10)) | dict.fromkeys(range(100, 112), 100)
    want |= {i: i for i in range(10)}
    assert grouped(spark, monkeypatch, prints) == want
    for outside, inside in ((3, 4), (1, 100)):
        monkeypatch.setattr(M, "OUTSIDE", outside)
        monkeypatch.setattr(M, "INSIDE", inside)
        assert grouped(spark, monkeypatch, prints) == want


def test_repeated_integers_and_every_offset(spark, monkeypatch):
    """In a loop the first places align wrongly, and the highest peak is not the offset that fits."""
    rng = np.random.default_rng(6)
    ints = lambda n: rng.integers(-(2**31), 2**31, n)
    loop, tail = ints(4), ints(20)
    a = np.concatenate([np.tile(loop, 3), tail])
    b = np.concatenate([np.tile(loop, 4), tail ^ 1])
    assert grouped(spark, monkeypatch, {1: a, 2: b, 3: ints(30)}) == {1: 1, 2: 1, 3: 3}


def test_votes_and_bits_of_all_offsets_equal_plain_counts(monkeypatch):
    rng = np.random.default_rng(7)
    for n, m, kinds in ((1, 1, 1), (1, 5, 2), (40, 23, 3), (60, 60, 50), (90, 90, 1)):
        a, b = rng.integers(0, kinds, n).astype(np.int32), rng.integers(0, kinds, m).astype(np.int32)
        met = {o: (a[max(o, 0) : m + o], b[max(-o, 0) : n - o]) for o in range(1 - m, n)}
        met = {o: (x[: len(y)], y[: len(x)]) for o, (x, y) in met.items()}
        assert M.offset_votes(a, b).tolist() == [int((x == y).sum()) for x, y in met.values()]
        same = [32 * len(x) - 2 * sum(bin(int(i) ^ int(j)).count("1") for i, j in zip(x, y, strict=True)) for x, y in met.values()]
        assert M.correlation(M.signs(a), M.signs(b)).tolist() == same
        slow = M.aligned(a, b)
        monkeypatch.setattr(M, "DIRECT", -1)
        assert M.aligned(a, b) == slow
        monkeypatch.undo()
