import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexichron.llm import packing as P
from tests.llm.conftest import prose


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("capacity", [6, 24, 31])
def test_functions_are_dual_feasible(capacity):
    """No choice of pieces that fits one sequence sums to more than 1: the largest sum is found by filling up."""
    f, below = P.dual_feasible(capacity)
    best = np.zeros_like(f)
    for c in range(1, capacity + 1):
        best[:, c] = np.maximum(best[:, c - 1], np.max([best[:, c - s] + f[:, s] for s in range(1, c + 1)], axis=0))
    assert (best[:, capacity] <= below).all()


def test_bounds_and_packing_on_small_cases():
    rng, met = random.Random(2), 0
    for _ in range(150):
        sizes = np.array(sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True))
        least = fewest(sizes.tolist(), 20)
        bins = P.best_fit_decreasing(sizes, 20)
        assert P.lower_bound(sizes, 20) <= least <= bins.max() + 1
        assert np.bincount(bins, weights=sizes).max() <= 20
        met += P.lower_bound(sizes, 20) == least
    assert met > 120


def test_bound_beats_the_sum():
    assert P.lower_bound(np.full(100, 600)) == 100 and P.lower_bound(np.full(99, 342)) == 50 and P.lower_bound(np.zeros(0, int)) == 0


def test_group_keeps_the_better_packing():
    sizes = np.array([6, 6, 4, 4])
    before = np.array([0, 1, 0, 1])
    bins, up = P.pack_group(sizes, before, 10, 0)
    assert bins.max() == 1 and not up.any()
    _, up = P.pack_group(np.array([6, 6, 6]), None, 10, 1)
    assert up.sum() == 1  # certified: the least filled one alone


def whole(rows, capacity):
    """Each sequence without gaps, each piece once."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_tree_stays_near_the_bound(spark):
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 101, 6_000), rng.integers(26, 40, 3_000), np.full(700, 34)):
        df = spark.createDataFrame([(int(x), i) for i, x in enumerate(sizes)], "length bigint, uid long").repartition(5)
        out = P.pack(df, 100, group=200, fan=4).collect()
        assert sorted(r.uid for r in out) == list(range(len(sizes)))
        used, bound = whole(out, 100), P.lower_bound(sizes, 100)
        alone = int(P.best_fit_decreasing(sizes, 100).max()) + 1
        assert used <= max(bound + 2, alone + 3)


def test_pieces_and_sequences(spark, awkward, nothing, rng):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, prose(rng, rng.choice([1, 40, 300, 900, 3000]))) for i in range(60)] + [(70, "a <|endoftext|> b"), (71, " " * 200_000 + "x"), (72, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.pack(P.pieces(docs), group=16, fan=2).collect()
    whole(out, 1024)
    by = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        by.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert [r.piece for r in by[i]] == list(range(len(by[i]))) and all(r.length == 1024 for r in by[i][1:])
        assert sum(r.length for r in by[i]) == len(ids)
        for r in by[i]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    shown = P.pieces(docs.filter("doc_id = 70"), ids=True).first()
    assert list(shown.ids) == [*tok.encode("a <|endoftext|> b", add_special_tokens=False).ids, 2]
    made = P.pack(P.pieces(awkward)).collect()
    assert len({r.sequence_id for r in made}) <= whole(made, 1024) and P.pack(P.pieces(nothing)).collect() == []
    firsts = [r for r in made if r.piece == 0]
    assert len(firsts) == 11 and sorted((r.length for r in firsts))[:3] == [1, 1, 1]


def test_numbers_of_sequences_never_meet():
    keys = [((level << 36 | team) << 22) | b for level, team, b in itertools.product((0, 1, 30), (0, 1, (1 << 36) - 1), (0, 2_047))]
    assert len(set(keys)) == len(keys) and max(keys) < 1 << 63
