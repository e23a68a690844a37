import hashlib

import numpy as np
import pytest

from lexichron.llm import bpe, tokencount

HARD = [
    "",
    "Hello WORLD's café  12 İ <|endoftext|> a<|startoftext|>b x <|ENDOFTEXT|>",
    "ΑΣ ΟΔΟΣ é́ ﬁ ... !!?​ x y\x1cz\x85q",
    "a" * 3000 + " " + "ab" * 300 + " " + "!" * 700,
    "日本語テキスト 한국어 😀😀 ١٢٣ ½",
    "it's we'll 'tis don''t I'VE",
    "thththth ththth thth th t",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_encoder_equals_the_library(tokenizer, rng):
    letters = "abcdefghij thEA'.!?019é ß"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    encoder = bpe.Encoder(bpe.read_spec())
    ids, shown = encoder.encode(texts)
    for text, a, b in zip(texts, ids, shown, strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(a, "<u4").tolist() == want
        assert b == tokenizer.decode(want, skip_special_tokens=False)


def test_one_tree_and_many_trees_agree(rng):
    encoder = bpe.Encoder(bpe.read_spec())
    words = {"".join(rng.choice("thea rinos").strip() or "x" for _ in range(rng.randint(1, 64))) for _ in range(300)}
    encoder.learn(words)
    for w in words:
        assert encoder._alone(w.encode()).astype("<u4").tobytes() == encoder.ids[w]


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"some words {i} and others{i}" for i in range(50)]
    want = bpe.Encoder(bpe.read_spec()).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    small = bpe.Encoder(bpe.read_spec())
    got = [small.encode([t]) for t in texts]
    assert ([g[0][0] for g in got], [g[1][0] for g in got]) == want


def test_digest_rows(spark, awkward, nothing, tokenizer):
    got = bpe.bpe_digest(awkward).collect()
    assert len(got) == 11
    want = {}
    for r in awkward.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.setdefault(r.doc_id, []).append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.bpe_digest(nothing).collect() == []
    assert [len(r.ids) for r in bpe.bpe_encode(awkward).filter("doc_id = 4").collect()] == [1]


def brute(counter, word):
    word = tokencount.MARK + word
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        raw = len(word[j - 1].encode())
        options = [(best[j - 1][0] + tokencount.BYTE * raw, best[j - 1][1] - raw)]
        options += [(best[i][0] + counter.score[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in counter.score]
        best.append(max(options))
    return -best[-1][1]


def test_counts_equal_brute_force(spark, awkward, nothing, rng):
    counter = tokencount.Counter(tokencount.read_pieces())
    words = ["".join(rng.choice("thearinos é😀") for _ in range(rng.randint(1, 14))).replace(" ", "") or "x" for _ in range(400)]
    assert all(counter.insert(w) == brute(counter, w) for w in words)
    assert counter.nodes < sum(len(w) + 1 for w in words) - 100  # shared prefixes are made once
    got = {(r.doc_id, r.n_words): r.n_tokens for r in tokencount.token_counts(awkward).collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == 0 and got[(4, 1)] == brute(counter, "one")
    assert got[(6, 30_000)] == 30_000 * brute(counter, "word")
    assert tokencount.token_counts(awkward).count() == 11 and tokencount.token_counts(nothing).collect() == []


def test_forgetting_and_long_words(monkeypatch, rng):
    pieces = tokencount.read_pieces()
    texts = [" ".join("".join(rng.choice("thearinos") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(20)]
    want = tokencount.Counter(pieces).count(texts)
    monkeypatch.setattr(tokencount, "NODES", 50)
    small = tokencount.Counter(pieces)
    got = [small.count([t]) for t in texts]
    assert ([g[0][0] for g in got], [g[1][0] for g in got]) == want and small.nodes < 2_000
    word = "".join(rng.choice("thearinos é😀") for _ in range(5_000)).replace(" ", "")
    assert small.insert(word) == brute(small, word) and small.insert("x" * 200_000) > 0
    assert tokencount.zipf_scores(["b", "a", "b"])["b"] == -np.log(2)


def test_every_code_point(tokenizer):
    """Each code point alone, in a word, and doubled has the library's ids."""
    encoder = bpe.Encoder(bpe.read_spec())
    codes = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 2_000):
        texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}" for c in codes[at : at + 2_000]]
        want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = encoder.encode(texts)[0]
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
