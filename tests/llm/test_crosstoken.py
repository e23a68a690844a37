import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexichron.llm import crosstoken as C
from lexichron.llm.bpe import byte_letters, read_spec
from lexichron.llm.bytebpe import byte_bpe, default_path
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=C.default_piece_path())


def plain(texts, both):
    """Groups by sets of ends, links one by one, counts over all documents."""
    a_tok, b_tok = both
    byte_of = {x: i for i, x in enumerate(byte_letters())}
    docs = []
    for text in texts:
        raw = (" " + text).encode() if text else b""
        a = a_tok.encode(" " + text, add_special_tokens=False) if text else None
        b = b_tok.encode(text) if text else []
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_tok.id_to_piece(i)) for i in b)]
        a_bytes = [bytes(byte_of[x] for x in t) for t in a.tokens] if text else []
        if not text or b"".join(b_bytes) != raw or b"".join(a_bytes) != raw:
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in (a_bytes, b_bytes)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for cut in cuts:
            groups.append(tuple([i for i, e in zip(ids, es, strict=True) if start < e <= cut] for ids, es in ((a.ids, ends[0]), (b, ends[1]))))
            start = cut
        docs.append(groups)
    links = [[(x, y) for g in d or [] for x in g[0] for y in g[1]] for d in docs]
    held = Counter(p for of in links for p in set(of))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for d, of in zip(docs, links, strict=True):
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in d)
        sizes = sum(len(g[0]) for g in d), sum(len(g[1]) for g in d), len(d)
        out.append((*sizes, len(of), sum(held[p] == most[p[0]] for p in of), sum(held[p] for p in of), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def got(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.sort("doc_id").collect()]


def some_texts():
    rng = random.Random(9)
    signs = ["ta", "Größe", " ", "  ", "\n", "\t", "1234", "日本語", "😀", "é", "é", "½", "<|endoftext|>", "</s>", "<0x41>", "▁", "ＡＢ", "\x00", "'s", "...", "кот", " ", "aaaaaaaa"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(300)] + [prose(rng, 200) for _ in range(20)] + [None, "", " ", "x" * 3_000, "ab" * 900, "same text", "same text"]


@pytest.mark.parametrize("frequent", [C.FREQUENT, 40, 0])
def test_equals_brute_force(spark, both, frequent):
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = plain(texts, both)
    assert got(C.aligned_counts(docs, frequent=frequent)) == want
    assert sum(x[0] == 0 for x in want) > 10 and sum(x[0] > 0 for x in want) > 100


def test_large_groups_and_parts(both, monkeypatch):
    texts = some_texts()[:80]
    with open(C.default_piece_path(), "rb") as f:
        made = C.Aligner(read_spec(default_path()), f.read())
    want = made.aligned(texts, True)
    monkeypatch.setattr(C, "LARGE", 2)
    monkeypatch.setattr(C, "TOGETHER", 5)
    again = made.aligned(texts, True)
    assert all(np.array_equal(want[k], again[k]) for k in want)


def test_skipping_finds_every_group():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 120)
        cut = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        a = sorted({*cut, *(x for x in range(1, n) if rng.random() < 0.1)})
        b = sorted({*cut, *(x for x in range(1, n) if rng.random() < 0.1)})
        groups, i, j = [], 0, 0
        for end in sorted(set(a) & set(b)):
            x, y = a.index(end) + 1, b.index(end) + 1
            if (x - i, y - j) != (1, 1):
                groups.append([i, x, j, y])
            i, j = x, y
        assert C.irregular_groups(np.array(a), np.array(b)).tolist() == groups
    assert C.irregular_groups(np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_rows(spark, awkward, nothing):
    assert C.aligned_counts(awkward).count() == 11 and C.aligned_counts(nothing).collect() == []
    shown = {r.doc_id: r.groups for r in C.align_tokens(awkward.filter("doc_id in (2, 4)")).collect()}
    assert shown[2] == "" and shown[4].count("|") == 1


def test_ranks_and_library_agree(both):
    """The quicker library gives the tokenizers library's ids, special tokens' strings being plain text or not."""
    spec = read_spec(default_path())
    other = Tokenizer.from_file(default_path())
    for text in [t for t in some_texts() if t] + [" " * 300_000]:
        assert byte_bpe(spec, False).ids(text).tolist() == both[0].encode(text, add_special_tokens=False).ids
        assert byte_bpe(spec, True).ids(text).tolist() == other.encode(text, add_special_tokens=False).ids
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
    assert all(byte_bpe(spec, False).bytes_of[i] == raw for raw, i in ranks.items())
