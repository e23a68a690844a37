import numpy as np
import pytest
from pyspark.sql import functions as F

from lexichron.llm import quality as Q
from lexichron.llm import toxicity as X
from tests.llm.conftest import prose
from tests.oracle import SF

BAD = ["idiot", "moron", "worthless"]
LABELS = "doc_id long, quality int, toxic int, score string"


@pytest.fixture
def corpus(spark, rng):
    docs, labels = [], []
    for i in range(500):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        junk = i % 4 == 1
        if junk:
            words = [w + rng.choice(["***", "###", "$$$"]) for w in words]
        docs.append((i, " ".join(words), "x"))
        if rng.random() < 0.7:
            labels.append((i, int(not junk), int(toxic), "x"))
    return spark.createDataFrame(docs, "doc_id long, text string, predicted string"), spark.createDataFrame(labels, LABELS)


def held_out_accuracy(scored, labels, column):
    p = scored.toPandas().merge(labels.toPandas()[["doc_id", column]], on="doc_id")
    p = p[p.held_out]
    return (p.predicted == p[column]).mean(), p


def test_toxicity_held_out(spark, corpus):
    docs, labels = corpus
    accuracy, p = held_out_accuracy(X.toxicity_scores(docs, labels), labels, "toxic")
    assert accuracy > 0.95 and p.score.between(0, 1).all()
    hidden = spark.createDataFrame([(1, "so 1d10t and m0r0n here with w0rthless talk", "x"), (2, "i d i o t and idiooot and moroooon", "x"), (3, prose(__import__("random").Random(1), 60), "x")], docs.schema)
    both = docs.union(hidden.selectExpr("doc_id + 10000", "text", "predicted"))
    got = {r.doc_id - 10_000: r.predicted for r in X.toxicity_scores(both, labels).filter("doc_id > 10000").collect()}
    assert got == {1: 1, 2: 1, 3: 0}
    kept = X.drop_toxic(both, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.filter("doc_id > 10000").collect()} == {10_003}


def brute_restore(span, model):
    """The likeliest reading over all paths of a lattice."""
    log = lambda a, b, c: model.log((a << 2 * X.BITS) | (b << X.BITS) | c)
    paths = [(0.0, "", (0, 0))]
    for choices in X.lattice(span):
        grown = []
        for v, t, (a, b) in paths:
            for c, cost in choices:
                s = X.symbol(c) if c else None
                grown.append((v + cost + (log(a, b, s) if c else 0), t + c, (b, s) if c else (a, b)))
        paths = grown
    return max((v + log(a, b, 0), t) for v, t, (a, b) in paths)


def test_viterbi_equals_all_paths(spark, corpus):
    model = X.language_model(corpus[0])
    for span in ("1d10t", "m0r0n", "wo*th", "s c u m", "idiooot", "$am!"):
        made = X.restore_span(span, model)
        assert made == brute_restore(span, model)[1]


def test_long_stretches_are_read_as_a_whole(spark):
    words = ["idiot", "moron", "gentle", "people"] * 50
    model = X.language_model(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))
    for k in range(3):
        assert X.restore(" ".join("".join(words[k:30])), model) == " ".join(words[k:30])


def test_signs_anywhere_and_doubled_letters(spark, rng):
    clean = "better people really pass all tall grass hat shift dim pin"
    text = " ".join(rng.choice([*clean.split(), "ass", "die", "shit", "hate", "piss", "stupid", "idiot"]) for _ in range(4000))
    model = X.language_model(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert X.restore("a$$ a55 d13 shi7 hat3 pi55 stuupid id10t 5tupid", model) == "ass ass die shit hate piss stupid idiot stupid"
    assert X.restore(clean, model) == clean
    assert X.restore("better! 1999 $100,", model) == "better! 1999 $100,"


def test_very_long_words_take_linear_time():
    import time

    model, began = X.CharModel(np.array([ord('a')]), np.array([1])), time.time()
    for text in ("ab" * 200_000 + " yesss", "a1" * 100_000, "x " * 100_000, "$" * 200_000, "!a" * 100_000, "aaa" * 100_000):
        X.restore(text, model)
    assert time.time() - began < 60


def test_character_counts_cover_all_text(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, None), (3, "é")], "doc_id long, text string").repartition(2)
    assert X.trigram_counts(docs).agg({"n": "sum"}).first()[0] > 0
    key = (ord("a") << 2 * X.BITS) | (ord("b") << X.BITS) | ord("a")
    assert X.trigram_counts(docs).filter(f"key = {key}").first().n == 1


def test_character_model_equals_its_formula(spark, rng):
    """Counts of several scripts, dense and sparse ones, give the smoothed shares that plain counting gives."""
    from collections import Counter
    from itertools import product

    texts = ["Слово и дело", "naïve œuvre", "λόγος", "漢字 kana", None, "Ａbc"]
    model = X.language_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    s = [X.symbol(c) for c in X.plain("  ".join(["", *[t or "" for t in texts], ""]))]
    n = Counter(zip(s, s[1:], s[2:], strict=False))
    total, names = sum(n.values()), sorted({k[2] for k in n})
    for a, b, c in product(names[::3], names[::2], names):
        one = (sum(v for k, v in n.items() if k[2] == c) + 1) / (total + len(names) + 1)
        two = (sum(v for k, v in n.items() if k[1:] == (b, c)) + 20 * one) / (sum(v for k, v in n.items() if k[1] == b) + 20)
        three = (n[a, b, c] + 10 * two) / (sum(v for k, v in n.items() if k[:2] == (a, b)) + 10)
        assert abs(model.log((a << 2 * X.BITS) | (b << X.BITS) | c) - np.log(three)) < 1e-9


def test_other_scripts(spark, rng):
    words = "дурак собака человек хорошо слово μωρος λογος idiot people œuvre".split()
    model = X.language_model(spark.createDataFrame([(1, " ".join(rng.choice(words) for _ in range(3000)))], "doc_id long, text string"))
    assert X.restore("дур4к дурaк д у р а к μωρ0ς ｉｄｉｏｔ іdіоt", model).split()[2:] == ["дурак", "μωρος", "idiot", "idiot"]
    assert X.restore("сл0во с0бака", model) == "слово собака"
    assert X.restore("хорошо œuvre 漢字 слово", model) == "хорошо œuvre 漢字 слово"


def test_samples_are_bounded_however_often_an_id_is_repeated(spark):
    from lexichron.llm.common import sampled_rows

    docs = spark.createDataFrame([(1, f"text {i % 40}") for i in range(400)] + [(2, "two"), (3, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    got = sampled_rows(docs, ids, 10).collect()
    assert len(got) == 10 and len({(r.doc_id, r.text) for r in got}) == 10
    assert len(sampled_rows(docs, ids, 1000).collect()) == 42 and sampled_rows(docs, ids, 1000).filter("doc_id = 2").first().label == 1


def test_quality_held_out(spark, corpus):
    docs, labels = corpus
    accuracy, p = held_out_accuracy(Q.quality_scores(docs, labels), labels, "quality")
    assert accuracy > 0.95 and p.score.between(0, 1).all()


def test_quality_from_positives_alone(spark, corpus):
    """No label of 0 is given or needed: junk is told from good text, and the prior comes near the share of good ones."""
    docs, labels = corpus
    good = labels.filter("quality = 1")
    p = Q.quality_scores(docs, good).toPandas().sort_values("doc_id")
    junk = (p.doc_id % 4 == 1).to_numpy()
    assert (p.predicted.to_numpy() == ~junk).mean() > 0.95
    assert p.score.to_numpy().tolist() == Q.quality_scores(docs, labels).toPandas().sort_values("doc_id").score.tolist()


def test_prior_is_found_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        make = lambda n, at: np.pad(rng.normal(at, 0.3, (n, 4)).astype(np.float32), ((0, 0), (0, Q.N_FEATURES - 4)))
        u = np.concatenate([make(int(8000 * share), 1), make(8000 - int(8000 * share), -1)])
        assert abs(Q.class_prior(make(5000, 1), u) - share) < 0.05


def test_quality_on_the_small_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert Q.quality_scores(docs, labels).count() == docs.count()


def test_held_out_labels_are_not_learnt(spark, corpus):
    import zlib

    docs, labels = corpus
    hidden = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    turned = lambda c: F.when(F.col("doc_id").isin(hidden), 1 - F.col(c)).otherwise(F.col(c))
    flipped = labels.withColumns({c: turned(c) for c in ("quality", "toxic")})
    for score in (Q.quality_scores, X.toxicity_scores):
        a, b = (score(docs, x).toPandas().sort_values("doc_id")["score"].to_numpy() for x in (labels, flipped))
        assert np.allclose(a, b)


@pytest.mark.parametrize("score", [Q.quality_scores, X.toxicity_scores])
def test_rows(spark, awkward, nothing, score):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (5, 0, 1, "x"), (5, 1, None, "x"), (6, None, 0, "x"), (99, 1, 1, "x"), (None, 1, 1, "x")], LABELS)
    got = score(awkward, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert score(nothing, labels).collect() == []
    assert len(score(awkward, labels.limit(0)).collect()) == 11
    assert len({r.score for r in score(awkward, labels).collect() if r.doc_id in (1, 2)}) == 1


def test_network_risk_is_not_negative_in_use():
    rng = np.random.default_rng(0)
    p = np.zeros((400, Q.N_FEATURES), np.float32)
    p[:, 0] = rng.normal(1, 0.1, 400)
    u = np.zeros((800, Q.N_FEATURES), np.float32)
    u[:600, 0], u[600:, 0] = rng.normal(1, 0.1, 600), rng.normal(-1, 0.1, 200)
    net = Q.fit_network(p, u, 0.75)
    s = net.score(u)
    assert (s[:600] > 0.5).mean() > 0.95 and (s[600:] < 0.5).mean() > 0.95
    assert abs(s.mean() - 0.75) < 0.02
