import pytest
from pyspark.sql import functions as F

from lexichron.functions import text as T
from lexichron.operators import quotes as Q

PASSAGE = "Well the harbour crane stood idle all winter because of salt. We can’t simply grease it; the whole gear needs replacing."


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.quote_tokens(F.lit("We CAN’T simply grease!"))) == ["we", "can't", "simply", "grease"]


@pytest.mark.parametrize(
    ("quote", "want"),
    [
        ("harbour crane stood idle all winter", True),
        ("because of salt: we can't simply grease it", True),
        ("harbour crane stood broken all winter", False),
        ("the harbour", False),
        ("ｈａｒｂｏｕｒ ｃｒａｎｅ ｓｔｏｏｄ ｉｄｌｅ", True),
    ],
)
def test_quote_in_text(spark, quote, want):
    assert one(spark, T.contains_phrase(T.quote_tokens(F.lit(PASSAGE)), T.quote_tokens(T.folded(F.lit(quote))))) is want
    quotes = spark.createDataFrame([(1, quote)], "quote_id long, quote string")
    texts = spark.createDataFrame([(2, PASSAGE), (3, "nothing of the kind here at all"), (4, None)], "text_id long, text string")
    assert [tuple(r) for r in Q.find_quotes(quotes, texts).collect()] == ([(1, 2)] if want else [])


def test_locate(spark):
    words = PASSAGE.split()
    tokens, starts = F.array(*map(F.lit, words)), F.array(*[F.lit(100_000 + 500 * i) for i in range(len(words))])
    needle = T.quote_tokens(F.lit("because of salt. We can't"))
    assert one(spark, Q.locate(needle, tokens, starts, F.lit(99_000), F.lit(121_000))) == 104_000
    assert one(spark, Q.locate(needle, tokens, starts, F.lit(104_500), F.lit(121_000))) is None


@pytest.mark.parametrize(
    ("text", "ok", "kept", "removed"),
    [
        ("Tin melts early [3]. Lead [4] later! Iron last [3]?", [3], "Tin melts early [3]. Iron last [3]?", 1),
        ("Zinc [5][6][7].", [6], "Zinc [6].", 0),
        ("Opinion. More of it. Copper conducts [2].", [2, 9], "Copper conducts [2].", 2),
        ("Salt, unmarked.", [2], "", 1),
        ("", [1], "", 0),
        ("  Gold [8].  ", [8], "Gold [8].", 0),
        ("Ore [08][99999999999]. Slag [99999999999].", [8], "Ore [08].", 1),
        ("Ash [8] [7] rises.", [8], "Ash [8] rises.", 0),
    ],
)
def test_supported(spark, text, ok, kept, removed):
    got = one(spark, Q.supported(F.lit(text), F.array(*map(F.lit, ok))))
    assert (got.kept, got.removed) == (kept, removed)


def test_compatibility_forms_count_as_plain_ones(spark):
    texts = spark.createDataFrame([(1, "The ﬁrst ﬂight of № ten lasted 3½ hours"), (2, "the first flight of no ten lasted")], "text_id long, text string")
    quotes = spark.createDataFrame([(1, "first flight of No ten lasted")], "quote_id long, quote string")
    assert sorted(tuple(r) for r in Q.find_quotes(quotes, texts).collect()) == [(1, 1), (1, 2)]
    t = spark.createDataFrame([(9, ["The", "ﬁrst", "ﬂight", "of", "№", "ten"], [0, 500, 1000, 1500, 2000, 2500])], "episode_id long, tokens array<string>, starts array<long>")
    q = spark.createDataFrame([(1, 9, "First flight of no ten", 0, 3_000)], "question_id long, episode_id long, quote string, start_ms long, end_ms long")
    assert [r.at_ms for r in Q.located(q, t).collect()] == [500]


def test_marker_split(spark):
    parts = one(spark, T.citation_parts(F.lit("Open models matter[2][3]. Done[1].")))
    assert [(p.kind, p.value) for p in parts] == [("text", "Open models matter"), ("marker", "2"), ("marker", "3"), ("text", ". Done"), ("marker", "1"), ("text", ".")]


@pytest.mark.parametrize(("s", "want"), [(0.0, "0:00"), (328.9, "5:28"), (3725.0, "1:02:05"), (-4.0, "0:00")])
def test_clock(spark, s, want):
    assert one(spark, T.clock(F.lit(s))) == want


def test_verdicts_order_of_rules(spark):
    words = PASSAGE.split()
    t = spark.createDataFrame([(9, words, [500 * i for i in range(len(words))])], "episode_id long, tokens array<string>, starts array<long>")
    hits = spark.createDataFrame([(1, 1, 9, 0, 20_000)], "question_id long, n int, episode_id long, start_ms long, end_ms long")
    good = "the harbour crane stood idle all winter"
    cited = spark.createDataFrame(
        [(1, 0, 1, good), (1, 1, 2, good + "?"), (1, 2, 1, good + "?"), (1, 3, 1, "this was never said by anyone"), (1, 4, None, good), (1, 5, 1, None)], "question_id long, ord int, n int, quote string"
    )
    got = {r.ord: (r.reason, r.at_ms) for r in Q.verdicts(cited, hits, t).collect()}
    assert got[0] == (None, 500)
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == [Q.NO_PASSAGE, Q.QUESTION, Q.NOT_FOUND, Q.NO_PASSAGE, Q.NO_PASSAGE]


def test_parse_citations_of_a_wrong_shape(spark):
    raw = spark.createDataFrame([(1, '[{"n": 1, "quote": "a"}, {"n": "x"}]'), (2, "no json"), (3, None)], "question_id long, citations string")
    rows = Q.parse_citations(raw).filter("question_id = 1").orderBy("ord").collect()
    assert rows[0].n == 1
    assert len(Q.parse_citations(raw).collect()) >= 3


def test_attempts(spark):
    schema = "question_id long, kept string, rejected long"
    first = spark.createDataFrame([(1, "ab", 1), (2, "ab", 1), (3, "ab", 0), (4, "ab", 2)], schema)
    second = spark.createDataFrame([(1, "abc", 1), (2, "xy", 1), (3, "abcdef", 1)], schema)
    got = {r.question_id: (r.kept, r.repaired, r.rejected) for r in Q.choose_attempt(first, second).collect()}
    assert got == {1: ("abc", True, 2), 2: ("ab", False, 2), 3: ("ab", False, 0), 4: ("ab", False, 2)}


def test_ask_end_to_end(spark):
    from lexichron.plans.ask import ask

    words = PASSAGE.split()
    t = spark.createDataFrame([(9, words, [500 * i for i in range(len(words))])], "episode_id long, tokens array<string>, starts array<long>")
    hits = spark.createDataFrame([(1, 1, 9, "Harbours", 0, 20_000, PASSAGE)], "question_id long, n int, episode_id long, title string, start_ms long, end_ms long, text string")
    questions = spark.createDataFrame([(1, "what stood idle?"), (2, "nobody knows?")], "question_id long, question string")
    got = {r.question_id: r for r in ask(questions, hits, t).collect()}
    assert got[1].answer == "Well the harbour crane stood idle all winter [1]." and got[1].citations[0].at_ms == 0
    assert got[2].answer is None and got[2].refusal == "no passages"

    def lying(prompts):
        reply = '{"found": true, "answer": "It was magic [1]. Truly [1].", "citations": [{"n": 1, "quote": "it was all done by magic"}]}'
        return prompts.select("question_id", F.lit(reply).alias("reply"))

    from lexichron.models import extractive

    fixed = {r.question_id: r for r in ask(questions, hits, t, lying, extractive).collect()}
    assert fixed[1].repaired and fixed[1].rejected == 1 and fixed[1].answer.startswith("Well the harbour crane")
    assert {r.question_id: r.refusal for r in ask(questions, hits, t, lying).collect()}[1] == "nothing supported"


def test_texts_stay_where_they_are(spark, tmp_path):
    """Few proposed pairs go to the texts; the texts are not shuffled, and only texts of a pair are folded again."""
    texts = [(i, f"number {i} of many texts " * 3) for i in range(50)] + [(99, "here we said it word for word again")]
    spark.createDataFrame(texts, "text_id long, text string").write.parquet(str(tmp_path / "t"))
    quotes = spark.createDataFrame([(1, "said it word for word"), (2, "nobody said this at all")], "quote_id long, quote string")
    found = Q.find_quotes(quotes, spark.read.parquet(str(tmp_path / "t")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert [tuple(r) for r in found.collect()] == [(1, 99)]
