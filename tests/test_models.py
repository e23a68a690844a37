"""Models on the executors: loaded once a worker, asked again after errors."""

import json
import os

from pyspark.sql import functions as F

from lexichron.models import RateLimited, asking, embedding, loaded
from lexichron.operators import retrieval as R
from lexichron.plans.ask import ask


def flaky(folder):
    """A model that notes each load, fails the first call of every third prompt, and refuses some for good."""

    def load():
        with open(f"{folder}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        seen = set()

        def model(prompt):
            n = int(prompt.split()[-1])
            if n % 3 == 0 and prompt not in seen:
                seen.add(prompt)
                raise RateLimited(1.0) if n % 2 else ConnectionError("reset")
            if n == 7:
                raise ValueError("no")
            return f"reply {n}"

        return model

    return load


def test_one_load_a_worker_and_retries_inside(spark, tmp_path):
    slept = str(tmp_path / "slept")

    def sleep(seconds):
        with open(slept, "a") as f:
            f.write(f"{seconds}\n")

    prompts = spark.range(40).select(F.col("id").alias("question_id"), F.concat(F.lit("prompt "), F.col("id")).alias("prompt")).repartition(8)
    generate = asking(f"flaky-{tmp_path.name}", flaky(str(tmp_path)), sleep)
    rows = {r.question_id: r for r in generate(prompts).collect()}
    assert len(rows) == 40 and rows[5].reply == "reply 5" and rows[5].tries == 1
    assert all(rows[i].tries == 2 and rows[i].reply == f"reply {i}" for i in range(0, 40, 3))
    assert rows[7].reply is None and rows[7].error == "ValueError: no"
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) <= 8  # eight tasks, no worker loads twice
    assert len(open(slept).read().split()) == 14
    again = generate(prompts).filter("reply IS NOT NULL").count()
    loads = (tmp_path / "loads").read_text().split()
    assert again == 39 and len(loads) == len(set(loads))


def test_loaded_keeps_what_it_has():
    made = []
    assert loaded("kept-by-test", lambda: made.append(1) or len(made)) == loaded("kept-by-test", lambda: 9) == 1


def test_ask_through_a_model(spark):
    def load():
        return lambda prompt: json.dumps({"found": True, "answer": "It flows north [1].", "citations": [{"n": 1, "quote": "the river flows far north"}]})

    q = spark.createDataFrame([(1, "where does it flow?")], "question_id long, question string")
    hits = spark.createDataFrame([(1, 1, 5, "t", 0, 3_000, "the river flows far north")], "question_id long, n int, episode_id long, title string, start_ms long, end_ms long, text string")
    t = spark.createDataFrame([(5, "the river flows far north".split(), [0, 400, 800, 1_200, 1_600])], "episode_id long, tokens array<string>, starts array<long>")
    r = ask(q, hits, t, asking("constant", load)).first()
    assert r.answer == "It flows north [1]." and r.citations[0].at_ms == 0


def test_embedding_by_batches(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, text string")
    got = {r.id: list(r.embedding) for r in embedding(load, 2)(docs).collect()}
    assert got == {1: [3.0, 1.0], 3: [0.0, 1.0]}
    rows = docs.select("id", "text", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embed_model"))
    assert R.embed_pending(rows, "len", embedding(load)).filter("embedding IS NOT NULL").count() == 2
