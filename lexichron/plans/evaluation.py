"""Queries over evaluation metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spoken import SMALL, spoken_words
from ..functions.text import keyword_terms, split_words
from ..operators import evaluation as V
from ..operators import retrieval as R
from ..session import scratch, written
from ..sources import index, store
from . import corpus as C
from . import quotes as P
from .ask import PASSAGE_BITS, passage_pool
from .base import query
from .quotes import HITS_SQL
from .retrieval import terms_sql
from .sequences import SPEECH_SQL

#: All passages are searched; the answer is where the text is said first in the smallest episode that holds it.
EVAL_SQL = rf"""{HITS_SQL},
golden AS (SELECT h.question_id >> {P.TEXT_BITS} AS query_id, min_by(h.episode_id, h.episode_id) AS episode_id, min_by(p.at_ms, (h.episode_id, h.n)) AS answer_ms
  FROM placed p JOIN hit h USING (question_id, n) WHERE p.at_ms IS NOT NULL GROUP BY 1),
pool AS (SELECT (episode_id << {PASSAGE_BITS}) + idx AS id, episode_id, start_ms, end_ms, text FROM passage),
asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id IN (SELECT query_id FROM golden)),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms_sql("text")}) AS term FROM pool) GROUP BY id, term),
qt AS (SELECT query_id, unnest(list_distinct({terms_sql("text")})) AS term FROM asked),
sc AS (SELECT query_id, id, sum(tf)::BIGINT AS score FROM post JOIN qt USING (term) GROUP BY query_id, id),
kleg AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 50),
ew AS (SELECT 'p' AS side, id, unnest(regexp_split_to_array(lower(trim(text)), '\s+')) AS w FROM pool UNION ALL SELECT 'q', query_id, unnest(regexp_split_to_array(lower(trim(text)), '\s+')) FROM asked),
en AS (SELECT side, id, (('0x' || md5(w)[25:32])::BIGINT % 64)::INTEGER AS bucket, count(*) AS n FROM (SELECT side, id, regexp_replace(w, '^[.,?!]+|[.,?!]+$', '', 'g') AS w FROM ew) WHERE w <> '' GROUP BY 1, 2, 3),
em AS (SELECT side, id, map(list(bucket), list(wt)) AS m FROM (SELECT side, id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY side, id)))::FLOAT AS wt FROM en) GROUP BY side, id),
ev AS (SELECT side, id, list_transform(range(64), lambda b: coalesce(m[b::INTEGER], 0)::DOUBLE) AS e FROM em),
es AS (SELECT *, sqrt(list_inner_product(e, e)) AS size FROM ev),
vd AS (SELECT q.id AS query_id, v.id, 1 - list_inner_product(q.e, v.e) / (q.size * v.size) AS d FROM es q JOIN es v ON q.side = 'q' AND v.side = 'p'),
vleg AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM vd) WHERE rank <= 50),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + k.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + x.rank), 0.0::DOUBLE) AS score FROM kleg k FULL JOIN vleg x USING (query_id, id))),
ov AS (SELECT l.query_id, l.id, row_number() OVER (PARTITION BY l.query_id ORDER BY len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(trim(b.text)), '\s+'), lambda w: w <> '')), list_distinct(list_filter(regexp_split_to_array(lower(trim(p.text)), '\s+'), lambda w: w <> '')))) DESC, l.rank) AS rank
  FROM fu l JOIN pool p USING (id) JOIN asked b USING (query_id) WHERE l.rank <= 20),
res AS (SELECT 'keyword' AS mode, query_id, id, rank FROM kleg WHERE rank <= 10 UNION ALL SELECT 'vector', query_id, id, rank FROM vleg WHERE rank <= 10
  UNION ALL SELECT 'hybrid', query_id, id, rank FROM fu WHERE rank <= 10 UNION ALL SELECT 'rerank', query_id, id, rank FROM ov WHERE rank <= 10),
jud AS (SELECT r.mode, r.query_id, r.rank, g.answer_ms - p.start_ms AS off, p.episode_id = g.episode_id AND p.start_ms - 500 <= g.answer_ms AND g.answer_ms <= p.end_ms + 500 AS ok
  FROM res r JOIN pool p USING (id) JOIN golden g USING (query_id)),
fir AS (SELECT m.mode, g.query_id, min(j.rank) FILTER (j.ok) AS rank, max(j.off) FILTER (j.ok AND j.rank = 1) AS off
  FROM (VALUES ('keyword'), ('vector'), ('hybrid'), ('rerank')) m(mode) CROSS JOIN golden g LEFT JOIN jud j ON j.mode = m.mode AND j.query_id = g.query_id GROUP BY 1, 2)
"""


def golden(spark, sf_dir, asked):
    """query_id, episode_id, answer_ms: where each benchmark text is said first, in the smallest episode."""
    from ..operators import quotes as Q

    h = P.hits(spark, sf_dir, asked).join(asked.select("question_id", "quote"), "question_id")
    at = Q.located(h, C.transcripts(spark, sf_dir)).filter("at_ms IS NOT NULL").withColumn("query_id", F.shiftright("question_id", P.TEXT_BITS))
    return written(at.groupBy("query_id").agg(F.min("episode_id").alias("episode_id"), F.min_by("at_ms", F.struct("episode_id", "n")).alias("answer_ms")))


def results(spark, sf_dir, golden):
    """mode, query_id, rank, episode_id, start_ms, end_ms of searches over all passages: keyword, vector, both fused, and the
    fused shortlist reranked."""
    pool = passage_pool(spark, sf_dir)
    q = C.questions(spark, sf_dir).join(golden.select("query_id"), "query_id", "left_semi")
    keyword = written(R.keyword_search(pool, q))
    asked = R.hash_embed(q.select(F.col("query_id").alias("id"), F.col("question").alias("text"))).withColumnRenamed("id", "query_id")
    vector = written(R.vector_leg(R.hash_embed(pool), written(asked)))
    both = written(R.fused(keyword, vector))
    places = pool.select("id", "episode_id", "start_ms", "end_ms")
    columns = ["query_id", "rank", "episode_id", "start_ms", "end_ms"]
    again = R.rerank(R.hydrate(both, pool), q, 10).select(F.lit("rerank").alias("mode"), *columns)
    for mode, leg in (("keyword", keyword), ("vector", vector), ("hybrid", both)):
        again = again.unionByName(R.hydrate(leg.filter("rank <= 10").select("query_id", "id", "rank"), places).select(F.lit(mode).alias("mode"), *columns))
    return again


@query("stored_hybrid", f"WITH RECURSIVE {EVAL_SQL} SELECT query_id, id, rank::INTEGER AS rank, score FROM fu WHERE rank <= 10")
def stored_hybrid(spark, sf_dir):
    """Passages stored and indexed, then found by the stored index alone."""
    root, pool = scratch(spark), passage_pool(spark, sf_dir)
    store.apply_schema(spark, root)
    store.append(R.embedded(pool).select("id", "episode_id", "idx", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text", "embedding", F.lit("hash-1").alias("embed_model")), root, "passages")
    index.refresh_search(spark, root, keyword_terms)
    said = golden(spark, sf_dir, P.pairs(spark, sf_dir)).select("query_id")
    q = C.questions(spark, sf_dir).join(said, "query_id", "left_semi")
    return index.search_stored(spark, root, q, k=10, analyze=keyword_terms, exact=True).select("query_id", "id", "rank", "score")


@query("retrieval_first_hits", f"WITH RECURSIVE {EVAL_SQL} SELECT mode, query_id, rank::INTEGER AS rank, off::BIGINT AS offset_ms FROM fir")
def retrieval_first_hits(spark, sf_dir):
    pairs = P.pairs(spark, sf_dir)
    g = golden(spark, sf_dir, pairs)
    return V.first_correct(results(spark, sf_dir, g), g)


@query("retrieval_eval", f"""WITH RECURSIVE {EVAL_SQL} SELECT mode, count(*) AS queries, avg((coalesce(rank, 99) <= 1)::INT) AS recall_1, avg((coalesce(rank, 99) <= 5)::INT) AS recall_5, avg((coalesce(rank, 99) <= 10)::INT) AS recall_10,
  avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr, median(off)::DOUBLE AS median_offset_ms, avg(coalesce((off <= 15000)::INT, 0)) AS within FROM fir GROUP BY mode""")
def retrieval_eval(spark, sf_dir):
    return V.retrieval_metrics(retrieval_first_hits(spark, sf_dir))


ANSWERS_SQL = """
answers AS (SELECT event_id AS question_id, event_id % 5 <> 0 AS found, event_id % 6 = 0 AS repaired, event_id % 4 AS removed, event_id % 3 AS rejected, floor(value * 10)::BIGINT AS tokens, value AS seconds FROM events),
gold AS (SELECT event_id AS question_id, user_id AS episode_id, floor(value * 1000)::BIGINT AS answer_ms FROM events),
cites AS (SELECT event_id AS question_id, CASE WHEN event_id % 8 = 0 THEN user_id + 1 ELSE user_id END AS episode_id, floor(value * 1000)::BIGINT + k * (event_id % 40) * 1000 AS at_ms FROM events, unnest([1, 3]) r(k) WHERE event_id % 5 <> 0)
"""


@query("answers_eval", f"""WITH {ANSWERS_SQL}, best AS (SELECT c.question_id, count(*) AS cited, bool_or(c.episode_id = g.episode_id) AS ok, min(abs(at_ms - answer_ms)) FILTER (c.episode_id = g.episode_id) AS off FROM cites c JOIN gold g USING (question_id) GROUP BY 1)
  SELECT count(*) AS questions, avg(found::INT) AS answered, avg(coalesce(ok, false)::INT) AS right_episode, avg(repaired::INT) AS repaired, avg(coalesce(off <= 15000, false)::INT) AS within_15s, avg(coalesce(off <= 60000, false)::INT) AS within_60s,
    (sum(rejected) / (sum(rejected) + coalesce(sum(cited), 0)))::DOUBLE AS rejected_rate, count(*) FILTER (removed > 0) AS lost_sentences, avg(tokens) AS mean_tokens, median(seconds)::DOUBLE AS p50_seconds
  FROM answers LEFT JOIN best USING (question_id)""")
def answers_eval(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, ms = F.col("event_id"), F.floor(F.col("value") * 1000).cast("bigint")
    answers = e.select(
        i.alias("question_id"), (i % 5 != 0).alias("found"), (i % 6 == 0).alias("repaired"), (i % 4).alias("removed"), (i % 3).alias("rejected"), F.floor(F.col("value") * 10).cast("bigint").alias("tokens"), F.col("value").alias("seconds")
    )
    gold = e.select(i.alias("question_id"), F.col("user_id").alias("episode_id"), ms.alias("answer_ms"))
    cites = e.filter(i % 5 != 0).select(
        i.alias("question_id"), F.when(i % 8 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("episode_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("k"), ms.alias("ms")
    )
    cites = cites.select("question_id", "episode_id", (F.col("ms") + F.col("k") * (F.col("question_id") % 40) * 1000).alias("at_ms"))
    return V.answer_metrics(answers, cites, gold)


def spoken_pairs(spark, sf_dir):
    """pair_id, ref, hyp: benchmark texts, and a hearing of them that drops every seventh word and mishears every fifth."""
    w = split_words(F.col("text"))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("pair_id"), w.alias("ref"))
    heard = F.transform(F.filter(F.transform("ref", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: s["i"] % 7 != 6), lambda s: F.when(s["i"] % 5 == 4, F.lit("uh")).otherwise(s["w"]))
    return b.withColumn("hyp", heard)


PAIRS_SQL = r"""
r AS (SELECT item_id AS pair_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS ref FROM benchmark),
p AS (SELECT pair_id, ref, list_transform(list_filter(range(len(ref)), lambda i: i % 7 <> 6), lambda i: CASE WHEN i % 5 = 4 THEN 'uh' ELSE ref[i + 1] END) AS hyp FROM r),
n AS (SELECT *, list_distinct(list_concat(ref, hyp)) AS names FROM p),
e AS (SELECT pair_id, ref, levenshtein(array_to_string(list_transform(ref, lambda w: chr(list_position(names, w)::INTEGER + 32)), ''), array_to_string(list_transform(hyp, lambda w: chr(list_position(names, w)::INTEGER + 32)), '')) AS edits FROM n)
"""


@query("wer_pooled", f"WITH {PAIRS_SQL} SELECT sum(edits)::BIGINT AS edits, sum(len(ref))::BIGINT AS words, sum(edits)::DOUBLE / sum(len(ref)) AS wer FROM e WHERE len(ref) > 0")
def wer_pooled(spark, sf_dir):
    return V.pooled_wer(spoken_pairs(spark, sf_dir))


@query("wer_by_pair", f"WITH {PAIRS_SQL} SELECT pair_id, edits::BIGINT AS edits, len(ref)::BIGINT AS words FROM e")
def wer_by_pair(spark, sf_dir):
    steps = V.error_counts(V.alignments(spoken_pairs(spark, sf_dir)))
    words = spoken_pairs(spark, sf_dir).select("pair_id", F.size("ref").cast("bigint").alias("words"))
    return steps.join(words, "pair_id").select("pair_id", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("edits"), "words")


@query("top_substitutions")
def top_substitutions(spark, sf_dir):
    return V.top_substitutions(V.alignments(spoken_pairs(spark, sf_dir)))


@query("timing_summary", """WITH o AS (SELECT greatest(10 - value, 0.0, value - 60)::DOUBLE AS outside FROM events), s AS (SELECT count(*) AS n, avg((outside <= 0)::INT) AS inside_rate, list_sort(list(outside)) AS s, max(outside) AS worst FROM o)
  SELECT n, inside_rate, s[floor(0.95 * (n - 1))::BIGINT + 1] AS p95, worst FROM s""")
def timing_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return V.timing_summary(e.select(V.outside_seconds(F.col("value"), F.lit(10.0), F.lit(60.0)).alias("outside")))


@query("golden_sample", f"""WITH {SPEECH_SQL}, s AS (SELECT episode_id, span_id AS idx FROM speech), n AS (SELECT greatest(1, 300 // count(DISTINCT episode_id)) AS m FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY md5('42-' || episode_id || '-' || idx), idx) AS r FROM s) SELECT episode_id, idx FROM r, n WHERE r <= m""")
def golden_sample(spark, sf_dir):
    s = C.speech(spark, sf_dir).select("episode_id", F.col("span_id").alias("idx"))
    return V.golden_sample(s, 300)


@query("golden_lookup", """WITH g AS (SELECT b.item_id, d.source AS feed_url, 'doc-' || d.doc_id || CASE WHEN b.item_id % 4 = 0 THEN '-gone' ELSE '' END AS guid FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
  e AS (SELECT doc_id AS id, source AS feed_url, 'doc-' || doc_id AS guid FROM documents)
  SELECT count(e.id) AS found, count(*) FILTER (e.id IS NULL) AS missing FROM g LEFT JOIN e USING (feed_url, guid)""")
def golden_lookup(spark, sf_dir):
    e = C.episodes(spark, sf_dir)
    gone = F.when(F.col("query_id") % 4 == 0, F.concat("guid", F.lit("-gone"))).otherwise(F.col("guid"))
    g = C.questions(spark, sf_dir).join(e.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "question", "feed_url", gone.alias("guid"))
    return V.lookup_golden(g, e)[1]


@query("wer_normalized", r"""WITH n AS (SELECT item_id AS pair_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-–—]', ' ', 'g'), '[^\p{L}\p{N}\s'']', '', 'g'), '(^|\s)''+|''+(\s|$)', '\1\2', 'g'), '\s+'), lambda w: w <> '') AS ref FROM benchmark)
  SELECT pair_id, len(ref)::BIGINT AS words, md5(array_to_string(ref, ' ')) AS words_md5 FROM n WHERE len(ref) > 0""")
def wer_normalized(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("pair_id"), F.col("text").alias("ref"), F.upper("text").alias("hyp"))
    return V.normalized_pairs(b).select("pair_id", F.size("ref").cast("bigint").alias("words"), F.md5(F.array_join("ref", " ").cast("binary")).alias("words_md5"))


@query("spoken_numbers", """SELECT item_id AS pair_id, 'item ' || item_id || '% of $' || (item_id % 1000) || ' mister' AS form FROM benchmark""")
def spoken_numbers(spark, sf_dir):
    """Numbers read out digit by digit, written as numbers; the same form either way."""
    digits = F.array(*map(F.lit, SMALL[:10]))
    said = lambda n: F.array_join(F.transform(F.split(n.cast("string"), ""), lambda d: F.element_at(digits, d.cast("int") + 1)), " ")
    i = F.col("item_id")
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    heard = b.select(i.alias("pair_id"), F.concat(F.lit("Item "), said(i), F.lit(" percent, um, of "), said(i % 1000), F.lit(" dollars, Mr."), F.lit("")).alias("text"))
    return heard.select("pair_id", F.array_join(spoken_words("text"), " ").alias("form"))
