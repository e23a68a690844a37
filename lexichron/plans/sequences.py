"""Queries over word streams and speech spans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as S
from . import corpus as C
from .base import query

WORDS_SQL = r"""
tok AS (SELECT doc_id AS episode_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT episode_id, (i)::INTEGER AS pos, w[i + 1] AS text, (i * 400 + (i // 50) * 20000)::BIGINT AS start_ms, (i * 400 + (i // 50) * 20000 + 300)::BIGINT AS end_ms
  FROM tok, unnest(range(len(w))) r(i))
"""
#: Times that step back and words that are too short, for the signals: every 97th word starts a second early, and runs
#: of four in every 61 are 20 ms long.
BENT_SQL = r"""
bent AS (SELECT episode_id, pos, text, CASE WHEN pos % 97 = 96 THEN start_ms - 1000 ELSE start_ms END AS start_ms,
  CASE WHEN pos % 97 = 96 THEN start_ms - 1000 ELSE start_ms END + CASE WHEN pos % 61 < 4 THEN 20 ELSE 300 END AS end_ms FROM words)
"""


def bent_transcripts(t):
    starts = F.transform("starts", lambda s, i: F.when(i % 97 == 96, s - 1000).otherwise(s))
    return t.withColumn("starts", starts).withColumn("ends", F.transform("starts", lambda s, i: s + F.when(i % 61 < 4, 20).otherwise(300)))


def bent(words):
    start = F.when(F.col("pos") % 97 == 96, F.col("start_ms") - 1000).otherwise(F.col("start_ms"))
    return words.withColumns({"start_ms": start, "end_ms": start + F.when(F.col("pos") % 61 < 4, 20).otherwise(300)})


@query("word_timeline", f"WITH {WORDS_SQL} SELECT episode_id, count(*) AS n_words, sum(start_ms)::BIGINT AS sum_start, max(end_ms) AS last_end, md5(string_agg(text, ' ' ORDER BY pos)) AS text_md5 FROM words GROUP BY episode_id")
def word_timeline(spark, sf_dir):
    t = C.transcripts(spark, sf_dir).filter(F.size("tokens") > 0)
    total = F.aggregate("starts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.select(
        "episode_id", F.size("tokens").cast("bigint").alias("n_words"), total.alias("sum_start"), F.array_max("ends").alias("last_end"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("text_md5")
    )


@query(
    "transcript_flatten",
    r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM conversations),
    p AS (SELECT conv_id, turn, r.i, w[r.i + 1] AS text FROM w, unnest(range(len(w))) r(i))
    SELECT conv_id AS episode_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1)::BIGINT AS pos, text FROM p""",
)
def transcript_flatten(spark, sf_dir):
    return S.flatten_chunks(C.chunks(spark, sf_dir))


@query(
    "passages",
    f"""WITH RECURSIVE {WORDS_SQL},
    nxt AS (SELECT a.episode_id, a.pos, a.start_ms,
        (SELECT min(b.pos) FROM words b WHERE b.episode_id = a.episode_id AND b.start_ms >= a.start_ms + 45000) AS stop,
        (SELECT min(b.pos) FROM words b WHERE b.episode_id = a.episode_id AND b.pos > a.pos AND b.start_ms >= a.start_ms + 30000) AS following
      FROM words a WHERE a.pos = 0),
    size AS (SELECT episode_id, count(*) AS n FROM words GROUP BY episode_id),
    cut(episode_id, idx, first, start_ms, stop) AS (
      SELECT episode_id, 0, 0::BIGINT, start_ms, stop FROM nxt
      UNION ALL
      SELECT c.episode_id, c.idx + 1, f.pos, f.pos * 400 + (f.pos // 50) * 20000, t.pos
      FROM cut c, LATERAL (SELECT min(k)::BIGINT AS pos FROM unnest(range(c.first + 1, c.first + 200)) u(k) WHERE k * 400 + (k // 50) * 20000 >= c.start_ms + 30000) f,
        LATERAL (SELECT min(k)::BIGINT AS pos FROM unnest(range(f.pos, f.pos + 200)) u(k) WHERE k * 400 + (k // 50) * 20000 >= f.pos * 400 + (f.pos // 50) * 20000 + 45000) t
        , size s WHERE s.episode_id = c.episode_id AND c.stop < s.n AND c.stop IS NOT NULL),
    p AS (SELECT c.episode_id, c.idx, c.first, c.start_ms, least(coalesce(c.stop, s.n), s.n) AS stop FROM cut c JOIN size s USING (episode_id))
    SELECT p.episode_id, p.idx::INTEGER AS idx, p.start_ms::BIGINT AS start_ms, ((p.stop - 1) * 400 + ((p.stop - 1) // 50) * 20000 + 300)::BIGINT AS end_ms,
      (p.stop - p.first)::INTEGER AS n_words, array_to_string(t.w[p.first + 1 : p.stop], ' ') AS text
    FROM p JOIN tok t USING (episode_id)""",
)
def passages(spark, sf_dir):
    return S.make_passages(C.transcripts(spark, sf_dir))


SPEECH_SQL = """speech AS (SELECT user_id AS episode_id, event_id AS span_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + floor(value * 1000)::BIGINT AS end_ms FROM events)"""
SPLIT_SQL = """cut AS (SELECT episode_id, span_id, p AS piece, start_ms + p * {m} AS start_ms, least(end_ms, start_ms + (p + 1) * {m}) AS end_ms
  FROM speech, unnest(range(greatest(1, ceil((end_ms - start_ms) / {m}.0)::BIGINT))) r(p))"""


@query("split_long_spans", f"WITH {SPEECH_SQL}, {SPLIT_SQL.format(m=60000)} SELECT episode_id, span_id, piece::BIGINT AS piece, start_ms, end_ms FROM cut")
def split_long_spans(spark, sf_dir):
    return S.split_long_spans(C.speech(spark, sf_dir), 60_000).select("episode_id", "span_id", "piece", "start_ms", "end_ms")


@query(
    "chunk_plan",
    f"""WITH RECURSIVE {SPEECH_SQL}, {SPLIT_SQL.format(m=600000)},
    o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms) AS k FROM cut),
    walk(episode_id, k, idx, s, e) AS (
      SELECT episode_id, k, 0, start_ms, end_ms FROM o WHERE k = 1
      UNION ALL
      SELECT w.episode_id, o.k, CASE WHEN o.end_ms - w.s <= 600000 THEN w.idx ELSE w.idx + 1 END, CASE WHEN o.end_ms - w.s <= 600000 THEN w.s ELSE o.start_ms END, o.end_ms
      FROM walk w JOIN o ON o.episode_id = w.episode_id AND o.k = w.k + 1)
    SELECT episode_id, idx, s AS start_ms, max_by(e, k) AS end_ms, count(*)::INTEGER AS n_spans FROM walk GROUP BY episode_id, idx, s""",
)
def chunk_plan(spark, sf_dir):
    return S.chunk_plan(C.speech(spark, sf_dir))


@query("compressed_runs", f"""WITH {WORDS_SQL}, {BENT_SQL}, tiny AS (SELECT *, pos - row_number() OVER (PARTITION BY episode_id ORDER BY pos) AS g FROM bent WHERE end_ms - start_ms < 50)
  SELECT episode_id, min(pos) AS a, max(pos) + 1 AS b FROM tiny GROUP BY episode_id, g HAVING count(*) >= 3""")
def compressed_runs(spark, sf_dir):
    return S.compressed_runs(bent(C.words(spark, sf_dir)))


@query("backward_jumps", f"""WITH {WORDS_SQL}, {BENT_SQL}, j AS (SELECT *, lag(start_ms) OVER (PARTITION BY episode_id ORDER BY pos) - start_ms AS back_ms FROM bent)
  SELECT episode_id, pos, back_ms FROM j WHERE back_ms > 500""")
def backward_jumps(spark, sf_dir):
    return S.backward_jumps(bent(C.words(spark, sf_dir)))


PHRASE_SQL = r"""
norm AS (SELECT episode_id, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}_'']', '', 'g')) AS t FROM tok),
cand AS (SELECT episode_id, r.i::INTEGER AS pos, max(m.n)::INTEGER AS n FROM norm, unnest(range(len(t))) r(i), unnest(range(3, 9)) m(n)
  WHERE t[r.i + 1] = t[r.i + m.n + 1] AND r.i + 2 * m.n <= len(t) AND t[r.i + 1 : r.i + m.n] = t[r.i + m.n + 1 : r.i + 2 * m.n] AND NOT list_contains(t[r.i + 1 : r.i + m.n], '')
  GROUP BY episode_id, r.i)
"""
GREEDY_SQL = """
walk(episode_id, pos, n, free) AS (
  SELECT episode_id, min(pos), min_by(n, pos), min(pos) + 2 * min_by(n, pos) FROM cand GROUP BY episode_id
  UNION ALL
  SELECT w.episode_id, x.pos, x.n, x.pos + 2 * x.n FROM walk w, LATERAL (SELECT min(c.pos) AS pos, min_by(c.n, c.pos) AS n FROM cand c WHERE c.episode_id = w.episode_id AND c.pos >= w.free) x
  WHERE x.pos IS NOT NULL)
"""


@query("repeated_phrase_candidates", f"WITH {WORDS_SQL}, {PHRASE_SQL} SELECT episode_id, pos, n FROM cand")
def repeated_phrase_candidates(spark, sf_dir):
    return S.phrase_candidates(C.transcripts(spark, sf_dir))


@query("repeated_phrases", f"WITH RECURSIVE {WORDS_SQL}, {PHRASE_SQL}, {GREEDY_SQL} SELECT episode_id, pos, n FROM walk")
def repeated_phrases(spark, sf_dir):
    return S.repeated_phrases(C.transcripts(spark, sf_dir))


SUSPECT_SQL = f"""{WORDS_SQL}, {BENT_SQL}, {PHRASE_SQL}, {GREEDY_SQL},
tiny AS (SELECT *, pos - row_number() OVER (PARTITION BY episode_id ORDER BY pos) AS g FROM bent WHERE end_ms - start_ms < 50),
j AS (SELECT *, lag(start_ms) OVER (PARTITION BY episode_id ORDER BY pos) - start_ms AS back_ms FROM bent),
found AS (
  SELECT episode_id, 'compressed' AS kind, min(pos) AS a, max(pos) + 1 AS b FROM tiny GROUP BY episode_id, g HAVING count(*) >= 3
  UNION ALL SELECT episode_id, 'jump', pos - 1, pos + 1 FROM j WHERE back_ms > 500
  UNION ALL SELECT episode_id, 'phrase', pos, pos + 2 * n FROM walk)"""


@query("suspects", f"""WITH RECURSIVE {SUSPECT_SQL}
  SELECT f.episode_id, (row_number() OVER (PARTITION BY f.episode_id ORDER BY f.a, f.kind) - 1)::INTEGER AS ord, f.kind, f.a::INTEGER AS a, f.b::INTEGER AS b, x.start_ms AS at_ms,
    printf('%d:%02d', x.start_ms // 60000, (x.start_ms // 1000) % 60) AS at, array_to_string(w[greatest(0, f.a - 4) + 1 : least(len(w), f.b + 4)], ' ') AS snippet
  FROM found f JOIN tok USING (episode_id) JOIN bent x ON x.episode_id = f.episode_id AND x.pos = f.a""")
def suspects(spark, sf_dir):
    return S.suspects(bent_transcripts(C.transcripts(spark, sf_dir)))


@query("signal_summary", f"""WITH RECURSIVE {SUSPECT_SQL},
  span AS (SELECT episode_id, max_by(end_ms, pos) - min_by(start_ms, pos) AS span_ms FROM bent GROUP BY episode_id),
  k AS (SELECT episode_id, count(*) FILTER (kind = 'compressed') AS compressed, count(*) FILTER (kind = 'jump') AS jump, count(*) FILTER (kind = 'phrase') AS phrase FROM found GROUP BY episode_id)
  SELECT episode_id, span_ms, coalesce(compressed, 0) AS compressed, coalesce(jump, 0) AS jump, coalesce(phrase, 0) AS phrase,
    CASE WHEN span_ms > 0 THEN (coalesce(compressed, 0) + coalesce(jump, 0) + coalesce(phrase, 0)) * 3600000.0::DOUBLE / span_ms ELSE 0.0 END::DOUBLE AS per_hour
  FROM span LEFT JOIN k USING (episode_id)""")
def signal_summary(spark, sf_dir):
    t = bent_transcripts(C.transcripts(spark, sf_dir))
    return S.signal_summary(t, S.suspects(t))


@query("utterance_offsets", """WITH o AS (SELECT conv_id AS group_id, turn AS ord, length(text)::BIGINT AS length FROM conversations),
  s AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY group_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 16 * row_number() OVER (PARTITION BY group_id ORDER BY ord) AS start FROM o)
  SELECT group_id, ord, length, start, start + length AS "end" FROM s""")
def utterance_offsets(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    items = c.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("ord"), F.length("text").cast("bigint").alias("length"))
    return S.utterance_offsets(items, 16)


@query("draft_lines", f"""WITH {WORDS_SQL}, b AS (SELECT *, start_ms // 30000 AS block FROM words),
  m AS (SELECT *, coalesce(block > max(block) OVER (PARTITION BY episode_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS marked,
    coalesce(regexp_matches(lag(text) OVER (PARTITION BY episode_id ORDER BY pos), '[.?!]$'), false) AS ended FROM b),
  p AS (SELECT *, sum((marked OR ended)::INT) OVER (PARTITION BY episode_id ORDER BY pos) AS part FROM m),
  g AS (SELECT episode_id, part, bool_or(marked) AS marked, min_by(start_ms, pos) AS s, string_agg(text, ' ' ORDER BY pos) AS text FROM p GROUP BY episode_id, part),
  l AS (SELECT episode_id, part, 1 AS k, text FROM g UNION ALL
    SELECT episode_id, part, 0, '# ' || CASE WHEN s >= 3600000 THEN printf('%d:%02d:%02d', s // 3600000, (s // 60000) % 60, (s // 1000) % 60) ELSE printf('%d:%02d', s // 60000, (s // 1000) % 60) END FROM g WHERE marked)
  SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY part, k)::INTEGER AS line, text FROM l""")
def draft_lines(spark, sf_dir):
    return S.draft_lines(C.transcripts(spark, sf_dir))
