"""Queries over quotes, citations and answers, with their SQL.

Questions are the pairs of a benchmark text and a document that holds it word for word; a question's hits are the
document's passages, numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import citation_parts, folded, quote_tokens
from ..operators import quotes as Q
from ..operators.sequence import make_passages
from ..session import spread, table, written
from . import corpus as C
from . import sequences  # noqa: F401  (its passages query comes first)
from .base import ORACLES, query

#: A question's number is its quote's above the text's, which has so many bits.
TEXT_BITS = 40
TOKENS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(translate({x}, '‘’', '''''')), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+'), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: w <> '')"


def tokens_sql(x: str) -> str:
    return TOKENS.format(x=x)


PAIRS_SQL = f"""
d AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents),
b AS (SELECT item_id, text, {tokens_sql("text")} AS t FROM benchmark),
pairs AS (SELECT b.item_id AS quote_id, d.doc_id AS text_id, b.text AS quote, b.t AS needle
  FROM b JOIN d ON len(b.t) >= 4 AND contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(b.t, ' ') || ' '))
"""


def pairs(spark, sf_dir):
    """question_id, episode_id, quote of every question."""
    quotes = C.questions(spark, sf_dir).select(F.col("query_id").alias("quote_id"), F.col("question").alias("quote"))
    texts = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("text_id"), "text")
    found = Q.find_quotes(quotes, texts).join(quotes, "quote_id")
    return written(found.select((F.shiftleft("quote_id", TEXT_BITS) + F.col("text_id")).alias("question_id"), F.col("text_id").alias("episode_id"), "quote"))


def hits(spark, sf_dir, asked=None):
    """question_id, n, episode_id, start_ms, end_ms, text: the passages of each question's document."""
    asked = pairs(spark, sf_dir) if asked is None else asked
    p = make_passages(C.transcripts(spark, sf_dir).join(asked.select("episode_id").distinct(), "episode_id", "left_semi"))
    return asked.join(p, "episode_id").select("question_id", (F.col("idx") + 1).alias("n"), "episode_id", "start_ms", "end_ms", "text")


@query("normalize_tokens", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def normalize_tokens(spark, sf_dir):
    t = spread(table(spark, sf_dir, "documents")).select("doc_id", quote_tokens(folded(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query("quote_in_text", f"WITH {PAIRS_SQL} SELECT quote_id, text_id FROM pairs")
def quote_in_text(spark, sf_dir):
    return pairs(spark, sf_dir).select(F.shiftright("question_id", TEXT_BITS).alias("quote_id"), F.col("episode_id").alias("text_id"))


PASSAGE_SQL = ORACLES["passages"].replace("WITH RECURSIVE ", "", 1)
_HEAD, _, _TAIL = PASSAGE_SQL.rpartition("SELECT p.episode_id")
HITS_SQL = f"""
{_HEAD.rstrip()}, passage AS (SELECT p.episode_id{_TAIL}),
{PAIRS_SQL.strip()},
hit AS (SELECT (quote_id << {TEXT_BITS}) + text_id AS question_id, idx + 1 AS n, episode_id, start_ms, end_ms, text, quote, needle FROM pairs JOIN passage ON episode_id = text_id),
part AS (SELECT h.question_id, h.n, h.start_ms AS from_ms, w.pos, w.start_ms, {tokens_sql("w.text")} AS t, h.end_ms
  FROM hit h JOIN words w ON w.episode_id = h.episode_id AND w.start_ms BETWEEN h.start_ms - 1000 AND h.end_ms + 1000),
flat AS (SELECT question_id, n, flatten(list(t ORDER BY pos)) AS t, flatten(list(list_transform(t, lambda x: start_ms) ORDER BY pos)) AS s FROM part GROUP BY question_id, n),
spot AS (SELECT f.question_id, f.n, h.quote,
    instr(' ' || array_to_string(f.t, ' ') || ' ', ' ' || array_to_string(h.needle, ' ') || ' ') AS plc, ' ' || array_to_string(f.t, ' ') || ' ' AS hay, f.s
  FROM flat f JOIN hit h USING (question_id, n)),
placed AS (SELECT question_id, n, quote, CASE WHEN plc > 0 THEN s[length(hay[1:plc]) - length(replace(hay[1:plc], ' ', ''))] END AS at_ms FROM spot)
"""


@query("locate_quote", f"WITH RECURSIVE {HITS_SQL} SELECT question_id, n::INTEGER AS n, at_ms::BIGINT AS at_ms FROM placed")
def locate_quote(spark, sf_dir):
    asked = pairs(spark, sf_dir)
    q = hits(spark, sf_dir, asked).join(asked.select("question_id", "quote"), "question_id")
    return Q.located(q, C.transcripts(spark, sf_dir)).select("question_id", "n", "at_ms")


def raw_citations(asked, hits):
    """question_id, citations: a model's JSON with, for each question, a quote for every passage and five bad ones."""
    n = hits.groupBy("question_id").agg(F.max("n").alias("last"))
    cite = lambda k, q: F.struct(k.cast("int").alias("n"), q.alias("quote"))
    made = F.concat(
        F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: cite(i, F.col("quote"))),
        F.array(
            cite(F.col("last") + 1, F.col("quote")),
            cite(F.lit(1), F.concat("quote", F.lit("?"))),
            cite(F.lit(1), F.lit("words that nobody ever said anywhere")),
            cite(F.lit(1), F.lit("too short")),
            cite(F.lit(None), F.col("quote")),
        ),
    )
    return asked.join(n, "question_id").select("question_id", F.to_json(made).alias("citations"))


CITED_SQL = """
last AS (SELECT question_id, max(n)::INTEGER AS last, any_value(quote) AS quote FROM hit GROUP BY question_id),
cited AS (
  SELECT question_id, (i - 1)::INTEGER AS ord, i::INTEGER AS n, quote FROM last, unnest(range(1, last + 1)) r(i)
  UNION ALL SELECT question_id, last, last + 1, quote FROM last
  UNION ALL SELECT question_id, last + 1, 1, quote || '?' FROM last
  UNION ALL SELECT question_id, last + 2, 1, 'words that nobody ever said anywhere' FROM last
  UNION ALL SELECT question_id, last + 3, 1, 'too short' FROM last
  UNION ALL SELECT question_id, last + 4, NULL, quote FROM last),
verdict AS (SELECT c.question_id, c.ord, c.n, CASE WHEN c.n IS NULL OR c.n > l.last THEN 'no such passage' WHEN contains(c.quote, '?') THEN 'quote is a question, not a statement'
    WHEN c.quote = l.quote AND p.at_ms IS NOT NULL THEN NULL ELSE 'quote not found verbatim in passage' END AS reason, p.at_ms AS found_ms
  FROM cited c JOIN last l USING (question_id) LEFT JOIN placed p ON p.question_id = c.question_id AND p.n = c.n)
"""


def critic(spark, sf_dir):
    asked = pairs(spark, sf_dir)
    found = written(hits(spark, sf_dir, asked).drop("text"))
    return Q.verdicts(Q.parse_citations(raw_citations(asked, found)), found, C.transcripts(spark, sf_dir))


@query("critic_verdicts", f"WITH RECURSIVE {HITS_SQL}, {CITED_SQL} SELECT question_id, ord, n, reason, CASE WHEN reason IS NULL THEN found_ms::BIGINT END AS at_ms FROM verdict")
def critic_verdicts(spark, sf_dir):
    return critic(spark, sf_dir).select("question_id", "ord", "n", "reason", "at_ms")


@query("reject_reasons", f"WITH RECURSIVE {HITS_SQL}, {CITED_SQL} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM verdict GROUP BY 1")
def reject_reasons(spark, sf_dir):
    return critic(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


#: Answers with markers: sentences of assistant turns, marked by their last letter.
ANSWER_SQL = r"""
marked AS (SELECT conv_id, turn,
  regexp_replace(regexp_replace(regexp_replace(text, 'e\.\s', 'e [1]. ', 'g'), 'n\.\s', 'n  [2]. ', 'g'), 's\.\s', 's [3][1]. ', 'g') AS text FROM conversations WHERE role = 'assistant'),
answer AS (SELECT conv_id * 1000 + turn AS question_id, conv_id % 2 = 0 AS even,
  CASE WHEN conv_id % 11 = 0 THEN '  ' || text || ' Large [99999999999]. Padded [01][99999999999] [002].' || chr(10) ELSE text END AS text FROM marked),
bare AS (SELECT question_id, even, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM answer),
sentence AS (SELECT question_id, even, r.i, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[r.i] AS s
  FROM bare, unnest(range(1, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) + 1)) r(i)),
mark AS (SELECT *, CASE WHEN even THEN list_has_any(list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda m: m::BIGINT), [1]) ELSE list_has_any(list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda m: m::BIGINT), [2, 3]) END AS ok FROM sentence),
kept AS (SELECT question_id, trim(coalesce(string_agg(replace(CASE WHEN even THEN regexp_replace(s, '\[0*(2|3|99999999999)\]', '', 'g') ELSE regexp_replace(s, '\[0*(1|99999999999)\]', '', 'g') END, '  ', ' '), ' ' ORDER BY i) FILTER (ok), '')) AS kept,
  count(*) FILTER (NOT ok AND s <> '') AS removed FROM mark GROUP BY question_id)
"""


def answers(spark, sf_dir):
    """question_id, text (with markers), ok: assistant turns as answers."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'assistant'")
    text = F.col("text")
    for last, mark in ((r"e\.\s", "e [1]. "), (r"n\.\s", "n  [2]. "), (r"s\.\s", "s [3][1]. ")):
        text = F.regexp_replace(text, last, mark)
    text = F.when(F.col("conv_id") % 11 == 0, F.concat(F.lit("  "), text, F.lit(" Large [99999999999]. Padded [01][99999999999] [002].\n"))).otherwise(text)
    ok = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3)))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), text.alias("text"), ok.alias("ok"))


@query("keep_supported", f"WITH {ANSWER_SQL} SELECT question_id, kept, removed::INTEGER AS removed FROM kept")
def keep_supported(spark, sf_dir):
    return answers(spark, sf_dir).withColumn("s", Q.supported(F.col("text"), F.col("ok"))).select("question_id", "s.kept", "s.removed")


@query("used_citations", rf"WITH {ANSWER_SQL} SELECT question_id, n::INTEGER AS n FROM kept, unnest([1, 2, 3]) r(n) WHERE regexp_matches(kept, '\[0*' || n || '\]')")
def used_citations(spark, sf_dir):
    a = answers(spark, sf_dir)
    cited = a.select("question_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    return Q.used_citations(cited, a.select("question_id", Q.supported(F.col("text"), F.col("ok"))["kept"].alias("kept")))


@query("repair_choice", f"""WITH {ANSWER_SQL},
  one AS (SELECT question_id, kept, removed FROM kept), two AS (SELECT question_id, text AS kept2 FROM answer WHERE question_id % 3 <> 0)
  SELECT question_id, CASE WHEN removed > 0 AND coalesce(length(kept2) > length(kept), false) THEN kept2 ELSE kept END AS kept, removed > 0 AND coalesce(length(kept2) > length(kept), false) AS repaired,
    (removed + CASE WHEN removed > 0 AND kept2 IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS rejected
  FROM one LEFT JOIN two USING (question_id)""")
def repair_choice(spark, sf_dir):
    a = answers(spark, sf_dir)
    first = a.select("question_id", Q.supported(F.col("text"), F.col("ok")).alias("s")).select("question_id", "s.kept", F.col("s.removed").cast("bigint").alias("rejected"))
    second = a.filter("question_id % 3 <> 0").select("question_id", F.col("text").alias("kept"), F.lit(1).cast("bigint").alias("rejected"))
    return Q.choose_attempt(first, second)


@query("marker_split", rf"""WITH {ANSWER_SQL},
  cut AS (SELECT question_id, string_split(regexp_replace(text, '\[(\d+)\]', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM answer),
  x AS (SELECT question_id, i, p[i] AS value FROM cut, unnest(range(1, len(p) + 1)) r(i) WHERE p[i] <> '')
  SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY i) - 1)::INTEGER AS pos, CASE WHEN i % 2 = 0 THEN 'marker' ELSE 'text' END AS kind, value FROM x""")
def marker_split(spark, sf_dir):
    parts = answers(spark, sf_dir).select("question_id", F.posexplode(citation_parts(F.col("text"))).alias("pos", "p"))
    return parts.select("question_id", "pos", "p.kind", "p.value")


@query("prompt_block", f"""WITH RECURSIVE {HITS_SQL}, t AS (SELECT doc_id, text[1:60] AS title FROM documents),
  x AS (SELECT question_id, n, '[' || n || '] Episode: "' || title || '" (from ' || CASE WHEN start_ms >= 3600000 THEN printf('%d:%02d:%02d', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60)
    ELSE printf('%d:%02d', start_ms // 60000, (start_ms // 1000) % 60) END || ')' || chr(10) || text AS block FROM hit JOIN t ON doc_id = episode_id)
  SELECT question_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS prompt FROM x GROUP BY question_id""")
def prompt_block(spark, sf_dir):
    titles = C.episodes(spark, sf_dir).select(F.col("id").alias("episode_id"), "title")
    return Q.prompt_blocks(hits(spark, sf_dir).join(titles, "episode_id"))


@query("refusals", f"""WITH {ANSWER_SQL} SELECT CASE WHEN a.question_id % 7 = 0 THEN 'no passages' WHEN a.question_id % 5 = 0 OR trim(a.text) = '' THEN 'not found' WHEN kept = '' THEN 'nothing supported' ELSE 'answered' END AS outcome, count(*) AS n
  FROM answer a JOIN kept USING (question_id) GROUP BY 1""")
def refusals(spark, sf_dir):
    a = answers(spark, sf_dir)
    why = Q.refused(F.col("question_id") % 7, F.col("question_id") % 5 != 0, F.col("text"), Q.supported(F.col("text"), F.col("ok"))["kept"])
    return a.groupBy(F.coalesce(why, F.lit("answered")).alias("outcome")).agg(F.count("*").alias("n"))


@query("stop_early_prefix", """WITH x AS (SELECT *, max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hit FROM events)
  SELECT event_id, user_id, value FROM x WHERE hit = 0""")
def stop_early_prefix(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Q.stop_early(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "value")
