"""Queries over the search legs, with their SQL.

Questions are all benchmark texts; their vectors are the embeddings of the same id (a synthetic pairing). The vector
query on its own asks for every row whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, keyword_terms, snippet, vector_literal
from ..operators import retrieval as R
from ..session import scratch, spread, table
from ..sources import textindex, vectorindex
from . import corpus as C
from .base import query

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def terms_sql(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: NOT list_contains([{_STOP}], w))"


KEYWORD_SQL = f"""
post AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({terms_sql("text")}) AS term FROM documents) GROUP BY id, term),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({terms_sql("text")})) AS term FROM benchmark),
kscore AS (SELECT query_id, id, sum(tf)::BIGINT AS score FROM post JOIN qt USING (term) GROUP BY query_id, id),
kleg AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM kscore) WHERE rank <= 50)
"""
VECTOR_SQL = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
qv AS (SELECT {q} AS query_id, e FROM v {where}),
vdist AS (SELECT query_id, v.id, 1 - list_inner_product(qv.e, v.e) / (sqrt(list_inner_product(qv.e, qv.e)) * sqrt(list_inner_product(v.e, v.e))) AS distance FROM qv JOIN v ON true),
vleg AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM vdist) WHERE rank <= 50)
"""
ASKED_SQL = VECTOR_SQL.format(q="id", where="WHERE id IN (SELECT item_id FROM benchmark)")
FUSED_SQL = f"""{KEYWORD_SQL}, {ASKED_SQL},
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (
  SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + k.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + x.rank), 0.0::DOUBLE) AS score FROM kleg k FULL JOIN vleg x USING (query_id, id)))
"""


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text")


def vectors(spark, sf_dir):
    return spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), "embedding")


def asked(spark, sf_dir):
    """query_id, question, embedding."""
    v = vectors(spark, sf_dir).withColumnRenamed("id", "query_id")
    return C.questions(spark, sf_dir).join(v, "query_id", "left")


@query("keyword_topk", f"WITH {KEYWORD_SQL} SELECT query_id, id, rank FROM kleg")
def keyword_topk(spark, sf_dir):
    return R.keyword_search(documents(spark, sf_dir), C.questions(spark, sf_dir))


@query("stored_keyword_topk", f"WITH {KEYWORD_SQL} SELECT query_id, id, rank FROM kleg")
def stored_keyword_topk(spark, sf_dir):
    """The same ranks from a stored index, whose blocks are skipped by their bounds."""
    path = scratch(spark)
    textindex.build(documents(spark, sf_dir), path, analyze=keyword_terms)
    return textindex.search(path, C.questions(spark, sf_dir), analyze=keyword_terms)


@query("stemmed_postings", rf"WITH {KEYWORD_SQL} SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n_places FROM post WHERE regexp_matches(term, '[^\x00-\x7F]') GROUP BY term")
def stemmed_postings(spark, sf_dir):
    """The terms of a stored index with stems that are no English words, which no stem rule touches."""
    path = scratch(spark)
    textindex.build(documents(spark, sf_dir), path)
    other = textindex.postings(spark, path).filter(F.col("term").rlike(r"[^\x00-\x7F]"))
    return other.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_places"))


@query("vector_topk", f"WITH {VECTOR_SQL.format(q='id', where='WHERE id % 50 = 0')} SELECT query_id, id, rank FROM vleg")
def vector_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.vector_leg(v, v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"))


def legs(spark, sf_dir):
    q = asked(spark, sf_dir)
    return R.keyword_search(documents(spark, sf_dir), q), R.vector_leg(vectors(spark, sf_dir), q.filter("embedding IS NOT NULL"))


@query("rrf_fusion", f"WITH {FUSED_SQL} SELECT query_id, id, score FROM fused")
def rrf_fusion(spark, sf_dir):
    return R.rrf(*legs(spark, sf_dir))


@query("hybrid_search", f"WITH {FUSED_SQL} SELECT query_id, id, rank, score, substr(text, 1, 300) AS snippet FROM fused JOIN documents ON doc_id = id WHERE rank <= 10")
def hybrid_search(spark, sf_dir):
    found = R.hydrate(R.fused(*legs(spark, sf_dir), limit=10), documents(spark, sf_dir))
    return found.select("query_id", "id", "rank", "score", snippet(F.col("text")).alias("snippet"))


_SET = "list_distinct(list_filter(regexp_split_to_array(lower(trim({x})), '\\s+'), lambda w: w <> ''))"


@query("hybrid_rerank", f"""WITH {FUSED_SQL},
  s AS (SELECT query_id, id, f.rank AS fused_rank, len(list_intersect({_SET.format(x="b.text")}, {_SET.format(x="d.text")}))::DOUBLE AS score, d.source AS title
    FROM fused f JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 20),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank)::INTEGER AS rank FROM s)
  SELECT query_id, id, rank, fused_rank, score, title FROM r WHERE rank <= 5""")
def hybrid_rerank(spark, sf_dir):
    texts = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title"))
    found = R.hydrate(R.fused(*legs(spark, sf_dir)), texts)
    return R.rerank(found, C.questions(spark, sf_dir), 5).select("query_id", "id", "rank", "fused_rank", "score", "title")


@query("hash_embed", r"""WITH w AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(trim(text)), '\s+')) AS w FROM documents),
  x AS (SELECT id, regexp_replace(w, '^[.,?!]+|[.,?!]+$', '', 'g') AS w FROM w),
  n AS (SELECT id, (('0x' || md5(w)[25:32])::BIGINT % 64)::INTEGER AS bucket, count(*) AS n FROM x WHERE w <> '' GROUP BY 1, 2)
  SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM n""")
def hash_embed(spark, sf_dir):
    return R.hash_weights(documents(spark, sf_dir))


def versioned(spark, sf_dir):
    """Passages of which a third has no vector and a third one of an older model."""
    v = vectors(spark, sf_dir).join(documents(spark, sf_dir), "id")
    return v.select("id", "text", F.when(F.col("id") % 3 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("id") % 3 == 1, "hash-0").when(F.col("id") % 3 == 2, "hash-1").alias("embed_model"))


@query("embed_pending", """SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'missing' ELSE 'other model' END AS why FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 3 <> 2""")
def embed_pending(spark, sf_dir):
    return R.pending(versioned(spark, sf_dir), "hash-1").select("id", F.when(F.col("embedding").isNull(), "missing").otherwise("other model").alias("why"))


@query("embed_merge", "SELECT CASE WHEN vec_id % 3 = 2 THEN 'kept' ELSE 'made' END AS state, count(*) AS n FROM embeddings JOIN documents ON doc_id = vec_id WHERE trim(text) <> '' GROUP BY 1")
def embed_merge(spark, sf_dir):
    before = versioned(spark, sf_dir).select("id", F.col("embed_model").alias("old"))
    after = R.embed_pending(versioned(spark, sf_dir), "hash-1").filter("embed_model = 'hash-1' AND embedding IS NOT NULL").join(before, "id")
    return after.groupBy(F.when(F.col("old").eqNullSafe(F.lit("hash-1")), "kept").otherwise("made").alias("state")).agg(F.count("*").alias("n"))


@query("vector_literal", "SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", vector_literal(F.col("embedding")).alias("literal"))


def vector_index(spark, sf_dir):
    """A stored index over the embeddings, and where it lies."""
    path = scratch(spark)
    vectorindex.build(vectors(spark, sf_dir), path)
    return path


@query("ann_index")
def ann_index(spark, sf_dir):
    """The stored index at the number of cells that it measured for itself."""
    q = vectors(spark, sf_dir).filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    return vectorindex.nearest(vector_index(spark, sf_dir), q)


@query("ann_index_exact", f"WITH {VECTOR_SQL.format(q='id', where='WHERE id % 50 = 0')} SELECT query_id, id, rank FROM vleg")
def ann_index_exact(spark, sf_dir):
    """The stored index, and all cells that may hold a nearer row."""
    q = vectors(spark, sf_dir).filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    return vectorindex.nearest(vector_index(spark, sf_dir), q, probes=4, exact=True)


@query("ann_lsh")
def ann_lsh(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.lsh_leg(v, v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"))
