"""A training corpus from raw documents: toxic ones out, near-duplicates out, surrogates for personal data, sources
mixed to target weights, and token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder
and reads them again for the next, so a lost executor costs at most a part of one stage. When a stage is written, the
tables it was made from are deleted. All stages but the last return the columns of documents. No SQL expresses the fitted
classifier, the keyed surrogates or the random rounding; tests hold each stage against the brute-force forms of its
operator.

Results, in every stage: rows are told apart by their content, so rows with null or clashing ids are neither lost nor
mixed up; null and empty texts pass through (toxicity: without hits; near duplicates: each id's once; surrogates: as they
are; mixing: taken 0 times, as they have no words); very long texts are read whole; of repeated rows near_duplicates
keeps one; an empty table gives an empty table; columns beyond those of documents are carried along.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexichron.llm import bpe, mixing, neardup, pii, toxicity
from lexichron.llm.common import Shelf, clear_shelves, open_shelves, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored as toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of smallest doc_id, of each group of near-duplicates (five words, 0.8)."""
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


#: The session's setting that holds the surrogates' key, in hexadecimal digits.
KEY_SETTING = "spark.lexichron.surrogate.key"


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING, by which runs agree; where it is unset, a fresh one that nobody keeps."""
    known = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(known) if known else secrets.token_bytes(32)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text where the column is there."""
    out = pii.replace_pii(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; one row a copy."""
    return bpe.bpe_digest(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", neardup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        since, before = open_shelves(), docs
        docs = shelf.put(stage(spark, before, sf_dir))
        clear_shelves(since)
        shelf.drop(before)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
