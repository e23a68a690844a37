"""Operator 1: license scans by diagonal voting, in DataFrame operations only.

Every text becomes words; every run of GRAM words is hashed at its place and joined with the places of the same hash
in the templates. A hit votes for the diagonal (place in text minus place in template). Votes are counted by text,
template and diagonal; neighbouring diagonals (gaps of at most GAP, as after an inserted or dropped word) are merged
to spans; a span is verified by the share of the template's grams it covers. Hits compare the words themselves
beside the hash, so a diagonal with all votes is the template's text word for word.

Templates are short fixed texts: three base phrases, counted at every place, and license notices whose labels are
added when a span covers at least COVER of them. They and their hash table are literals of the plan, a few hundred
rows whatever the input.

Results: a null or empty text has no words, no places and score 0; very long texts are read whole, in one row's arrays;
repeated rows repeat their result, whatever their doc_id; an empty table gives an empty table; ties between spans do not
matter, as a label counts once. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

GRAM, GAP, COVER = 3, 2, 0.7
#: The base phrases and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Words of public license notices, and the labels they give.
NOTICES = [
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
WORDS = r"[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_grams(spark: SparkSession) -> DataFrame:
    """gram places of all templates: template, base, label, grams, words, t_pos, w1, w2, w3, hash."""
    rows = []
    for number, (text, label, base) in enumerate([(t, x, True) for t, x in BASE] + [(t, x, False) for t, x in NOTICES]):
        w = text.split(" ")
        rows += [(number, base, label, len(w) - GRAM + 1, len(w), i, *w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "template int, base boolean, label string, grams int, n_template int, t_pos int, w1 string, w2 string, w3 string")
    return grams.withColumn("hash", F.xxhash64("w1", "w2", "w3"))


def license_hits(docs: DataFrame) -> DataFrame:
    """One row a (text, template, diagonal) with the template places that voted for it, and one a text with n_words.

    Columns: doc_id, mark (tells texts of one doc_id apart), template, base, label, grams, diagonal, seen (a bit a
    template place), repeats, n_words. The scan, the rolling hashes, the join with the templates (broadcast: a literal
    table) and the first counting run without a shuffle; only votes travel.
    """
    grams = template_grams(docs.sparkSession)
    # Lower-casing letters beyond A-Z makes no template letter but from the Kelvin sign (k), which goes first.
    lowered = F.coalesce(F.lower(F.replace("text", F.lit("\u212a"), F.lit("\u00e5"))), F.lit(""))
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), lowered.alias("text"))
    words = words.selectExpr("doc_id", "mark", f"regexp_extract_all(text, '{WORDS}', 0) AS w")
    places = words.selectExpr(
        "doc_id",
        "mark",
        """inline(concat(
             array(struct(-1 AS pos, cast(size(w) AS bigint) AS hash, '' AS a, '' AS b, '' AS c)),
             if(size(w) < 3, cast(array() AS array<struct<pos:int,hash:bigint,a:string,b:string,c:string>>),
                transform(sequence(0, size(w) - 3), i -> struct(i AS pos, xxhash64(w[i], w[i + 1], w[i + 2]) AS hash, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c)))))""",
    )
    voted = (places["hash"] == grams["hash"]) & (F.col("a") == F.col("w1")) & (F.col("b") == F.col("w2")) & (F.col("c") == F.col("w3")) & (F.col("pos") >= 0)
    votes = places.join(F.broadcast(grams), voted, "left").filter("pos = -1 OR template IS NOT NULL")
    diagonal = F.when(F.col("template").isNotNull(), F.col("pos") - F.col("t_pos"))
    counted = votes.groupBy("doc_id", "mark", "template", "base", "label", "grams", diagonal.alias("diagonal"))
    return counted.agg(
        F.bit_or(F.expr("shiftleft(1L, t_pos)")).alias("seen"),
        F.sum(F.when(F.col("pos") < 0, 1)).alias("repeats"),
        F.max(F.when(F.col("pos") < 0, places["hash"])).alias("n_words"),
    )


def license_spans(hits: DataFrame) -> DataFrame:
    """Spans of merged diagonals: doc_id, mark, template, base, label, places (diagonals with all votes), first_start,
    last_start (of those), start, cover, repeats, n_words. The row with n_words stays, with a null template."""
    line = Window.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    broken = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > GAP).cast("int"), F.lit(0))
    runs = hits.withColumn("broken", broken).withColumn("run", F.sum("broken").over(line))
    whole = F.bit_count("seen") == F.col("grams")
    return runs.groupBy("doc_id", "mark", "template", "base", "label", "grams", "run").agg(
        F.sum(F.when(whole, 1).otherwise(0)).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_start"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_start"),
        F.min("diagonal").alias("start"),
        (F.bit_count(F.bit_or("seen")) / F.first("grams")).alias("cover"),
        F.max("repeats").alias("repeats"),
        F.max("n_words").alias("n_words"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs."""
    spans = license_spans(license_hits(docs))
    in_base = F.col("base") & (F.col("places") > 0)
    kept = in_base | (~F.col("base") & (F.col("cover") >= COVER))
    out = spans.groupBy("doc_id", "mark").agg(
        F.max("repeats").alias("repeats"),
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum(F.when(in_base, F.col("places"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(in_base, F.col("first_start"))).cast("bigint").alias("first_word"),
        F.max(F.when(in_base, F.col("last_start"))).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(in_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(kept, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(kept, F.col("cover"))), F.lit(0.0)).alias("score"),
    )
    rows = out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats"))))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _template_values() -> str:
    listed = [(t, x, "true") for t, x in BASE] + [(t, x, "false") for t, x in NOTICES]
    return ", ".join(f"({i}, '{t}', '{x}', {b})" for i, (t, x, b) in enumerate(listed))


OP1_SQL = rf"""
WITH t AS (SELECT k, string_split(t, ' ') AS w, label, base FROM (VALUES {_template_values()}) v(k, t, label, base)),
g AS (SELECT k, label, base, len(w) - 2 AS grams, i AS t_pos, w[i + 1] AS w1, w[i + 2] AS w2, w[i + 3] AS w3 FROM t, unnest(range(len(w) - 2)) r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT rid, i AS pos, w[i + 1] AS w1, w[i + 2] AS w2, w[i + 3] AS w3 FROM d, unnest(range(len(w) - 2)) r(i)),
votes AS (SELECT rid, k, label, base, grams, pos - t_pos AS diagonal, count(*) AS n, bit_or(1::BIGINT << t_pos) AS seen
  FROM p JOIN g USING (w1, w2, w3) GROUP BY ALL),
b AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, k ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS broken FROM votes),
r AS (SELECT *, sum(broken) OVER (PARTITION BY rid, k ORDER BY diagonal) AS run FROM b),
s AS (SELECT rid, k, label, base, count(*) FILTER (n = grams) AS places, min(diagonal) FILTER (n = grams) AS a, max(diagonal) FILTER (n = grams) AS z,
    bit_count(bit_or(seen)) / grams AS cover
  FROM r GROUP BY rid, k, label, base, grams, run),
f AS (SELECT rid, label, base AND places > 0 AS in_base, places, a, z, cover FROM s WHERE base AND places > 0 OR NOT base AND cover >= {COVER})
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, coalesce(sum(places) FILTER (in_base), 0)::BIGINT AS n_base,
  (min(a) FILTER (in_base))::BIGINT AS first_word, (max(z) FILTER (in_base))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (in_base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(cover), 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (rid) GROUP BY d.rid, d.doc_id
"""
