"""Operator 9: mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies, at most two, that each of its documents should have on
average. The whole part is taken at once; the fractions are rounded by the pivotal method: two documents with
fractional probabilities meet, words move from one to the other at random (keeping both expectations and the sum of
expected words) until one is 0 or 1, and the other meets the next. Documents first meet those of their own source and
size class; what is left over, one document a group, is dealt by hash to the nodes of a reduction tree, about FAN documents each. The few
largest documents of a source, fewer than HEAD, are settled before the others, whose rate then makes up for what those
missed; so a source misses its target by part of one document of at most 1/HEAD of its words, if it has small ones.

Groups are (source, size class, salt), with as many salts as keep a group near GROUP rows, so a source with a third
of all rows is spread over many tasks. Only groups' leftovers travel up the tree. Draws come from hashes of the seed
and the documents, so reruns agree. Source sizes and targets are aggregates, one row a source.

Sources may be as many as hosts: they are numbered through a range sort with running counts of its parts, and targets
follow from sums over all sources, taken anew while any source is above its cap; no step needs all sources in one task.

Results: a null or empty text has size 0 and takes nothing, very long ones count whole; a null source is a source of its
own, last in order; repeated rows are rows of their own: they share one key, and any of them may stand for another; an
empty table gives an empty table; a source without words has target 0. mix reads doc_id, source and text only;
mixed_documents carries all other columns along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, any_names, table

WEIGHTS = (5.0, 2.0, 1.0)
GROUP, FAN, SEED = 4_000, 1_000, 1
#: Equal rows that one task numbers.
REPEATS = 4_000
TOTAL_SHARE, MOST = 1.5, 2.0
#: Probabilities this close to 0 or 1 are that.
NEAR = 1e-9
#: A source's head: its documents of more than 1/HEAD of its words, so under HEAD documents.
HEAD = 400


def word_count(text: str = "text"):
    return F.coalesce(F.expr(f"cast(regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+') as bigint)"), F.lit(0).cast("bigint"))


def numbered(sources: DataFrame, shelf: Shelf) -> DataFrame:
    """sources with place: the number of each source in code point order from 0, null last."""
    order = F.col("source").asc_nulls_last()
    dealt = shelf.put(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    in_part = Window.partitionBy("part").orderBy(order)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("in_part"))  # a row a part of the sort
    before = sizes.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.row_number().over(in_part) - 1).drop("part", "before")


def source_targets(sizes: DataFrame, shelf: Shelf, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, n of every source of sizes(source, size).

    Weights repeat over the sources in code point order. Sources at their cap keep it, and what is left of the total is
    shared by weight among the others, until none is above its cap; a round caps at least one source, in practice many.
    """
    per = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), shelf)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(kinds, (F.col("place") % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    per = shelf.put(per.drop("place"))
    left = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        # sources that a level caps stay capped, as levels only rise
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        full, weight = per.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not weight:
            break
        risen = (left - (full or 0.0)) / weight
        if risen <= level:
            break
        level = risen
    return per.select("source", "source_size", "n", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _uniform(*parts) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, parts))) / 2.0**64


def pivot(p: np.ndarray, size: np.ndarray, keys: list[str], seed: int) -> np.ndarray:
    """Pivotal rounding of p in the given order; all become 0 or 1 but at most one, and sum(size * p) stays."""
    p = p.astype(float).copy()
    hold = -1
    for i in range(len(p)):
        if p[i] < NEAR or p[i] > 1 - NEAR:
            p[i] = round(p[i])
            continue
        if hold < 0:
            hold = i
            continue
        # words that can move to the held document, and from it
        to, away = min((1 - p[hold]) * size[hold], p[i] * size[i]), min(p[hold] * size[hold], (1 - p[i]) * size[i])
        moved = to if _uniform(seed, keys[hold], keys[i]) < away / (to + away) else -away
        p[hold] += moved / size[hold]
        p[i] -= moved / size[i]
        for j in (hold, i):
            if p[j] < NEAR or p[j] > 1 - NEAR:
                p[j] = round(p[j])
        hold = next((j for j in (hold, i) if 0 < p[j] < 1), -1)
    return p


def _rounded(seed: int):
    """Rounds one group, the largest documents first, so that a small one is left over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "nth"], ascending=[False, True, True], kind="stable", ignore_index=True)
        keys = (pdf["key"].astype(str) + "#" + pdf["nth"].astype(str)).tolist()
        pdf["p"] = pivot(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), keys, seed)
        return pdf

    return run


def _head(seed: int, most: float):
    """Settles a source's head: size class by size class, the largest first, what one class misses is shared by the rest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["class", "size", "key", "nth"], ascending=[False, False, True, True], kind="stable", ignore_index=True)
        keys = (pdf["key"].astype(str) + "#" + pdf["nth"].astype(str)).tolist()
        size, cls, copies = pdf["size"].to_numpy(float), pdf["class"].to_numpy(), np.zeros(len(pdf))
        open_words, due = float(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        for c in pdf["class"].unique():
            at = np.flatnonzero(cls == c)
            rate = min(most, max(0.0, due / open_words))
            whole = min(int(rate), int(most))
            p = pivot(np.full(len(at), rate - whole), size[at], [keys[i] for i in at], seed)
            for j in np.flatnonzero((p > 0) & (p < 1)):
                p[j] = float(_uniform(seed, "last", keys[at[j]]) < p[j])
            copies[at] = whole + p
            due -= float((copies[at] * size[at]).sum())
            open_words -= float(size[at].sum())
        pdf["whole"], pdf["p"] = copies.astype("int64"), 0.0
        return pdf

    return run


def one_by_one(rows: DataFrame) -> DataFrame:
    """rows(…, repeats) as often as repeats says, numbered by nth from 1; a row of many repeats is dealt to many tasks."""
    few = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats"))).alias("nth")
    names = [c for c in rows.columns if c != "repeats"]
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("repeats") - 1) / REPEATS))).alias("block")
    many = rows.filter(F.col("repeats") > REPEATS).select("*", blocks).repartition("key", "block")
    first = F.col("block") * REPEATS + 1
    each = F.explode(F.sequence(first, F.least("repeats", first + REPEATS - 1))).alias("nth")
    return rows.filter(F.col("repeats") <= REPEATS).select(*names, few).union(many.select(*names, each))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST, seed: int = SEED, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """doc_id, source, key, size, source_size, target, copies of every row of docs; key and nth tell rows apart."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    # documents without text or with equal ones differ by doc_id; rows equal in all of this are numbered below
    base = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", "source", "text").alias("key"))
    sizes = shelf.put(base)
    # one row per distinct document, with the number of its copies in docs
    rows = sizes.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("repeats"))
    rows = one_by_one(rows)
    targets = shelf.put(source_targets(sizes, shelf, weights, share, most))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "n")
    rows = rows.join(t, rows["source"].eqNullSafe(t["t_source"])).drop("t_source")
    rows = rows.withColumn("class", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * 2))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(group)))
    rows = rows.withColumn("node", F.pmod(F.xxhash64("key", "nth"), salts))
    rows = rows.withColumn("whole", F.lit(0).cast("bigint")).withColumn("p", F.lit(0.0))
    names = ["doc_id", "source", "size", "key", "nth", "source_size", "target", "whole", "p", "class", "node"]
    rows = rows.select(names)
    in_head = F.col("size") * HEAD > F.col("source_size")
    head = shelf.put(rows.filter(in_head).groupBy("source").applyInPandas(_head(seed, most), rows.schema))
    took = head.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("took"), F.sum("size").alias("of"))
    took = took.withColumnRenamed("source", "t_source")
    rows = rows.filter(~in_head).join(took, rows["source"].eqNullSafe(took["t_source"]), "left")
    due, over = F.col("target") - F.coalesce("took", F.lit(0)), F.col("source_size") - F.coalesce("of", F.lit(0))
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), due / over))).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)).select(names)
    done = shelf.put(rows.groupBy("source", "class", "node").applyInPandas(_rounded(seed), rows.schema))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    final = done.filter(~open_).union(head)
    left = done.filter(open_)
    up = _rounded(seed + 1)
    level = 0
    open_sources = shelf.put(left.groupBy(F.col("source").alias("t_source")).agg(F.count("*").alias("open")))
    while (open_sources.agg(F.max("open")).first()[0] or 0) > 1:
        # each node of the tree leaves at most one open document; documents are dealt to nodes by hash, so no source is one task
        dealt = left.join(open_sources, left["source"].eqNullSafe(open_sources["t_source"])).drop("t_source")
        place = F.pmod(F.xxhash64(F.lit(seed + level), "key", "nth"), F.ceil(F.col("open") / F.lit(fan)))
        dealt = dealt.withColumn("at", place).drop("open")
        met = shelf.put(dealt.groupBy("source", "at").applyInPandas(_tree(up), rows.schema))
        final = final.union(met.filter(~open_))
        left = met.filter(open_)
        level += 1
        open_sources = shelf.put(left.groupBy(F.col("source").alias("t_source")).agg(F.count("*").alias("open")))
    # the last document of a source is settled by one draw
    draw = F.pmod(F.xxhash64(F.lit(seed), "key", "nth"), F.lit(1 << 30)) / float(1 << 30)
    last = left.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0)).select(names)
    out = final.select(names).union(last)
    return out.withColumn("copies", (F.col("whole") + F.round("p")).cast("bigint")).select("doc_id", "source", "key", "nth", "size", "source_size", "target", "copies")


def _tree(up):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return up(pdf.drop(columns="at"))

    return run


@any_names
def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it.

    Of rows that share a key (doc_id, source and text) the mix says how many are taken how often; nearly always there is
    one. Several are first counted by all their columns, so that equal ones travel as one, and then take their copies in
    an order that their columns fix.
    """
    most = int(options.get("most", MOST))
    taken = mix(docs, **options).groupBy("key").agg(F.count("*").alias("rows"), *[F.count_if(F.col("copies") == c).alias(f"of_{c}") for c in range(1, most + 1)])
    plan = F.struct("rows", *[F.col(f"of_{c}") for c in range(1, most + 1)])
    taken = taken.filter(" + ".join(f"of_{c}" for c in range(1, most + 1)) + " > 0").select(F.col("key").alias("__key"), plan.alias("__plan"))
    rows = docs.select("*", F.xxhash64("doc_id", "source", "text").alias("__key")).join(taken, "__key")
    alone = rows.filter("__plan.rows = 1")
    single = sum((F.col(f"__plan.of_{c}") * c for c in range(2, most + 1)), F.col("__plan.of_1"))
    alone = alone.select(*docs.columns, single.alias("__copies"))
    shared = rows.filter("__plan.rows > 1").groupBy(*docs.columns, "__key", "__plan").agg(F.count("*").alias("__m"))
    line = Window.partitionBy("__key").orderBy(*[c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()])
    upto = F.sum("__m").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = shared.withColumn("__upto", upto)
    low, total, copies = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for c in range(most, 0, -1):  # the first of_most rows are taken most times, and so on
        low, total = total, total + F.col(f"__plan.of_{c}")
        copies = copies + c * F.greatest(F.lit(0).cast("bigint"), F.least("__upto", total) - F.greatest(F.col("__upto") - F.col("__m"), low))
    shared = shared.select(*docs.columns, copies.alias("__copies"))
    both = alone.union(shared).filter("__copies > 0")
    return both.withColumn("__copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).select(docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
