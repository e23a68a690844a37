"""Operator 2: near-duplicates by one-permutation MinHash with optimal densification and banded buckets.

A document's set holds the hashes of its distinct word shingles. One hash permutation is split into BANDS * ROWS
bins; a bin's value is its least hash, and an empty bin takes the value of a bin chosen by a fixed random sequence
(optimal densification). Documents of equal sets form one class, found by an aggregation; only classes go on.
Buckets of classes that agree in a band give candidate edges in the shape of a star, around the class that shares most
buckets, so that a bucket of n classes gives n - 1 edges. Each edge is confirmed on the full sets, and components are
found by alternating stars. What stars may have missed are links between a bucket's largest component and classes
outside it: in the few buckets that hold several components, each outsider is compared on full sets with the members
of other components, in blocks of bounded size, and only confirmed links leave the task. Those join the components.

A pair at similarity 0.8 misses all of 40 bands of 5 rows with a chance of 1.2e-7; sets of under four shingles are
similar at 0.8 only if equal, and need no bands (four within five are). Sets are told apart by 64-bit hashes.

A row is told apart by its doc_id and text together (96 bits of hashes), never by doc_id alone.

Results: null or empty texts have an empty set and are linked with nothing; very long texts are read whole; repeated rows
are copies and get one component; different texts under one doc_id are rows of their own; a component's id is its
smallest doc_id, so a null doc_id is never one unless the component has no other; an empty table gives an empty table.
near_duplicates reads doc_id and text only; drop_near_duplicates carries all other columns along, whatever their names
(but for __row and __mark, which it adds and removes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, any_names, slices, table
from .graph import components

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Outsiders and members of a bucket that meet in one task; larger buckets are dealt into more blocks.
OUTSIDE, INSIDE = 2_000, 1_000
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, one hash of them all."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.full(n, U(min(k, len(h))))
    for j in range(min(k, len(h))):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


#: Bin b holds hashes from EDGES[b] to EDGES[b + 1].
EDGES = np.array([(b << 64) // BINS for b in range(BINS)] + [(1 << 64) - 1], np.uint64)
#: Where an empty bin looks for a value, attempt by attempt.
TRIES = (mixed(np.arange(BINS * 1024, dtype=np.uint64) + U(7)) % U(BINS)).astype(np.int64).reshape(BINS, 1024)
BAND_SEED = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_hashes(s: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of a sorted non-empty set."""
    at = np.searchsorted(s, EDGES)
    at[-1] = len(s)
    full = at[:-1] < at[1:]
    value = s[np.minimum(at[:-1], len(s) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        for width in (16, 256, 1024):
            open_to = full[TRIES[empty, :width]]
            found = open_to.any(1)
            value[empty[found]] = value[TRIES[empty[found], open_to[found].argmax(1)]]
            empty = empty[~found]
            if not len(empty):
                break
        value[empty] = s[0]
    rows = value.reshape(BANDS, ROWS)
    out = BAND_SEED.copy()
    for r in range(ROWS):
        out = mixed(out * U(0x9E3779B97F4A7C15) + rows[:, r])
    return out


def set_key(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def row_keys() -> list:
    """Two columns that tell a row by its doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("__row"), F.hash("text", "doc_id").alias("__mark")]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, __row, __mark (as of row_keys), n (set size), cls (key of the set; null if empty), bands (none for sets under four)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sets = [shingle_set(t, k) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("doc_id", "__row", "__mark")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([band_hashes(s).view(np.int64) if len(s) >= 4 else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "__row", "__mark", "n", "cls", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *row_keys()).mapInArrow(run, f"doc_id {kind}, __row bigint, __mark int, n bigint, cls bigint, bands array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cls, members (the full set in order of signed integers) for the classes in wanted(__row, __mark, cls), each of which names one row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sets = [np.sort(shingle_set(t, k).view(np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("cls")), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "members"])

    rows = docs.select("text", *row_keys()).join(wanted, ["__row", "__mark"])
    return rows.select("text", "cls").mapInArrow(run, "cls bigint, members array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union. u is the side that may be hot."""
    left = sets.select(F.col("cls").alias("v"), F.col("members").alias("mv"))
    right = sets.select(F.col("cls").alias("u"), F.col("members").alias("mu"))
    both = pairs.select("u", "v").join(left, "v").join(right, "u")
    inter = F.size(F.array_intersect("mu", "mv"))
    return both.select("u", "v", inter.alias("i"), (F.size("mu") + F.size("mv") - inter).alias("o")).filter(F.col("i") * 100 >= F.col("o") * percent).select("u", "v")


def stars(members: DataFrame, percent: int) -> DataFrame:
    """(u, v) from the best-connected class of each bucket to its other classes. members: band, cls, n, weight."""
    hubs = members.groupBy("band").agg(F.max(F.struct("weight", "cls", "n")).alias("hub"))
    joined = members.join(hubs, "band").filter(F.col("cls") != F.col("hub.cls"))
    close = F.least("hub.n", "n") * 100 >= F.greatest("hub.n", "n") * percent
    return joined.filter(close).select(F.col("hub.cls").alias("u"), F.col("cls").alias("v")).distinct()


def links_across(percent: int):
    """Confirmed links (u, v) between the outsiders and the members of one block of a bucket."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        band = key[0].as_py()
        side, cls, root = (block.column(c).to_numpy() for c in ("outside", "cls", "root"))
        flat = block.column("members").combine_chunks()
        ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        sizes = np.diff(ends)
        bands = block.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        inside, u, v = np.flatnonzero(~side), [], []
        for o in np.flatnonzero(side):
            agree = bands[inside] == bands[o]
            # a pair is compared in its first common bucket only, and in one direction if both are outsiders
            first = bands[o][agree.argmax(1)] == band
            close = np.minimum(sizes[inside], sizes[o]) * 100 >= np.maximum(sizes[inside], sizes[o]) * percent
            at = inside[first & close & (root[inside] != root[o])]
            if not len(at):
                continue
            mine = values[ends[o] : ends[o + 1]]
            theirs = np.concatenate([values[ends[i] : ends[i + 1]] for i in at])
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            starts = np.cumsum(sizes[at]) - sizes[at]
            common = np.add.reduceat((mine[place] == theirs).astype(np.int64), starts)
            found = at[common * 100 >= (sizes[at] + sizes[o] - common) * percent]
            found = found[np.unique(root[found], return_index=True)[1]]  # one link joins the outsider to a whole component
            u += [cls[o]] * len(found)
            v += cls[found].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def missed_links(met: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) confirmed between components that share a bucket. met: band, cls, n; roots: node, root."""
    placed = met.join(roots, met["cls"] == roots["node"], "left").select("band", "cls", F.coalesce("root", "cls").alias("root"))
    parts = placed.groupBy("band", "root").agg(F.count("*").alias("size"))
    several = parts.groupBy("band").agg(F.max(F.struct("size", "root")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("all")).filter("parts > 1")
    rows = placed.join(several, "band")
    out_blocks = F.ceil((F.col("all") - F.col("main.size")) / OUTSIDE).cast("int")
    in_blocks = F.ceil(F.col("all") / INSIDE).cast("int")
    rows = rows.select("band", "cls", "root", (F.col("root") != F.col("main.root")).alias("out"), out_blocks.alias("ob"), in_blocks.alias("ib"))
    own_out, own_in = F.pmod(F.xxhash64("cls"), F.col("ob")).cast("int"), F.pmod(F.xxhash64("cls"), F.col("ib")).cast("int")
    lone = F.lit(0)
    outsiders = rows.filter("out").select("band", "cls", "root", F.lit(True).alias("outside"), own_out.alias("i"), F.explode(F.sequence(lone, F.col("ib") - 1)).alias("j"))
    insiders = rows.select("band", "cls", "root", F.lit(False).alias("outside"), F.explode(F.sequence(lone, F.col("ob") - 1)).alias("i"), own_in.alias("j"))
    full = outsiders.union(insiders).join(classes.select("cls", "bands"), "cls").join(sets, "cls")
    return full.groupBy("band", "i", "j").applyInArrow(links_across(percent), "u bigint, v bigint")


def grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of docs, and cls, component_id, __row, __mark (the row that stands for the component) of every class."""
    shelf = Shelf(docs.sparkSession)
    rows = shelf.put(sketches(docs, k))
    classes = shelf.put(
        rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row", "__mark")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .select("cls", "least.doc_id", "least.__row", "least.__mark", "n", "bands")
    )
    exploded = classes.select(F.explode("bands").alias("band"), "cls", "n")
    shared = exploded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    met = shelf.put(exploded.join(shared, "band"))
    weights = shelf.put(met.groupBy("cls").agg(F.sum("size").alias("weight")))
    sets = shelf.put(full_sets(docs, classes.select("__row", "__mark", "cls").join(weights.select("cls"), "cls", "left_semi"), k).dropDuplicates(["cls"]))
    links = shelf.put(confirmed(stars(met.join(weights, "cls"), percent), sets, percent))
    roots = shelf.put(components(links, shelf))
    missed = shelf.put(missed_links(met, roots, classes, sets, percent).distinct())
    named = ["cls", "doc_id", "__row", "__mark"]
    labelled = classes.join(roots, classes["cls"] == roots["node"], "left").select(*named, F.coalesce("root", "cls").alias("root"))
    if not missed.isEmpty():
        root_u = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        root_v = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        bridges = missed.join(root_u, "u", "left").join(root_v, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        merged = shelf.put(components(bridges, shelf)).withColumnRenamed("root", "top")
        labelled = labelled.join(merged, labelled["root"] == merged["node"], "left").select(*named, F.coalesce("top", "root").alias("root"))
    # the row of smallest doc_id stands for its component
    least = labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row", "__mark")).alias("least"))
    ids = shelf.put(labelled.join(least, "root").select("cls", F.col("least.doc_id").alias("component_id"), F.col("least.__row").alias("__row"), F.col("least.__mark").alias("__mark")))
    for gone in (classes, met, weights, sets):
        shelf.drop(gone)
    return rows, ids


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    rows, ids = grouped(docs, k, percent)
    out = rows.select("doc_id", "n", "cls").join(ids.select("cls", "component_id"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


@any_names
def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of smallest doc_id (of several, of smallest hash).

    Rows without words are linked with nothing and stay, each doc_id's and text's once. The semi join and the choice
    among repeated rows share one shuffle.
    """
    rows, ids = grouped(docs, k, percent)
    stay = ids.select("__row", "__mark").union(rows.filter("cls IS NULL").select("__row", "__mark")).distinct()
    return docs.select("*", *row_keys()).join(stay, ["__row", "__mark"], "left_semi").dropDuplicates(["__row", "__mark"]).select(docs.columns)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), items AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(u, v) AS (
  SELECT u, v FROM pairs
  UNION
  SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u
), least_of AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_of l ON l.u = s.doc_id
"""
