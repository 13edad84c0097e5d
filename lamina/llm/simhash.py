"""SimHash near-duplicates through a byte-position inverted index.

Fingerprints that differ in at most three bits agree in at least five of their
eight bytes.  So they agree in at least four of the first seven.  The index
has a posting list for each choice of four of those seven positions together
with the bytes there (no list is keyed by one byte: it would hold 1 in 256
fingerprints).  Lists with one member go.  Pairs meet in their lists and are
tallied over them: two fingerprints that share m of the seven positional bytes
meet in C(m, 4) lists, so the number of lists tells m.  Pairs whose tally, with
the eighth byte, is below five are dropped, and what is left is verified by
counting differing bits.

A list holds *distinct* fingerprints, so copies never multiply, and 32 fixed
bits select it: n fingerprints without structure meet in about 35 n^2 / 2^33
pairs, which is below one for each fingerprint up to n = 2.4e8 and below 20
for each up to n = 4.9e9; beyond that the lists want a fifth position.  The
index is shuffled once; only lists with two members or more are written and
joined to themselves, where Spark splits a long one.  Links of a fingerprint
are bounded by the 43,744 others within three bits.

Defined results: null or blank text has fingerprint zero and links like any
other; rows with a null id get the component of their fingerprint (null if no
row of the component has an id); repeated rows are kept; other columns of the
input pass through untouched, and an input column that has the name of a
result column is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm.common import checkpoint, table

#: Differing bits that still link; the index is laid out for three.
MAX_BITS = 3
#: Positional bytes that such a pair shares at least.
MIN_BYTES = 8 - MAX_BITS
SEED = 42
SHINGLE = 3
CHOICES = list(combinations(range(7), MIN_BYTES - 1))
#: Hashes of one document that are held as bits at once.
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """The 64-bit SimHash over n-word shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes.lower() changes A-Z only, bytes.split() cuts on the six blanks
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < n:
        hashes = [digest(joined, SEED)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip((end - length).tolist(), end[n - 1 :].tolist())]
    found = np.array(hashes, ">u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, len(found), _BLOCK):
        bits += np.unpackbits(found[at : at + _BLOCK].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(found)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """extra columns and ``fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], [*b.schema.names[:-1], "fp"])

    taken = docs.select(*extra, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(run, f"{fields}, fp long")


def _byte(fp: F.Column, k: int) -> F.Column:
    return F.shiftrightunsigned(fp, 8 * (7 - k)).bitwiseAND(F.lit(255))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column fp with at most MAX_BITS differing bits."""
    keys = []
    for i, choice in enumerate(CHOICES):
        key = F.lit(i).cast("long")
        for k in choice:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), k))
        keys.append(key)
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = checkpoint(index.withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1").drop("n"))
    meet = lists.withColumnRenamed("fp", "a").join(lists.withColumnRenamed("fp", "b"), "key").where("a < b")
    tally = meet.groupBy("a", "b").agg(F.count("*").alias("lists"))
    other = F.col("a").bitwiseXOR(F.col("b"))
    shared = F.lit(0)
    for m in range(MIN_BYTES - 1, 8):
        shared = F.when(F.col("lists") == comb(m, MIN_BYTES - 1), m).otherwise(shared)
    enough = shared + (_byte(other, 7) == 0).cast("int") >= MIN_BYTES
    return tally.where(enough).where(F.bit_count(other) <= MAX_BITS).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of the pairs (a, b).

    Alternates large-star and small-star steps (Kiveris and others, 2014) until
    no pair changes; each round is cut off by a checkpoint, and only two
    numbers of it come to the driver.
    """
    edges = checkpoint(pairs.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def clusters(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, tag, root and component_id of every row; tag is the text's hash where the id is null, root a fingerprint of the component."""
    tag = F.when(F.col(id_column).isNull(), _tag(F.col(text)))
    slim = docs.select(F.col(id_column).alias("doc_id"), tag.alias("tag"), F.col(text).alias("text"))
    prints = checkpoint(fingerprints(slim, extra=("doc_id", "tag")))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    root = components(links(distinct.select("fp")))
    least = (
        distinct.join(root, distinct.fp == root.node, "left")
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    )
    class_id = least.groupBy("root").agg(F.min("low").alias("component_id"))
    of = least.join(class_id, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp")


def _tag(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    return clusters(docs, id_column, text).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their component; all columns stay.

    Rows that repeat an id are one document, which goes if any of them links to
    a smaller id; else one row of it stays, the smallest.  Rows without an id
    come after all ids: none stays in a component that has an id, and in one
    without ids a single row stays, of the least text hash.  The text is
    shuffled once, for the anti-join (not at all where Spark finds the list of
    losers small enough to send), and again only for rows without an id.
    """
    found = checkpoint(clusters(docs))
    losers = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    named = found.where("doc_id IS NULL").isEmpty()
    rows = docs if named else docs.where("doc_id IS NOT NULL")
    kept = rows.join(losers, F.col("doc_id") == F.col("__gone"), "left_anti")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__more"))
    if not repeated.isEmpty():
        same = F.col("doc_id") == F.col("__more")
        others = [c for c in docs.columns if c != "doc_id"]
        several = kept.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("__row"))
        kept = kept.join(repeated, same, "left_anti").unionByName(several.select("doc_id", "__row.*")).select(*docs.columns)
    if named:
        return kept
    alone = found.where("doc_id IS NULL AND component_id IS NULL").groupBy("root").agg(F.min("tag").alias("__tag")).select("__tag")
    nameless = docs.where("doc_id IS NULL").groupBy(_tag(F.col("text")).alias("__own")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return kept.unionByName(nameless.join(alone, F.col("__own") == F.col("__tag"), "left_semi").select("__row.*"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
