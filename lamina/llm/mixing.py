"""Mixing sources to target weights along a time-varying curriculum.

Targets.  Sources, ordered by code point with null last, weigh ``WEIGHTS``
repeated; together they get ``SHARE`` of all words; none gets more than
``CAP`` times its own size, and what it can't take is shared out by weight
again.  That is a water level: with sources ordered by size/weight, those
below the level are full and the others get level x weight.

Curriculum.  A source's rate over training time t in [0, 1] is
``1 + slope * (2t - 1)`` of its mean rate, the slope of a source alternating
between early and late.  Its integral is ``t + slope * (t*t - t)`` of the
target.  Documents of a source stand in a fixed pseudo-random order; the words
before one are its cumulative demand, and the demand's inverse gives its
training position.  Each pass over a source goes on where the last one
ended: pass k of a document has the words before it and those of k whole
passes as its demand, and a position of its own.  A document is taken whole or
not at all in a pass (when the middle of its words lies below the target), so
``taken`` is 0, 1 or 2 times its size.  ``schedule`` and ``mixed`` (the mix
itself) have a row for each pass and are range-sorted by position; op8_mixing
has a row for each document with the positions of its passes, range-sorted by
the first.

Scale.  Only sizes move.  The running sum of a source is made of blocks of
its order, about ``BLOCK`` rows each: block totals are summed over blocks, and
rows only within their block, so a source with a third of all rows is many
tasks.  The order is by a hash of id and text, so neither rows without an id
nor rows that share one meet in a block, but for those that are the same in
both.  Windows without a partition run over sources and over a source's
blocks, never over rows.  Everything is SQL functions.

Defined results: null or blank text has size 0 and is taken 0 words; rows with
a null source form the last source; repeated rows are rows of their own; an
empty table gives no rows; extra columns pass through, and one named like a
result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm.common import checkpoint, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SLOPE = 0.5
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    """Number of words: places where a solid character follows a blank or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_rows, rank, target from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    one = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(one) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long"))
    # No source above the level: full ones in order of size/weight, as exact fractions compared by a double with ties by rank.
    by = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    cap = F.col("source_size") * CAP
    per = per.withColumn("total", F.sum("source_size").over(W.partitionBy()))
    level = (F.col("total") * F.lit(SHARE) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("full", cap.cast("double") <= F.col("level") * F.col("weight"))
    # The first source that isn't full sets the level of all that follow.
    water = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank")))).over(W.partitionBy())
    target = F.when(F.col("full"), cap.cast("double")).otherwise(F.least(cap.cast("double"), water * F.col("weight")))
    return per.select("source", "source_size", "n_rows", "rank", target.alias("target"))


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with the words of its source before each row, in the order of __key, and __copy (from 1) among rows of the same key."""
    totals = rows.groupBy("rank", "__block").agg(F.sum("size").alias("__words"))
    running = W.partitionBy("rank").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("rank", "__block", F.coalesce(F.sum("__words").over(running), F.lit(0)).alias("__base"))
    within = W.partitionBy("rank", "__block").orderBy("__key", "size")
    inner = rows.withColumn("__inner", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = inner.withColumn("__copy", F.row_number().over(W.partitionBy("rank", "__block", "__key").orderBy("size")))
    return inner.join(totals, ["rank", "__block"]).withColumn("before", F.col("__base") + F.col("__inner"))


def row_key(doc_id: F.Column, text: F.Column) -> F.Column:
    """Hash of id and text: a row's place in its source's order."""
    part = lambda c: F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit(""))
    return F.md5(F.concat(part(doc_id), part(text)).cast("binary"))


def taken_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, key, copy, size, source_size, target, taken, passes and positions (of each pass) of every row; text is read and left behind."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    sized = checkpoint(slim.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text")).alias("__key"), word_count(F.col("text")).alias("size")))
    goal = checkpoint(targets(sized)).withColumnRenamed("source", "__source")
    rows = sized.join(goal, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    blocks = F.ceil(F.col("n_rows") / F.lit(BLOCK))
    rows = rows.withColumn("__block", F.shiftright(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * blocks, 32))
    placed = _ordered(rows)
    a = F.when(F.col("rank") % 2 == 0, F.lit(SLOPE)).otherwise(F.lit(-SLOPE))
    passes, positions = F.lit(0), []
    for k in range(CAP):
        demand = F.col("before") + F.col("source_size") * k
        in_pass = demand + F.col("size") / 2 < F.col("target")
        passes = passes + in_pass.cast("int")
        # Inverse of t + a (t*t - t): the demand's share when this document's first word comes up.
        share = demand / F.col("target")
        position = (-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * share)) / (2 * a)
        positions.append(F.when(in_pass & (F.col("size") > 0), position))
    return placed.select(
        "doc_id", "source", F.col("__key").alias("key"), F.col("__copy").alias("copy"), "size", "source_size", "target", (F.col("size") * passes).alias("taken"),
        F.array_compact(F.array(*positions)).alias("positions"), passes.alias("passes"),
    )


def schedule(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, pass (from 0) and position of every pass of every row, range-sorted by position."""
    rows = taken_words(docs, id_column, text, source)
    return rows.select("doc_id", "source", "size", F.posexplode("positions").alias("pass", "position")).sort("position", "pass", "doc_id")


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix: each row as often as it is taken, all columns of docs, range-sorted by training position.

    Rows without words carry nothing to train on and are not in the mix.  Rows
    that repeat a source, id and text are taken one by one, like all others:
    which of them comes first is open, as they differ in extra columns at most.
    """
    taken = taken_words(docs, id_column, text, source).where("passes > 0 AND size > 0")
    taken = checkpoint(taken.select(F.col("source").alias("__source"), F.col("key").alias("__theirs"), F.col("copy").alias("__nth"), F.col("positions").alias("__positions")))
    rows = docs.withColumn("__key", row_key(F.col(id_column), F.col(text)))
    same = F.col(source).eqNullSafe(F.col("__source")) & (F.col("__key") == F.col("__theirs"))
    repeated = taken.where("__nth > 1").select("__source", "__theirs").distinct()
    if repeated.isEmpty():
        found = rows.join(taken, same)
    else:
        alone = rows.join(repeated, same, "left_anti").withColumn("__copy", F.lit(1))
        several = rows.join(repeated, same, "left_semi").withColumn("__copy", F.row_number().over(W.partitionBy(source, "__key").orderBy(id_column)))
        found = alone.unionByName(several).join(taken, same & (F.col("__copy") == F.col("__nth")))
    found = found.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode("__positions").alias("__pass", "__position"))
    return found.sort("__position", "__pass", id_column).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = taken_words(table(spark, sf_dir, "documents"))
    position = [F.round(F.get("positions", k), 9).alias(f"position_{k + 1}") for k in range(CAP)]
    return got.select("doc_id", "size", "source_size", "target", "taken", *position).sort(F.asc_nulls_last("position_1"), "doc_id")


#: The passes are rows of their own here, and a pass's demand is summed over all rows before it.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, SUM(size)::BIGINT AS source_size, ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][rnk % 3 + 1]::BIGINT AS weight, (SUM(source_size) OVER ())::BIGINT AS total FROM per
), levels AS (
  SELECT *, (total * 1.5::DOUBLE - COALESCE((SUM(2 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
    / (SUM(weight) OVER (ORDER BY source_size::DOUBLE / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed
), water AS (
  SELECT arg_min(level, source_size::DOUBLE / weight) AS level FROM levels WHERE NOT (2 * source_size)::DOUBLE <= level * weight
), goals AS (
  SELECT l.source, l.source_size, l.rnk,
    CASE WHEN (2 * l.source_size)::DOUBLE <= l.level * l.weight THEN (2 * l.source_size)::DOUBLE
         ELSE least((2 * l.source_size)::DOUBLE, w.level * l.weight) END AS target
  FROM levels l LEFT JOIN water w ON TRUE
), keyed AS (
  SELECT doc_id, md5(COALESCE(md5(doc_id::VARCHAR), '') || COALESCE(md5(text), '')) AS k, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), passes AS (
  SELECT d.doc_id, d.k, d.size, g.source_size, g.target, g.rnk, p.n,
    COALESCE(SUM(d.size) OVER (PARTITION BY g.rnk ORDER BY p.n, d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS demand
  FROM keyed d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source CROSS JOIN (VALUES (1), (2)) p(n)
), timed AS (
  SELECT *, demand + size / 2.0::DOUBLE < target AS taken, CASE WHEN rnk % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS a FROM passes
), placed AS (
  SELECT *, CASE WHEN taken AND size > 0 THEN round((a - 1 + sqrt((1 - a) * (1 - a) + 4 * a * (demand / target))) / (2 * a), 9) END AS t FROM timed
)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, SUM(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken,
  any_value(t) FILTER (n = 1) AS position_1, any_value(t) FILTER (n = 2) AS position_2
FROM placed GROUP BY doc_id, k
"""
