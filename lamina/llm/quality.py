"""Quality rules: importance of a document by hashed n-grams, and plain counts.

Two multinomials over hashed one- and two-token features are counted: one of
the trusted target, one of the raw corpus.  A document's score is the mean of
log(target / raw) over its features, so length does not matter; the document
is kept when the score reaches a threshold.  Tokens are runs of letters and
digits or runs of other solid characters, ASCII case folded.

The raw counts cover all features of all texts.  The number of cells that
features are hashed to grows with the corpus: one for each ``CELL_BYTES`` of
text, at most ``2 ** MOST_BITS`` of them, as their weights are broadcast (4
bytes each).  Map tasks send the cells that they met, compressed, in ``SLICES`` groups by
cell; a group is added up batch by batch into its share of the table.  The
target is every row labelled good that a model may learn from: a hashed semi
join finds their texts, which are shuffled once and counted like the raw ones.
The threshold is the value that best separates all other labelled rows, good
from bad, and is ``THRESHOLD`` where labels are one-sided.  Every row is scored
once; the scores are written, and running counts over them find the threshold,
so that only its few figures come to the driver, never a score or a text.

Defined results: null or blank text has zero counts, fails the base rule and
isn't kept; a text without features scores 0; repeated rows are rows of their
own; rows with a null id are scored like others and never part of the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lamina.llm.common import checkpoint, table, training_row
from lamina.llm.words import Words, cut, expanded, grams, inside, mix, runs_of, squeezed, steps, text_buffers

#: Bytes of text for a cell of the table, and the bits of its least and greatest size.
CELL_BYTES = 256
LEAST_BITS, MOST_BITS = 16, 24
SLICES = 64
THRESHOLD = -0.25
#: Running counts start anew after this width of scores.
WIDTH = 1 / 4096
#: Pseudo-counts that each feature has in both multinomials.
SUPPORT = 20.0
SLACK = 0.03
MIN_WORDS = 20
MAX_REPEAT = 30
WINDOW = 8
_KIND = np.full(256, 2, np.uint8)
_KIND[[*b" \t\n\x0b\x0c\r"]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def table_bits(size: int) -> int:
    """Bits of a cell's number for that many bytes of text."""
    return min(MOST_BITS, max(LEAST_BITS, (size // CELL_BYTES).bit_length()))


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document's row, feature) of all one- and two-token features."""
    tokens = runs_of(_FOLD[data], _KIND[data], offsets)
    h = tokens.hashes()
    doc = tokens.doc()
    pair = grams(h, 2)
    ok = inside(tokens.first, 2, len(h))
    both = np.concatenate([h, pair[ok]]) >> np.uint64(64 - bits)
    return np.concatenate([doc, doc[: len(pair)][ok]]), both.astype(np.int64)


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features; 0 without features."""
    data, offsets = text_buffers(column)
    out, bits = np.zeros(len(offsets) - 1), len(weights).bit_length() - 1
    for a, b in steps(offsets):
        doc, feature = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
        n = np.bincount(doc, minlength=b - a)
        out[a:b] = np.bincount(doc, weights[feature], minlength=b - a) / np.maximum(n, 1)
    return out


def _repeats(words: Words) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in it."""
    out = np.zeros(len(words.first) - 1, np.int64)
    ok = np.flatnonzero(inside(words.first, WINDOW, len(words.start))) if len(words.start) >= WINDOW else np.empty(0, np.int64)
    if not len(ok):
        return out
    doc = np.searchsorted(words.first, ok, "right") - 1
    key = mix(grams(words.hashes(), WINDOW)[ok] ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    twice = np.zeros(len(ok), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, ok[twice], 1)
    np.add.at(change, ok[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    solid = [x for x in lines if x.strip()]
    return len(solid) - len(set(solid))


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for a, b in steps(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words = cut(part, off)
        out["n_words"][a:b] = words.counts
        solid = np.concatenate([[0], np.cumsum((_KIND[part] != 0) & ((part & 0xC0) != 0x80))])
        out["word_chars"][a:b] = solid[off[1:]] - solid[off[:-1]]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[part])])
        out["n_symbols"][a:b] = symbols[off[1:]] - symbols[off[:-1]]
        out["n_repeat_words"][a:b] = _repeats(words)
        raw = part.tobytes()
        out["n_dup_lines"][a:b] = [_dup_lines(raw[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
    return out


def target_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text of every row labelled good that a model may learn from."""
    learn = training_row("__id")
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("__id")).where(learn).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").where(learn)
    return rows.join(ids.hint("shuffle_hash"), "__id", "left_semi").select("text")


class _Cells:
    """Counts of cells met: sorted cells with their raw and target counts."""

    def __init__(self) -> None:
        self.cell = np.empty(0, np.int64)
        self.count = np.empty((0, 2), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, cell: np.ndarray, trusted: np.ndarray) -> None:
        found, where, n = np.unique(cell, return_inverse=True, return_counts=True)
        target = np.bincount(where[trusted], minlength=len(found))
        self.waiting.append((found, np.stack([n - target, target], 1)))
        self.held += len(found)
        if self.held > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            cell = np.concatenate([self.cell, *(c for c, _ in self.waiting)])
            count = np.concatenate([self.count, *(n for _, n in self.waiting)])
            order = np.argsort(cell, kind="stable")
            begin = np.flatnonzero(np.diff(cell[order], prepend=-1))
            self.cell, self.count = cell[order][begin], np.add.reduceat(count[order], begin) if len(begin) else count
            self.waiting, self.held = [], 0


def multinomials(docs: DataFrame, target: DataFrame, bits: int) -> DataFrame:
    """slice, raw, target and counts of each group of cells: the totals, and by cell the raw corpus's counts and the target's."""
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells()
        for b in batches:
            trusted = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(b.column(1))
            for x, y in steps(offsets):
                doc, feature = features(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], bits)
                cells.add(feature, trusted[x:y][doc])
        cells.settle()
        edges = np.searchsorted(cells.cell, width * np.arange(SLICES + 1)).tolist()
        packed = [squeezed(np.diff(cells.cell[i:j] % width, prepend=0), *cells.count[i:j].T) for i, j in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width), np.int64)
        for b in batches:
            for x in b.column(1).to_pylist():
                step, *n = expanded(x, 3)
                total[:, np.cumsum(step)] += n
        sums = [pa.array([int(x)], pa.int64()) for x in total.sum(1)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *sums, pa.array([squeezed(*total)], pa.binary())], ["slice", "raw", "target", "counts"])

    both = docs.select(F.lit(False), "text").unionAll(target.select(F.lit(True), "text"))
    parts = both.mapInArrow(count, "slice int, counts binary")
    return checkpoint(parts.groupBy("slice").applyInArrow(add, "slice int, raw long, target long, counts binary"))


def cell_weights(counts: DataFrame, bits: int) -> np.ndarray:
    """The weight of each cell; a slice of the counts is on the driver at a time."""
    out = np.zeros((SLICES, (1 << bits) // SLICES), np.float32)
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if target:
        for r in counts.toLocalIterator():
            out[r["slice"]] = weights(expanded(r["counts"], 2), target / raw)
    return out.reshape(-1)


def weights(counts: np.ndarray, share: float, support: float = SUPPORT) -> np.ndarray:
    """log(target / raw) of each feature, raw counts brought to the target's size by share, drawn to 0 where the target is expected to hold few of it."""
    return np.log((counts[1] + support) / (counts[0] * share + support))


def _loss(good, bad, n_good: int, n_bad: int):
    """Loss of a cut above that many good and bad rows, as arrays or columns; a mistake on a good row counts five times."""
    return 5 * good / n_good + 1 - bad / n_bad


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the gap that separates best.

    All cuts within ``SLACK`` of the least loss count as best; the middle of their range is taken.
    """
    if not len(good) or not len(bad):
        return THRESHOLD
    cuts = np.unique(np.concatenate([good, bad]))
    middle = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    loss = _loss(np.searchsorted(np.sort(good), middle), np.searchsorted(np.sort(bad), middle), len(good), len(bad))
    best = np.flatnonzero(loss <= loss.min() + SLACK)
    return float((middle[best[0]] + middle[best[-1]]) / 2)


def _failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT * base["n_words"])


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """best_threshold of all labelled rows that no model learned from and that pass the base rule."""
    marks = (
        labels.where("quality IN (0, 1)")
        .select(F.col("doc_id").cast("long").alias("__id"), "quality")
        .where("__id IS NOT NULL")
        .where(~training_row("__id"))
        .groupBy("__id")
        .agg(*(F.max((F.col("quality") == q).cast("long")).alias(k) for k, q in (("good", 1), ("bad", 0))))
    )
    fair = scored.where("NOT base_failed").select(F.col("doc_id").cast("long").alias("__id"), "score")
    counts = fair.join(marks, "__id").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    cuts = checkpoint(counts.withColumn("part", F.floor(F.col("score") / WIDTH)))
    parts = cuts.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    n_good, n_bad = parts.agg(F.sum("good"), F.sum("bad")).first()
    if not n_good or not n_bad:
        return THRESHOLD

    def below(name: str, over: WindowSpec) -> Column:
        return F.coalesce(F.sum(name).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    whole, inner = Window.orderBy("part"), Window.partitionBy("part").orderBy("score")
    starts = parts.select("part", *(below(k, whole).alias(f"{k}_before") for k in ("good", "bad")))
    good, bad = (F.col(f"{k}_before") + below(k, inner) for k in ("good", "bad"))
    losses = cuts.join(starts, "part").select("score", _loss(good, bad, n_good, n_bad).alias("loss"))
    least = losses.agg(F.min("loss")).first()[0]
    ends = losses.where(F.col("loss") <= least + SLACK).agg(F.min("score"), F.max("score")).first()
    before = cuts.agg(*(F.max(F.when(F.col("score") < x, F.col("score"))) for x in ends)).first()
    first, last = (x - 1 if y is None else (x + y) / 2 for x, y in zip(ends, before))
    return (first + last) / 2


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, score, base_failed and kept of every row."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = table_bits(size)
    counts = multinomials(docs, target_texts(docs, labels), bits)
    sent = docs.sparkSession.sparkContext.broadcast(cell_weights(counts, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = base_counts(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, base.values()), pa.array(_failed(base)), pa.array(scores(b.column(1), sent.value))],
                ["doc_id", *base, "base_failed", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double"
    scored = checkpoint(docs.select("doc_id", "text").mapInArrow(run, schema))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold(scored, labels))
    return scored.select(*scored.columns[:-1], kept.alias("kept"), "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
