"""Packing documents into sequences by a grouping genetic algorithm on islands.

Tokenising is map-side: blanks are word bounds for this tokenizer, so a word's
ids are looked up in a per-worker cache and the library is asked once for a
new word.  A document is its ids and one id 0; one longer than a sequence is
cut into full pieces and a last one.  Full pieces are sequences of their own.

The others are dealt into shards of about ``SHARD`` pieces, and each shard is
evolved on ``ISLANDS`` islands (a grouping genetic algorithm: Falkenauer,
1996).  A chromosome is a set of bins.  Crossover injects some of the other
parent's well-filled bins whole and removes the bins that hold any of their
pieces a second time; displaced pieces first take the place of shorter ones
where that fills a bin better, and the rest are put back by best fit, longest
first.  A mutation empties some bins instead.  After an epoch each island's
elite migrates to the next island (a ring) and evolves on there; after
``EPOCHS`` migrations the shard's best packing wins.  An island stops at the
lower bound, which no packing can beat, or when ``PATIENCE`` generations gain
nothing; ``report`` says how far each shard is
from it.

A shard's size does not grow with the corpus, shards are independent, and a
row of the shuffles is one island with its lengths and bins packed as bytes.

Defined results: null or empty text is the single id 0; repeated rows and rows
with a null id are packed each by itself; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import checkpoint, held, table
from lamina.llm.tokens import Kept, Merges, load, tokenizer_path

LENGTH = 2048
SHARD = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 6
GENERATIONS = 48
#: Generations without a sequence less after which an island stops.
PATIENCE = 8
CACHED = 250_000


class Ids(Kept):
    """Little-endian 32-bit ids by word."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        super().__init__(cached)
        self.library = load(path)
        self.merges = Merges(self.library, fold=True)

    def make(self, word: bytes) -> bytes:
        ids = self.merges.ids(word)
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids if ids is None else ids, "<u4").tobytes()

    def document(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split())) + b"\0\0\0\0"


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size = held(("ids", path), lambda: Ids(path)), 4 * length
        for b in batches:
            row, piece, start, count, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                got = ids.document(t)
                for k, at in enumerate(range(0, len(got), size)):
                    part = got[at : at + size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    count.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, count, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of item numbers; finds the fullest bin that still takes a length."""

    def __init__(self, room: int) -> None:
        self.room, self.bins, self.left = room, [], []

    def best_fit(self, items: list[int], lengths: list[int]) -> None:
        slots: list[list[int]] = [[] for _ in range(self.room + 1)]
        mask = 0
        for i, r in enumerate(self.left):
            slots[r].append(i)
            mask |= 1 << r
        for x in items:
            n = lengths[x]
            m = mask >> n
            if m:
                r = n + (m & -m).bit_length() - 1
                i = slots[r].pop()
                if not slots[r]:
                    mask ^= 1 << r
                self.bins[i].append(x)
            else:
                i, r = len(self.bins), self.room
                self.bins.append([x])
                self.left.append(r)
            r -= n
            self.left[i] = r
            slots[r].append(i)
            mask |= 1 << r

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then unevenly filled ones, which leave more to gain."""
        return len(self.bins), -sum((self.room - r) ** 2 for r in self.left)


    def swap_in(self, loose: list[int], lengths: list[int]) -> list[int]:
        """Puts loose items where one or two shorter ones of a bin were, if that fills the bin better; what is loose then."""
        free = sorted((lengths[x], x) for x in loose)
        for k, items in enumerate(self.bins):
            if not self.left[k] or not free:
                continue
            outs = [(lengths[x], (x,)) for x in items] + [(lengths[x] + lengths[y], (x, y)) for i, x in enumerate(items) for y in items[:i]] if len(items) < 12 else [(lengths[x], (x,)) for x in items]
            best = (0, -1, ())
            for n, out in outs:
                at = bisect_right(free, (n + self.left[k], math.inf)) - 1
                if at >= 0 and free[at][0] - n > best[0]:
                    best = (free[at][0] - n, at, out)
            gain, at, out = best
            if gain:
                _, x = free.pop(at)
                self.bins[k] = [y for y in items if y not in out] + [x]
                self.left[k] -= gain
                for y in out:
                    insort(free, (lengths[y], y))
        return [x for _, x in free]

    def refill(self, loose: list[int], lengths: list[int]) -> Bins:
        """self with the loose items back in it."""
        self.best_fit(sorted(self.swap_in(loose, lengths), key=lambda x: -lengths[x]), lengths)
        return self


def crossover(one: Bins, other: Bins, lengths: list[int], rng: random.Random) -> Bins:
    """one, with some of other's well-filled bins injected whole."""
    full = sorted(range(len(other.bins)), key=other.left.__getitem__)[: max(1, len(other.bins) // 2)]
    chosen = rng.sample(full, max(1, len(full) // 4))
    taken = {x for i in chosen for x in other.bins[i]}
    child, loose = Bins(one.room), []
    worst = max(one.left, default=0)
    for items, r in zip(one.bins, one.left):
        if taken.isdisjoint(items) and not (r == worst and worst):
            child.bins.append(list(items))
            child.left.append(r)
        else:
            loose += [x for x in items if x not in taken]
    for i in chosen:
        child.bins.append(list(other.bins[i]))
        child.left.append(other.left[i])
    return child.refill(loose, lengths)


def mutation(one: Bins, lengths: list[int], rng: random.Random) -> Bins:
    """one, with its worst bin and some others emptied and their items put back."""
    emptied = {max(range(len(one.bins)), key=one.left.__getitem__), *rng.sample(range(len(one.bins)), min(len(one.bins), max(2, len(one.bins) // 20)))}
    child = Bins(one.room)
    child.bins = [list(x) for i, x in enumerate(one.bins) if i not in emptied]
    child.left = [r for i, r in enumerate(one.left) if i not in emptied]
    return child.refill([x for i in emptied for x in one.bins[i]], lengths)


def lower_bound(lengths: list[int], room: int) -> int:
    """Bins that any packing needs at least."""
    return max(math.ceil(sum(lengths) / room), sum(2 * n > room for n in lengths))


def evolve(lengths: list[int], room: int, seed: int, elites: list[list[list[int]]], generations: int = GENERATIONS) -> Bins:
    """The best packing that an island finds, from elites and greedy starts."""
    rng = random.Random(seed)
    bound = lower_bound(lengths, room)
    people = []
    for bins in elites:
        b = Bins(room)
        b.bins, b.left = [list(x) for x in bins], [room - sum(lengths[i] for i in x) for x in bins]
        people.append(b)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    while len(people) < (POPULATION if generations else 1) and not any(len(b.bins) == bound for b in people):
        b = Bins(room)
        noise = 0.1 if people else 0.0
        b.best_fit(sorted(order, key=lambda i: -lengths[i] * (1 + noise * (rng.random() - 0.5))) if noise else order, lengths)
        people.append(b)
    least, idle = len(lengths) + 1, 0
    for _ in range(generations):
        people.sort(key=Bins.fitness)
        least, idle = (len(people[0].bins), 0) if len(people[0].bins) < least else (least, idle + 1)
        if least <= bound or idle > PATIENCE:
            break
        one, other = rng.sample(people, 2)
        people += [crossover(one, other, lengths, rng), crossover(other, one, lengths, rng), mutation(people[0], lengths, rng)]
        people = sorted(people, key=Bins.fitness)[:POPULATION]
    return min(people, key=Bins.fitness)


def _packed(bins: list[list[int]]) -> bytes:
    return np.array([len(bins), *map(len, bins), *(x for b in bins for x in b)], "<u4").tobytes()


def _bins(payload: bytes) -> list[list[int]]:
    a = np.frombuffer(payload, "<u4").tolist()
    n, out, at = a[0], [], a[0] + 1
    for size in a[1 : n + 1]:
        out.append(a[at : at + size])
        at += size
    return out


_ISLAND = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("n_bins", pa.int64()), ("bound", pa.int64()), ("order", pa.int64()), ("items", pa.binary()), ("bins", pa.binary())])
_ISLAND_SQL = "shard long, island int, n_bins long, bound long, order long, items binary, bins binary"


def _island(shard: int, island: int, rows: np.ndarray, lengths: np.ndarray, best: Bins) -> pa.Table:
    items = rows.astype("<i8").tobytes() + lengths.astype("<i8").tobytes()
    row = {"shard": shard, "island": island, "n_bins": len(best.bins), "bound": lower_bound(lengths.tolist(), best.room), "order": best.fitness()[1], "items": items, "bins": _packed(best.bins)}
    return pa.Table.from_pylist([row], _ISLAND)


def _items(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(payload, "<i8")
    return both[: len(both) // 2], both[len(both) // 2 :]


def islands_of(open_rows: DataFrame, length: int, shards: int, islands: int) -> DataFrame:
    """Each shard's best packing, from rows of (__row, length); shards that best fit alone brings to the bound are done with that."""

    def first(key: tuple, group: pa.Table) -> pa.Table:
        row, size = group.column("__row").to_numpy(), group.column("length").to_numpy()
        order = np.lexsort((row, -size))
        row, size = row[order], size[order]
        return _island(key[0].as_py(), 0, row, size, evolve(size.tolist(), length, 0, [], 0))

    def evolved(epoch: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            k, i = (x.as_py() for x in key)
            got = sorted(group.to_pylist(), key=lambda r: (r["n_bins"], r["island"]))
            if got[0]["n_bins"] == got[0]["bound"]:
                return pa.Table.from_pylist([got[0] | {"island": i}], _ISLAND)
            row, size = _items(got[0]["items"])
            return _island(k, i, row, size, evolve(size.tolist(), length, 1000 * k + islands * epoch + i, [_bins(r["bins"]) for r in got]))

        return run

    dealt = open_rows.select("__row", "length", F.pmod(F.xxhash64("__row"), F.lit(shards)).alias("shard"))
    greedy = checkpoint(dealt.groupBy("shard").applyInArrow(first, _ISLAND_SQL))
    # Every island starts from the greedy packing and from others of its own; after that each has its own elite and its neighbour's.
    now = greedy.where("n_bins > bound").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    for epoch in range(EPOCHS + 1 if islands > 1 else 1):
        if epoch:
            now = now.withColumn("to", F.explode(F.array("island", (F.col("island") + 1) % islands)))
        now = now.groupBy("shard", "to").applyInArrow(evolved(epoch), _ISLAND_SQL)
    best = F.min_by(F.struct("n_bins", "bound", "items", "bins"), F.struct("n_bins", "order", "island")).alias("b")
    columns = ["shard", "n_bins", "bound", "items", "bins"]
    return now.groupBy("shard").agg(best).select("shard", "b.*").select(*columns).unionByName(greedy.where("n_bins = bound").select(*columns))


def _numbered(pieces: DataFrame, length: int, shard: int) -> tuple[DataFrame, DataFrame, int]:
    """Pieces with row numbers, those of them that are shorter than a sequence, and the number of shards."""
    rows = checkpoint(pieces).withColumn("__row", F.monotonically_increasing_id())
    open_rows = rows.where(F.col("length") < length)
    return rows, open_rows, max(1, math.ceil(open_rows.count() / shard))


def report(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS) -> DataFrame:
    """shard, n_bins, bound (bins that any packing of it needs) and greedy (bins of best fit alone) of every shard."""
    _, open_rows, shards = _numbered(pieces, length, shard)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            greedy = []
            for payload in b.column(3).to_pylist():
                size, bins = sorted(_items(payload)[1].tolist(), reverse=True), Bins(length)
                bins.best_fit(list(range(len(size))), size)
                greedy.append(len(bins.bins))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(greedy, pa.int64())], ["shard", "n_bins", "bound", "greedy"])

    return islands_of(open_rows, length, shards, islands).select("shard", "n_bins", "bound", "items").mapInArrow(count, "shard long, n_bins long, bound long, greedy long")


def pack(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS) -> DataFrame:
    """pieces (with a column length of 1 to length) with sequence_id and offset."""
    rows, open_rows, shards = _numbered(pieces, length, shard)
    full = rows.where(F.col("length") == length).select(
        *pieces.columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                row, size = _items(r["items"])
                bins = _bins(r["bins"])
                flat = np.array([x for y in bins for x in y], np.int64)
                of = np.repeat(np.arange(len(bins)), [len(y) for y in bins])
                ends = np.cumsum(size[flat])
                base = np.repeat(np.concatenate([[0], ends[np.cumsum([len(y) for y in bins])[:-1] - 1]]), [len(y) for y in bins])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[flat]), pa.array((r["shard"] << 24) + of), pa.array(ends - size[flat] - base)], ["__row", "sequence_id", "offset"]
                )

    best = islands_of(open_rows, length, shards, islands).select("shard", "items", "bins")
    spots = best.mapInArrow(placed, "__row long, sequence_id long, offset long")
    return open_rows.join(spots, "__row").select(*pieces.columns, "sequence_id", "offset").unionByName(full)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
