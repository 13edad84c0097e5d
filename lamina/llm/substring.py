"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

The corpus is its own reference.  Map tasks cut it into *reference blocks* of
whole documents and index each block's 20-word phrases: what a phrase is, and
the document and word where it starts first in the block.  The blocks' indexes
meet, partitioned by an anchor of the phrase, so that a phrase is sought in
the index of every block at once and gets its source: the earliest start in
any of them.

A document is then parsed greedily.  A factor (source block, source document,
source position, length) begins at the first word from which a phrase has a
source and is as long as the source goes on word for word, that is as long as
the phrases that follow have the next places of the same source.  The next
factor is sought from the word after its end.  Phrases that begin within a
factor and end beyond it lie across a *boundary*; each has been sought like
all others, and where one has a source the words beyond the boundary make a
factor of their own, which may be short.  So the factors are disjoint, none
lacks a source, and their words are those of all phrases that start earlier
too.  Those words go.

*Earlier* is by (id, text hash, word position), rows without an id before all
others; rows that repeat an id and its text are one document.

Scale.  A block sends a phrase once, from its first place; further places have
their source in the block already and travel as runs of whole factors (of rows
that repeat a document only the first one's).  So a
phrase that a third of the corpus shares is one entry a block.  Neighbouring
phrases share an anchor (the least hash of their 8-word grams) and travel as
one run, about 11 bytes a phrase.  The number of partitions of the index
follows the bytes of text (``BUCKET`` each).  Only factors come back; the text
is joined to them once.

Phrases are equal if 120 bits of hash are: the 64-bit anchor and 56 bits of
another hash of all twenty words, over other hashes of words; documents are
told apart by their id and 64 bits of their text's hash, 128 bits where there
is no id.

Defined results: null or blank text has no words; rows with a null id form one
document per distinct text, earlier than all ids; repeated rows are cleaned
alike; an empty table gives no rows; extra columns pass through, one named
like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import held, partitions, table, trim
from lamina.llm.words import expanded, grams, inside, mix, squeezed, tables

WINDOW = 20
GRAM = 8
#: Windows of a reference block.
BLOCK = 400_000
#: Bytes of text whose phrases a partition of the index holds.
BUCKET = 1 << 22
#: Partitions of the index that a task holds one after another.
TOGETHER = 4
#: Windows of a run at most: its length shares a byte with the flag of a document with an id.
RUN = 127
#: Where a word starts: (with id?, id or hash, hash of the text, word).
_PLACE = np.dtype([("named", "?"), ("id", "<i8"), ("tag", "<i8"), ("pos", "<u4")])
#: Bytes of a phrase's hash that travel.
BYTES = 7
_HASH = np.dtype((np.uint8, BYTES))
_KEPT = np.uint64((1 << 8 * BYTES) - 1)
_NONE = np.empty(0, "<i4")


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


def phrases(column: pa.Array, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document's row, word position, anchor, hash) of every window, by ranges of rows."""
    gram = max(1, min(GRAM, window // 2))
    for at, _, words in tables(column):
        if len(words.start) < window:
            continue
        h, g = words.hashes(), words.hashes(again=True)
        ok = np.flatnonzero(inside(words.first, window, len(h)))
        if not len(ok):
            continue
        anchor = _sliding_min(grams(g, gram), window - gram + 1)
        doc = np.searchsorted(words.first, ok, "right") - 1
        yield at + doc, ok - words.first[doc], anchor[ok], grams(h, window)[ok] & _KEPT


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs that change marks the first item of."""
    begin = np.flatnonzero(change)
    return begin, np.diff(begin, append=len(change))


def _sources(key: list[np.ndarray], rank: np.ndarray) -> np.ndarray:
    """For each item the one of equal key (compared in all parts of key) with the least rank."""
    order = np.lexsort((rank, *key))
    new = np.zeros(len(order), bool)
    for part in key:
        new[1:] |= part[order[1:]] != part[order[:-1]]
    new[:1] = True
    begin, length = _runs(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(order[begin], length)
    return out


def _ranked(named: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Rank of each document; equal ones have equal ranks."""
    order = np.lexsort((tags, ids, named))
    new = np.zeros(len(order), bool)
    for part in (named, ids, tags):
        new[1:] |= part[order[1:]] != part[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _chained(doc: np.ndarray, pos: np.ndarray, to: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which items do not go on from the one before: the next word of the same document and of the same source."""
    change = np.ones(len(doc), bool)
    change[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (to[1:] != to[:-1]) | (at[1:] != at[:-1] + 1)
    return change


def _factors(place: np.ndarray, count: np.ndarray, source: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    parts = [place["named"], place["id"], place["tag"], place["pos"].astype(np.int32), count.astype(np.int32),
             source["named"], source["id"], source["tag"], source["pos"].astype(np.int32), block]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in parts], _FACTOR_NAMES)


_FACTOR_SQL = "__named boolean, __id long, __tag long, start int, count int, from_named boolean, from_id long, from_tag long, from_start int, block long"
_FACTOR_NAMES = [x.split()[0] for x in _FACTOR_SQL.split(", ")]


class _Block:
    """Phrases of some documents until they are enough for a reference block."""

    def __init__(self, buckets: int, window: int) -> None:
        self.buckets, self.window, self.made = buckets, window, 0
        self.clear()

    def clear(self) -> None:
        self.parts, self.docs, self.size = [], [], 0

    def add(self, docs: np.ndarray, text: pa.Array) -> Iterator[dict]:
        base = sum(map(len, self.docs))
        self.docs.append(docs)
        for doc, pos, anchor, hashed in phrases(text, self.window):
            self.parts.append((base + doc, pos, anchor, hashed))
            self.size += len(doc)
            if self.size >= BLOCK:
                yield from self.flush()
                self.docs, base = [docs], 0

    def flush(self) -> Iterator[dict]:
        if self.parts:
            context = TaskContext.get()
            number = ((context.partitionId() if context else 0) << 32) + self.made
            self.made += 1
            for row in _index(np.concatenate(self.docs), *map(np.concatenate, zip(*self.parts)), self.buckets):
                yield row | {"block": number}
        self.clear()


def _index(docs, doc, pos, anchor, hashed, buckets: int) -> Iterator[dict]:
    """The block's phrases from their first places, and what starts earlier in the block, dealt out by bucket."""
    rank = _ranked(docs["named"], docs["id"], docs["tag"])
    # Rows that repeat a document in the block send nothing: its first row has sent the phrases.
    single = np.zeros(len(docs), bool)
    single[np.unique(rank, return_index=True)[1]] = True
    doc, pos, anchor, hashed = (x[single[doc]] for x in (doc, pos, anchor, hashed))
    source = _sources([hashed, anchor], (rank[doc] << 32) | pos)
    again = (rank[doc[source]] != rank[doc]) | (pos[source] != pos)
    place = docs[doc]
    place["pos"] = pos
    own = np.flatnonzero(again)
    known = own[:0]
    if len(own):
        begin, count = _runs(_chained(doc[own], pos[own], doc[source[own]], pos[source[own]]))
        known = own[begin]
    first = np.flatnonzero(~again)
    change = np.ones(len(first), bool)
    change[1:] = (doc[first[1:]] != doc[first[:-1]]) | (pos[first[1:]] != pos[first[:-1]] + 1) | (anchor[first[1:]] != anchor[first[:-1]])
    begin, length = _runs(change)
    # A run longer than a byte holds is several.
    pieces = -(-length // RUN)
    step = RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    begin, length = np.repeat(begin, pieces) + step, np.minimum(np.repeat(length, pieces) - step, RUN)
    bucket = (mix(anchor[first[begin]]) % np.uint64(buckets)).astype(np.int64)
    other = (mix(place["tag"][known].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order, tail = np.argsort(bucket, kind="stable"), np.argsort(other, kind="stable")
    there = np.union1d(bucket, other)
    edges = [np.searchsorted(x, there, side).tolist() for x in (bucket[order], other[tail]) for side in ("left", "right")]
    for b, low, high, low_own, high_own in zip(there.tolist(), *edges):
        run, mine = order[low:high], tail[low_own:high_own]
        n = length[run]
        at = first[np.repeat(begin[run], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        start = place[first[begin[run]]]
        small = squeezed(start["id"].astype("<u8"), start["pos"], n | (start["named"] << 7))
        parts = [
            start["tag"], anchor[first[begin[run]]].astype("<u8"), hashed[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES],
            place[known[mine]], count[mine].astype("<i4") if len(mine) else _NONE, place[source[known[mine]]],
        ]
        head = np.array([len(run), len(at), len(mine), len(small)], "<i8").tobytes()
        yield {"bucket": b, "payload": head + small + b"".join(np.ascontiguousarray(x).tobytes() for x in parts)}


def _unpack(payload: bytes) -> list[np.ndarray]:
    """ids, tags, positions, packed lengths, anchors and hashes of runs, and places, counts and sources of what is known."""
    runs, windows, own, size = np.frombuffer(payload, "<i8", 4)
    out, at = [], 32 + int(size)
    for kind, n in (("<i8", runs), ("<u8", runs), (_HASH, windows), (_PLACE, own), ("<i4", own), (_PLACE, own)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    tags, anchor, hashed, place, count, source = out
    ids, pos, packed = expanded(payload[32 : 32 + int(size)], 3)
    return [ids, tags, pos, packed, anchor, hashed, place, count, source]


def _longest(place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of pieces that start at the same word of the same document (rows that repeat it) the longest."""
    order = np.lexsort((-count, place["pos"], place["tag"], place["id"], place["named"]))
    new = np.ones(len(order), bool)
    new[1:] = place[order[1:]] != place[order[:-1]]
    return order[new]


def _seek(payloads: list[bytes], blocks: list[int]) -> Iterator[pa.RecordBatch]:
    """Pieces of factors of all phrases of a bucket: runs of phrases with a source, the source going on alike."""
    found = [_unpack(p) for p in payloads]
    place, count, of = (np.concatenate([x[i] for x in found]) for i in (6, 7, 8))
    if len(place):
        one = _longest(place, count)
        yield _factors(place[one], count[one], of[one], np.repeat(np.array(blocks, np.int64), [len(x[6]) for x in found])[one])
    ids, tags, pos, packed, anchor, short = (np.concatenate([x[i] for x in found]) for i in range(6))
    if not len(ids):
        return
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :BYTES] = short
    hashed = wide.view("<u8")[:, 0]
    block = np.repeat(np.array(blocks, np.int64), [len(x[0]) for x in found])
    del found, short
    named, length = packed > 127, (packed & 127).astype(np.int64)
    run = np.repeat(np.arange(len(ids)), length)
    at = pos[run].astype(np.int64) + np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
    rank = _ranked(named, ids, tags)
    spot = (rank[run] << 32) | at
    source = _sources([hashed, anchor[run]], spot)
    hit = np.flatnonzero(spot[source] != spot)
    # Rows that repeat a document send its phrases from several blocks: each counts once.
    _, once = np.unique(spot[hit], return_index=True)
    hit = hit[once]
    if len(hit):
        begin, size = _runs(_chained(rank[run[hit]], at[hit], run[source[hit]], at[source[hit]]))
        one = hit[begin]
        place, of = np.empty(len(one), _PLACE), np.empty(len(one), _PLACE)
        for out, item in ((place, one), (of, source[one])):
            out["named"], out["id"], out["tag"], out["pos"] = named[run[item]], ids[run[item]], tags[run[item]], at[item]
        yield _factors(place, size, of, block[run[source[one]]])


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    told = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({
        "__named": F.col(id_column).isNotNull(),
        "__id": F.coalesce(F.col(id_column).cast("long"), F.xxhash64(F.lit("no id"), told)),
        "__tag": F.xxhash64(told),
    })


def pieces(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Runs of count phrases from word start of a document on, and where their source starts; see _FACTOR_SQL."""
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(TOGETHER * partitions(docs.sparkSession), -(-size // BUCKET))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("no cache", object)
        block, out = _Block(buckets, window), []

        def sent(rows):
            return pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())]))

        for b in batches:
            docs = np.zeros(b.num_rows, _PLACE)
            for k, name in enumerate(("named", "id", "tag")):
                docs[name] = b.column(k).to_numpy(zero_copy_only=False)
            for row in block.add(docs, b.column(3)):
                out.append(row)
                if len(out) >= 512:
                    yield sent(out)
                    out = []
        out += block.flush()
        for at in range(0, len(out), 512):
            yield sent(out[at : at + 512])
        trim()

    def seek(batch: pa.Table) -> pa.Table:
        got = list(_seek(batch.column("payload").to_pylist(), batch.column("block").to_pylist()))
        none = np.empty(0, _PLACE)
        trim()
        return pa.Table.from_batches(got or [_factors(none, _NONE, none, np.empty(0, np.int64))])

    taken = _keyed(docs, id_column, text).select("__named", "__id", "__tag", F.col(text).alias("text"))
    index = taken.mapInArrow(indexed, "bucket int, block long, payload binary").repartition(-(-buckets // TOGETHER), "bucket")
    return index.groupBy("bucket").applyInArrow(seek, _FACTOR_SQL)


def parse(found: list[dict], window: int) -> list[tuple[int, int, tuple, int]]:
    """The greedy parse: disjoint (start, length, source, source position) in words, from the pieces of a document.

    Pieces that go on from one another (they met in different partitions of the
    index) are one; a phrase that begins within a factor and ends beyond it
    gives the words beyond as a factor of their own.
    """
    out: list[tuple[int, int, tuple, int]] = []
    done = 0
    merged: list[list] = []
    for p in sorted(found, key=lambda p: (p["start"], -p["count"])):
        source = (p["block"], p["from_named"], p["from_id"], p["from_tag"])
        if merged and merged[-1][2][1:] == source[1:] and merged[-1][0] + merged[-1][1] == p["start"] and merged[-1][3] + merged[-1][1] == p["from_start"]:
            merged[-1][1] += p["count"]
        else:
            merged.append([p["start"], p["count"], source, p["from_start"]])
    for start, count, source, at in merged:
        end = start + count + window - 1
        if end > done:
            skip = max(0, done - start)
            out.append((start + skip, end - start - skip, source, at + skip))
            done = end
    return out


def clean(text: bytes | None, found: list[dict] | None, window: int) -> tuple[int, int, int, bytes]:
    """Words, removed words, factors, and the kept words joined by one space."""
    words = (text or b"").split()
    if not found:
        return len(words), 0, 0, b" ".join(words)
    keep = [True] * len(words)
    factors = parse(found, window)
    for start, length, *_ in factors:
        keep[start : start + length] = [False] * min(length, max(0, len(words) - start))
    return len(words), keep.count(False), len(factors), b" ".join(compress(words, keep))


_FOUND = ("start", "count", "from_named", "from_id", "from_tag", "from_start", "block")


def _with_pieces(docs: DataFrame, id_column: str, text: str, window: int) -> DataFrame:
    found = pieces(docs, id_column, text, window).groupBy("__named", "__id", "__tag").agg(F.collect_list(F.struct(*_FOUND)).alias("__found"))
    return _keyed(docs, id_column, text).join(found, ["__named", "__id", "__tag"], "left").select(*docs.columns, "__found")


def factors(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, source_block, source_id and source_start of every factor (in words)."""
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = _with_pieces(slim, "doc_id", "text", window).where("__found IS NOT NULL").select("doc_id", "__found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "source_block", "source_id", "source_start"]
        for b in batches:
            out = []
            for doc, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(doc, start, n, of[0], of[2] if of[1] else None, at) for start, n, of, at in parse(found, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 6, names)

    return rows.mapInArrow(run, "doc_id long, start long, length long, source_block long, source_id long, source_start long")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, n_factors and kept_text; a null text stays a document of no words."""
    rest = docs.drop("n_words", "n_removed", "n_factors", "kept_text")
    joined = _with_pieces(rest, id_column, text, window)
    names = rest.columns
    width, where = len(names), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            got = [clean(t, f, window) for t, f in zip(b.column(where).cast(pa.binary()).to_pylist(), b.column(width).to_pylist())]
            n, gone, count, kept = zip(*got) if got else ((), (), (), ())
            arrays = [*(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *arrays], [*names, "n_words", "n_removed", "n_factors", "kept_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return joined.mapInArrow(run, schema + ", n_words long, n_removed long, n_factors long, kept_text string")


def op2_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: Windows are compared by their words; ids are taken to be unique.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER twenty AS phrase, COUNT(*) OVER twenty AS n FROM words
  WINDOW twenty AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), repeats AS (
  SELECT doc_id, pos, ROW_NUMBER() OVER (PARTITION BY phrase ORDER BY doc_id, pos) > 1 AS again FROM windows WHERE n = 20
), marked AS (
  SELECT w.doc_id, w.pos, w.word, COALESCE(bool_or(r.again) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), FALSE) AS gone
  FROM words w LEFT JOIN repeats r ON w.doc_id = r.doc_id AND w.pos = r.pos
), counted AS (
  SELECT doc_id, COUNT(*) AS n, COUNT(*) FILTER (gone) AS n_gone, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(c.n, 0)::BIGINT AS n_words, COALESCE(c.n_gone, 0)::BIGINT AS n_removed, sha256(COALESCE(c.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
