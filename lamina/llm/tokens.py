"""Exact token counts of whole texts without a shuffle of pre-tokens.

Two tiers answer for a pre-token.  The first is a compact table, broadcast
once, of the lengths of the corpus's most frequent pre-tokens (at most
``FREQUENT`` of them, whatever the corpus's size).  What it lacks goes to the
library once per worker and then sits in the worker's cache of bounded size
(two generations of ``CACHED`` entries).  Both tiers only
save work: the library's own answer decides every count.

What goes into the first tier is counted on all rows: each task writes a
Misra-Gries summary of its pre-tokens, and the driver merges one after another.
Whenever a summary is cut to k entries, the count of the next one is taken from
each, so the tier holds every pre-token that makes up more than one in
``FREQUENT`` + 1 of the corpus, whatever its size, and exact counts decide where no
more than ``FREQUENT`` are distinct.  No pre-token is shuffled.  Pre-tokens of
``LONG`` bytes or more are left to the library.

Cutting.  Byte-level BPE never merges across the library's pre-token pattern,
and that pattern starts a new pre-token at a single space that a solid
character follows, and around a line end between solid characters.  Texts
with runs of blanks are cut by a stricter rule; texts with other Unicode
blanks, separators or special strings go to the library whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
and null ids stay as rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import checkpoint, held, table

FREQUENT = 1 << 14
LONG = 256
#: Entries that a summary holds, and bytes of text that it takes in, before it is lessened.
COUNTED = 1 << 17
COUNTED_BYTES = 1 << 25
#: Entries of a generation of a worker's cache; there are two.
CACHED = 250_000
LIMIT = 1024
_BLANK_RUN = [a + b for a in (b" ", b"\n") for b in (b" ", b"\n")] + [b"\t", b"\r", b"\x0b", b"\x0c"]
_ODD = [bytes([c]) for c in range(0x1C, 0x20)] + [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"<|"]
_CUT = re.compile(rb"(?<=[^ \t\n\r\x0b\x0c])(?= [^ \t\n\r\x0b\x0c])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: bytes) -> list[bytes] | None:
    """Parts whose token counts add up to the text's; None if only the library can tell."""
    if any(x in text for x in _ODD):
        return None
    if any(x in text for x in _BLANK_RUN):
        return _CUT.split(text)
    lines = text.split(b"\n")
    first, *rest = lines[0].split(b" ")
    out = [first, *map(b" ".__add__, rest)]
    for line in lines[1:]:
        first, *rest = line.split(b" ")
        out += [b"\n", first, *map(b" ".__add__, rest)]
    return out


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The library's merges for pieces of plain Latin letters and trailing marks.

    Those are one pre-token of letters (with the blank before it, where blanks
    are kept) and one of marks, and normalisation changes nothing but case, so
    the library's model can be asked without its splitting.  Other pieces give
    None.
    """

    _plain = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
    _table = byte_letters()

    def __init__(self, library, fold: bool) -> None:
        self.model, self.fold = library.model, fold

    def ids(self, piece: bytes) -> list[int] | None:
        m = self._plain.fullmatch(piece.decode())
        if not m or "<|" in m[2]:
            return None
        core = (m[1].lower() if self.fold else m[1]).encode().decode("latin-1").translate(self._table)
        found = [t.id for t in self.model.tokenize(core)]
        return found + [t.id for t in self.model.tokenize(m[2])] if m[2] else found


class Kept(dict):
    """A cache of two generations: when the young one is full it becomes the old one."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.old = limit, {}

    def make(self, key: bytes):
        raise NotImplementedError

    def __missing__(self, key: bytes):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Lengths(Kept):
    """Token counts by piece: the frequent ones, and others as they are met."""

    def __init__(self, path: str, frequent: dict[bytes, int], cached: int = CACHED) -> None:
        super().__init__(cached)
        self.frequent, self.library = frequent, load(path)
        self.merges = Merges(self.library, fold=False)

    def whole(self, text: bytes) -> int:
        return len(self.library.encode(text.decode(), add_special_tokens=False).ids)

    def make(self, piece: bytes) -> int:
        n = self.frequent.get(piece)
        if n is None:
            ids = self.merges.ids(piece)
            n = self.whole(piece) if ids is None else len(ids)
        return n

    def count(self, text: bytes) -> int:
        parts = pieces(text)
        return self.whole(text) if parts is None else sum(map(self.__getitem__, parts))


def _lengths(path: str, packed: tuple[bytes, bytes, bytes]) -> Lengths:
    """This worker's table; built once for a path and a first tier."""

    def make() -> Lengths:
        blob, ends, counts = packed
        stops = np.frombuffer(ends, np.uint32).tolist()
        frequent = {blob[a:b]: n for a, b, n in zip([0, *stops], stops, np.frombuffer(counts, np.uint16).tolist())}
        return Lengths(path, frequent)

    return held(("lengths", path, hash(packed)), make)


def lessened(seen: Counter, keep: int) -> Counter:
    """At most keep entries, each less by the count of the most frequent one that goes.

    That count is taken from more than keep entries.  So however often summaries
    are added up and lessened, what an entry lost is at most one in keep + 1 of all
    that was counted.
    """
    if len(seen) <= keep:
        return seen
    *first, (_, least) = seen.most_common(keep + 1)
    return Counter({k: n - least for k, n in first if n > least})


def frequent_pieces(docs: DataFrame, text: str = "text", top: int = FREQUENT) -> list[bytes]:
    """The most frequent pieces of all rows, at most top; each that makes up more than one in top + 1 is among them."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        size = 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(pieces(t or b"") or ())
                size += len(t or b"")
                if len(seen) > COUNTED or size > COUNTED_BYTES:
                    seen, size = lessened(short(seen), max(top, COUNTED // 2)), 0
        seen = lessened(short(seen), top)
        yield pa.RecordBatch.from_arrays([pa.array([[*seen]], pa.list_(pa.binary())), pa.array([[*seen.values()]], pa.list_(pa.int64()))], ["pieces", "counts"])

    def short(seen: Counter) -> Counter:
        return Counter({k: n for k, n in seen.items() if len(k) < LONG})

    total: Counter = Counter()
    for r in checkpoint(docs.select(text).mapInArrow(summary, "pieces array<binary>, counts array<long>")).toLocalIterator(True):
        total.update(dict(zip(map(bytes, r[0]), r[1])))
        if len(total) > COUNTED:
            total = lessened(total, max(top, COUNTED // 2))
    return [k for k, _ in sorted(lessened(total, top).items(), key=lambda x: (-x[1], x[0]))]


def pack(path: str, found: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """The first tier as three buffers: the pieces, where each ends, their token counts."""
    library = load(path)
    counts = [min(len(e.ids), 65535) for e in library.encode_batch([p.decode() for p in found], add_special_tokens=False)]
    return b"".join(found), np.cumsum([len(p) for p in found]).astype(np.uint32).tobytes(), np.array(counts, np.uint16).tobytes()


def token_counts(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, n_bytes and n_tokens of every row."""
    first = docs.sparkSession.sparkContext.broadcast(pack(path, frequent_pieces(docs, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path, first.value)
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            counts = [pa.array(list(map(f, texts)), pa.int64()) for f in (len, lengths.count)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
