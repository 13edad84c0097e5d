"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs (Cho and others, 2014) read a text's bytes in both directions and a
softmax labels every byte position; a document's probabilities are its
positions' log-probabilities averaged over the whole text.  All bytes are
read, ASCII case folded, and states run on over blanks and line ends.

Chunks.  So that a text of any length needs bounded memory and chunks of many
texts fill a batch, a text is cut into cores of ``CORE`` bytes.  The forward
state of a core starts ``CONTEXT`` bytes before it and the backward state as
many after it (or where the text does); a text of one core is read exactly.

The network is trained in numpy by backpropagation through time on windows of
``SEGMENT`` bytes.  They are drawn on the executors, ``DRAWS`` from anywhere in
each text of a bounded sample: of each language the ``SAMPLE`` rows with the
smallest hashes, so no text is sent to the driver whole.  A row is used only if
crc32 of its id as text, modulo 3, is not 1.  Inputs are bytes of text alone.
Weights (a few KB) are broadcast.

Defined results: null text and text without letters is ``und`` with score 0;
with no learnable row all is ``und``; rows with a null id are never learned
from and count as not held out; a corpus of one language predicts it
everywhere; repeated rows are rows of their own; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm.common import held, held_out, table, training_row
from lamina.llm.words import steps, text_buffers

#: Rows of a language to learn from.
SAMPLE = 600
#: Training windows of a row, and the bytes of each.
DRAWS = 16
SEGMENT = 64
HIDDEN = 12
STEPS = 260
BATCH = 256
RATE = 0.02
CORE = 192
CONTEXT = 32
#: Chunks that are read at once.
CHUNKS = 1024
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of segments as rows, and the rows' lengths."""
    n = np.fromiter(map(len, segments), np.int64, len(segments))
    out = np.zeros((len(segments), int(n.max())), np.uint8)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(b"".join(segments), np.uint8)
    return out, n


def _turned(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each row's first n entries in the opposite order."""
    at = n[:, None] - 1 - np.arange(x.shape[1])
    return np.take_along_axis(x, np.where(at < 0, np.arange(x.shape[1]), at) if x.ndim == 2 else np.where(at < 0, np.arange(x.shape[1]), at)[:, :, None], 1)


class Network:
    """Two GRUs over bytes and a softmax at every position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h, c = hidden, len(labels)
        self.labels, self.hidden = labels, h
        self.p = {"out": rng.normal(0, 0.3, (2 * h, c)), "bias": np.zeros(c)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * h))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each byte of x (batch, time, hidden); gates are reset, update, candidate."""
        h, wx, wh = self.hidden, self.p["x" + d], self.p["h" + d]
        state = np.zeros((len(x), h), np.float32)
        out = np.empty((x.shape[1], len(x), h), np.float32)
        for t in range(x.shape[1]):
            a, b = wx[x[:, t]], state @ wh
            g = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            n = np.tanh(a[:, 2 * h :] + g[:, :h] * b[:, 2 * h :])
            if keep is not None:
                keep.append((state, g, n, b[:, 2 * h :]))
            state = n + g[:, h:] * (state - n)
            out[t] = state
        return out.swapaxes(0, 1)

    def _backward(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, into: dict) -> None:
        """Backpropagation through time; grad is of the states that _forward returned."""
        h, wh = self.hidden, self.p["h" + d]
        carry = np.zeros((len(x), h), np.float32)
        gx, gh = np.zeros_like(self.p["x" + d]), np.zeros_like(wh)
        for t in range(x.shape[1] - 1, -1, -1):
            state, g, n, bn = kept[t]
            r, z = g[:, :h], g[:, h:]
            ds = grad[:, t] + carry
            dn = ds * (1 - z) * (1 - n * n)
            dz = ds * (state - n) * z * (1 - z)
            dr = dn * bn * r * (1 - r)
            da = np.concatenate([dr, dz, dn], 1)
            db = np.concatenate([dr, dz, dn * r], 1)
            np.add.at(gx, x[:, t], da)
            gh += state.T @ db
            carry = ds * z + db @ wh.T
        into["x" + d], into["h" + d] = gx, gh

    def logits(self, x: np.ndarray, n: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        f = self._forward(x, "f", keep and keep[0])
        b = _turned(self._forward(_turned(x, n), "b", keep and keep[1]), n)
        both = np.concatenate([f, b], 2)
        y = both @ self.p["out"] + self.p["bias"]
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True)), both

    def train(self, segments: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(segments), min(BATCH, len(segments)))
            x, n = _padded([segments[i] for i in pick])
            keep: tuple = ([], [])
            logp, both = self.logits(x, n, keep)
            there = (np.arange(x.shape[1]) < n[:, None])[:, :, None] / np.float32(n.sum())
            dy = np.exp(logp)
            dy[np.arange(len(x)), :, labels[pick]] -= 1
            dy *= there
            grads = {"out": np.einsum("bth,btc->hc", both, dy), "bias": dy.sum((0, 1))}
            dh = dy @ self.p["out"].T
            h = self.hidden
            self._backward(x, "f", keep[0], dh[:, :, :h], grads)
            self._backward(_turned(x, n), "b", keep[1], _turned(dh[:, :, h:], n), grads)
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


class Reader:
    """The network for inference: arrays are (units, chunks), so that every step works on long rows."""

    def __init__(self, network: Network) -> None:
        h, p = network.hidden, network.p
        self.h, self.bias = h, p["bias"][:, None]
        # A sigmoid is (1 + tanh(x / 2)) / 2: the halves of the gates are in the weights.
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)
        self.x = {d: np.ascontiguousarray((p["x" + d] * half).T) for d in "fb"}
        self.w = {d: np.ascontiguousarray((p["h" + d] * half).T) for d in "fb"}
        self.out = {"f": np.ascontiguousarray(p["out"][:h].T), "b": np.ascontiguousarray(p["out"][h:].T)}

    def states(self, x: np.ndarray, start: np.ndarray, d: str) -> np.ndarray:
        """(steps, units, chunks); a chunk's state is zero before its step start."""
        h, n = self.h, x.shape[1]
        s, out = np.zeros((h, n), np.float32), np.empty((len(x), h, n), np.float32)
        a, b = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        g, c = np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32)
        fresh = {int(t): np.flatnonzero(start == t) for t in np.unique(start[start > 0])}
        for t in range(len(x)):
            if t in fresh:
                s[:, fresh[t]] = 0
            np.take(self.x[d], x[t], axis=1, out=a, mode="clip")
            np.matmul(self.w[d], s, out=b)
            np.add(a[: 2 * h], b[: 2 * h], out=g)
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            np.multiply(g[:h], b[2 * h :], out=c)
            c += a[2 * h :]
            np.tanh(c, out=c)
            s -= c
            s *= g[h:]
            s += c
            out[t] = s
        return out

    def chunk_sums(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Sums over the cores data[at:to] of each label's log-probability; low and high are the ends of their texts."""
        width = int((to - at).max())
        i = np.arange(CONTEXT + width)[:, None]
        # Core position k is step CONTEXT + k forwards, and CONTEXT + width - 1 - k backwards.
        f, b = at - CONTEXT + i, at + width - 1 + CONTEXT - i
        first = np.maximum(low - at + CONTEXT, 0)
        last = at + width + CONTEXT - np.minimum(high, to + CONTEXT)
        read = lambda k: data[np.clip(k, 0, len(data) - 1)].astype(np.intp)
        fs = self.states(read(f), first, "f")[CONTEXT:]
        bs = self.states(read(b), last, "b")[CONTEXT:][::-1]
        y = np.matmul(self.out["f"], fs) + np.matmul(self.out["b"], bs) + self.bias
        y -= y.max(1, keepdims=True)
        y -= np.log(np.exp(y).sum(1, keepdims=True))
        y *= (np.arange(width)[:, None] < to - at)[:, None, :]
        return y.sum(0, dtype=np.float64).T

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Mean log-probability of each label over each text's positions; 0 for an empty text."""
        data, offsets = text_buffers(column)
        out = np.zeros((len(offsets) - 1, len(self.bias)))
        for x, y in steps(offsets):
            low, high = offsets[x:y], offsets[x + 1 : y + 1]
            count = -(-(high - low) // CORE)
            doc = np.repeat(np.arange(y - x), count)
            at = low[doc] + CORE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
            to = np.minimum(at + CORE, high[doc])
            part, base = _FOLD[data[offsets[x] : offsets[y]]], offsets[x]
            order = np.argsort(to - at, kind="stable")
            for k in range(0, len(order), CHUNKS):
                c = order[k : k + CHUNKS]
                sums = self.chunk_sums(part, low[doc[c]] - base, high[doc[c]] - base, at[c] - base, to[c] - base)
                np.add.at(out, x + doc[c], sums)
        return out / np.maximum(np.diff(offsets), 1)[:, None]


def _reader(packed: tuple) -> Reader:
    labels, hidden, arrays = packed

    def make() -> Reader:
        net = Network(list(labels), hidden)
        net.p = arrays
        return Reader(net)

    return held(("reader", hash(b"".join(x.tobytes() for x in arrays.values()))), make)


def windows(text: bytes, draws: int = DRAWS, size: int = SEGMENT) -> list[bytes]:
    """Windows from anywhere in a text, the same ones each time; all of a short text."""
    if len(text) <= size:
        return [text] if text else []
    starts = np.random.default_rng(len(text)).integers(0, len(text) - size + 1, draws)
    return [text[i : i + size] for i in starts.tolist()]


def sample(docs: DataFrame, bound: int = SAMPLE) -> pa.Table:
    """lang and windows of the rows to learn from: of each language those with the smallest hashes of id and text, at most bound."""
    rows = docs.where(training_row() & F.col("lang").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return pa.table({"lang": pa.array([], pa.string()), "windows": pa.array([], pa.list_(pa.binary()))})
    # Four times the bound by the hash, so that hardly a language falls short by chance; the rest is cut by rank.
    limits = [(r["lang"], min(1 << 30, (1 << 32) * bound // r["count"] + (1 << 16))) for r in counts]
    limit = F.broadcast(docs.sparkSession.createDataFrame(limits, "__lang string, __limit long"))
    near = rows.join(limit, F.col("lang") == F.col("__lang")).where("h < __limit").select("lang", "h", "text")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [windows(_FOLD[np.frombuffer(t, np.uint8)].tobytes() if t else b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], ["lang", "h", "windows"])

    drawn = near.mapInArrow(draw, "lang string, h long, windows array<binary>")
    ranked = drawn.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "windows"))).where(F.col("n") <= bound)
    return ranked.select("lang", "h", "windows").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")]).select(["lang", "windows"])


def train(found: list[list[bytes]], langs: list[str]) -> Network | None:
    """A network for the languages of langs from the windows of each row; None if there are none."""
    labels = sorted(set(langs))
    if not labels:
        return None
    net = Network(labels)
    each = [w for ws in found for w in ws]
    of = np.array([labels.index(lang) for ws, lang in zip(found, langs) for _ in ws], np.int64)
    if each and len(labels) > 1:
        net.train(each, of)
    return net


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = sample(docs)
    net = train(rows.column("windows").to_pylist(), rows.column("lang").to_pylist())
    sent = docs.sparkSession.sparkContext.broadcast(net and (tuple(net.labels), net.hidden, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            if sent.value and lettered:
                mean = _reader(sent.value).pooled(b.column(2).take(pa.array(lettered)))
                share = np.exp(mean - mean.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                for i, k, p in zip(lettered, share.argmax(1).tolist(), share.max(1).tolist()):
                    said[i], score[i] = sent.value[0][k], p
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
