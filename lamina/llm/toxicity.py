"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps each word to symbols: insult stems (a prefix trie),
threat verbs, intent, targets, objects, negators, reporting verbs, quotes and
clause ends, in English, German, French and Spanish; elided words (``t'``,
``i'll``, ``matarte``) give the symbols of their parts.  Five small machines
read the symbols of a clause: insult (emits a stem's weight), threat (intent,
then a violent verb, with a target after the verb or an object pronoun before
it), target (raises an insult in a clause that addresses someone), negation
(``not ... stupid`` within three words emits almost nothing) and reported
speech (``she said that ...`` emits a part).  They are composed into one
transducer, whose product states are made when first met and then kept; a
clause's weight is what the composed machine emits, never that of a word by
itself.

The insult stems are learned from labelled rows: whole words and word
beginnings of four to seven letters that toxic documents hold far more often
than others (log-likelihood ratio of document counts at least ``EVIDENCE``),
at most ``STEMS`` of them; of nested ones the strongest stays.  So they are
not tied to a language.  A short seed lexicon serves where nothing is
labelled.  A logistic function of a document's clause weights, fitted on the
same bounded sample (``SAMPLE`` labelled ids by hash; only ids whose crc32 as
text, modulo 3, is not 1), gives the score.  The sample's texts stay on the
executors: counts of stems and three numbers a document come to the driver.

Defined results: null and blank text is scored like any text without matches;
rows with a null id count as not held out and are never learned from; a
document labelled twice counts as toxic if one label says so; repeated rows
are rows of their own.  Memory is a worker's cache of words (``CACHED``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import checkpoint, held, held_out, table, training_row, trim
from lamina.llm.words import grams, inside, tables

SAMPLE = 8_000
STEMS = 160
EVIDENCE = 24.0
REJECT = 0.7
CACHED = 200_000
#: Entries that a task's counts of stems hold before they are sent.
COUNTED = 60_000
OTHER, END, TARGET, OBJECT, NEGATOR, REPORT, QUOTE, SELF, INTENT, THREAT, STEM = range(11)
SEED = "idiot moron stupid worthless scum loser pathetic disgusting imbecile".split()
SEED_WEIGHT = 6.0
CLASSES = {
    TARGET: "you your yours yourself u thou du dir ihr toi vous tú vosotros usted ustedes".split(),
    OBJECT: "dich euch te os".split(),
    NEGATOR: "not never no isn't aren't wasn't weren't don't doesn't hardly nicht nie kein keine keinen ne pas jamais nunca jamás".split(),
    REPORT: "said says say called calls wrote writes claimed claims quoted told reported sagte sagt schrieb behauptete meinte nannte rief "
            "dit disait écrit écrivait prétend affirme dijo dice decía escribió afirma llamó".split(),
    QUOTE: "that dass daß que".split(),
    SELF: "i we ich wir je nous yo nosotros".split(),
    INTENT: "will shall going gonna must would werde werden muss vais allons veux voy vamos quiero".split(),
    THREAT: "kill hurt destroy murder stab shoot beat strangle burn töten umbringen schlagen verletzen verprügeln erschießen erstechen verbrennen "
            "tuer frapper détruire étrangler brûler poignarder matar golpear destruir estrangular quemar apuñalar".split(),
}
WORDS = {w: bytes([k]) for k, ws in CLASSES.items() for w in ws}
WORDS |= {w: bytes([SELF, INTENT]) for w in ("i'll", "we'll")} | {w: bytes([SELF]) for w in ("i'm", "we're")}
WORDS |= {w + "te": bytes([THREAT, OBJECT]) for w in ("matar", "golpear", "destruir", "estrangular", "quemar", "apuñalar")}
#: Words that lose their vowel before another one.
ELIDED = {"t'": OBJECT, "j'": SELF, "n'": NEGATOR, "qu'": QUOTE}
THREAT_WEIGHT = 8.0
_WORD = re.compile(r"[\w'’]+")
_ENDS = (b".", b"!", b"?", b";", b":")


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


class Insult:
    """Emits the weight of a stem."""

    start = 0

    def step(self, state: int, symbol: int, weight: float) -> tuple[int, float]:
        return 0, weight


class Threat:
    """Intent, then a violent verb, and its target: after the verb, or an object pronoun before it, within a clause."""

    start = 0
    #: What of it has been read, as bits.
    intent, verb, object = 1, 2, 4

    def step(self, state: int, symbol: int, weight: float) -> tuple[int, float]:
        if symbol == INTENT:
            return state | self.intent, 0.0
        if symbol == THREAT and state & self.intent:
            return (0, THREAT_WEIGHT) if state & self.object else (state | self.verb, 0.0)
        if symbol in (TARGET, OBJECT) and state & self.verb:
            return 0, THREAT_WEIGHT
        return (state | self.object if symbol == OBJECT else state), 0.0


class Target:
    """Factor of a clause that addresses someone before the insult."""

    start = 0

    def step(self, state: int, symbol: int, weight: float) -> tuple[int, float]:
        state = 1 if symbol in (TARGET, OBJECT) else state
        return state, 1.25 if state else 1.0


class Negation:
    """Factor of the three symbols after a negator."""

    start = 0

    def step(self, state: int, symbol: int, weight: float) -> tuple[int, float]:
        if symbol == NEGATOR:
            return 3, 1.0
        return max(0, state - 1), 0.1 if state else 1.0


class Reported:
    """Factor after a reporting verb and its conjunction, to the clause's end."""

    start = 0

    def step(self, state: int, symbol: int, weight: float) -> tuple[int, float]:
        if symbol == REPORT and state == 0:
            return 1, 1.0
        if symbol == QUOTE and state == 1:
            return 2, 1.0
        return state, 0.4 if state == 2 else 1.0


class Grammar:
    """The composition of the machines over an alphabet of word classes and stems."""

    def __init__(self, stems: dict[str, float], whole: dict[str, float]) -> None:
        self.stems, self.whole = stems, whole
        names = [*stems, *(w for w in whole if w not in stems)]
        self.code = {w: STEM + i for i, w in enumerate(names)}
        self.weight = [0.0] * STEM + [{**whole, **stems}[w] for w in names]
        self.emits = (Insult(), Threat())
        self.factors = (Target(), Negation(), Reported())
        self.start = tuple(m.start for m in (*self.emits, *self.factors))
        self.product: dict[tuple, tuple[tuple, float]] = {}
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        self.matched = re.compile(b"[" + bytes([THREAT]) + b"-\xff]")
        self.cache: dict[bytes, bytes] = {}

    def symbol(self, token: str) -> bytes:
        """The lexicon transducer: a word's class or classes, its longest stem, or other."""
        if token in WORDS:
            return WORDS[token]
        if token in self.whole:
            return bytes([self.code[token]])
        for n in self.sizes:
            if token[:n] in self.stems and len(token) >= n:
                return bytes([self.code[token[:n]]])
        cut = token.find("'") + 1
        if 0 < cut < len(token) and token[:cut] in ELIDED:
            return bytes([ELIDED[token[:cut]]]) + self.symbol(token[cut:])
        return bytes([OTHER])

    def symbols(self, word: bytes) -> bytes:
        """Symbols of a blank-delimited word, kept for its next occurrence."""
        out = b"".join(self.symbol(t) for t in _tokens(word.decode("utf8", "replace"))) or bytes([OTHER])
        if word.rstrip(b"\"')").endswith(_ENDS):
            out += bytes([END])
        if len(word) <= 64:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[word] = out
        return out

    def step(self, state: tuple, symbol: int) -> tuple[tuple, float]:
        """One arc of the composed machine."""
        key = (state, symbol)
        if key not in self.product:
            weight = self.weight[symbol] if symbol >= STEM else 0.0
            k = len(self.emits)
            given = [m.step(s, symbol, weight) for m, s in zip(self.emits, state)]
            scaled = [m.step(s, symbol, weight) for m, s in zip(self.factors, state[k:])]
            out = sum(w for _, w in given)
            for _, f in scaled:
                out *= f
            self.product[key] = (tuple(s for s, _ in (*given, *scaled)), out)
        return self.product[key]

    def clause(self, symbols: Iterable[int]) -> float:
        state, total = self.start, 0.0
        for s in symbols:
            state, out = self.step(state, s)
            total += out
        return total

    def measure(self, text: bytes | None) -> tuple[float, int, int]:
        """(summed clause weights, clauses with weight, words) of a whole text."""
        words = (text or b"").split()
        total, n = 0.0, 0
        get = self.cache.get
        coded = [get(w) or self.symbols(w) for w in words]
        line = b"".join(coded)
        if self.matched.search(line):
            for part in line.split(bytes([END])):
                if self.matched.search(part) and (w := self.clause(part)) > 0:
                    total += w
                    n += 1
        return total, n, len(words)


def _grammar(stems: dict[str, float], whole: dict[str, float]) -> Grammar:
    """This worker's machine, with the words that it has met."""
    return held(("grammar", repr((stems, whole))), lambda: Grammar(stems, whole))


def _explain(measures: list[tuple[float, int, int]]) -> np.ndarray:
    """What the logistic function sees of a document."""
    m = np.array(measures, float).reshape(-1, 3)
    return np.stack([np.log1p(m[:, 0]), np.minimum(m[:, 0], 12) / 4, m[:, 0] / np.sqrt(m[:, 2] + 25), np.log1p(m[:, 2]) / 8, np.ones(len(m))], 1)


def _llr(a: int, b: int, n: int, m: int) -> float:
    """Twice the log-likelihood ratio of a in n against b in m."""

    def part(k: int, t: int, p: float) -> float:
        return (k * math.log(p) if k else 0) + ((t - k) * math.log(1 - p) if t > k else 0)

    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p)) if 0 < p < 1 else 0.0


def stem_counts(rows: DataFrame) -> DataFrame:
    """feature, and by label the documents with it and its uses, over rows of (text, toxic); the feature '' has the totals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("no cache", object)
        seen: dict[tuple[str, bool], list[int]] = {}

        def sent() -> pa.RecordBatch:
            parts = ([f for f, _ in seen], [b for _, b in seen], [n for n, _ in seen.values()], [n for _, n in seen.values()])
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(parts, kinds)], ["feature", "bad", "docs", "uses"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = Counter(w for w in _tokens(text or "") if w not in WORDS)
                found: Counter = Counter({"": sum(words.values())})
                for w, k in words.items():
                    found[w + "$"] += k
                    for size in range(4, min(8, len(w) + 1)):
                        found[w[:size]] += k
                for f, k in found.items():
                    pair = seen.setdefault((f, toxic == 1), [0, 0])
                    pair[0] += 1
                    pair[1] += k
                if len(seen) > COUNTED:
                    yield sent()
                    seen.clear()
        yield sent()
        seen.clear()
        trim()

    each = rows.select("text", "toxic").mapInArrow(count, "feature string, bad boolean, docs long, uses long")
    part = lambda c, bad: F.coalesce(F.sum(F.when(F.col("bad") == bad, F.col(c))), F.lit(0)).alias(f"{c}_{'foul' if bad else 'clean'}")
    return each.groupBy("feature").agg(*[part(c, bad) for c in ("docs", "uses") for bad in (True, False)])


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float], bool]:
    """Weights of stems and of whole words, learned from rows of (text, toxic); whether both labels occur."""
    found = {r["feature"]: r for r in stem_counts(rows).where("docs_foul >= 3 OR feature = ''").collect()}
    total = found.pop("", None)
    n, m = (total["docs_foul"], total["docs_clean"]) if total else (0, 0)
    if not n or not m:
        return {}, dict.fromkeys(SEED, SEED_WEIGHT), False
    ranked = []
    for f, r in found.items():
        a, b = r["docs_foul"], r["docs_clean"]
        if a / n > 4 * b / m and (g := _llr(a, b, n, m)) >= EVIDENCE:
            clean, foul = (r["uses_clean"] + 0.5) / max(1, total["uses_clean"]), (r["uses_foul"] + 0.5) / max(1, total["uses_foul"])
            if foul > 2 * clean:
                ranked.append((-g, f, math.log(foul / clean)))
    stems, whole, taken = {}, {}, []
    for _, f, w in sorted(ranked):
        bare = f.rstrip("$")
        if any(bare.startswith(x) or x.startswith(bare) for x in taken):
            continue
        taken.append(bare)
        (whole if f.endswith("$") else stems)[bare] = min(w, 8.0)
        if len(taken) >= STEMS:
            break
    for w in SEED:
        if not any(w.startswith(x) for x in taken):
            whole.setdefault(w, SEED_WEIGHT / 2)
    return stems, whole, True


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Rows (text, toxic, h) of about bound labelled ids to learn from, those with the smallest hashes; written, as they are read twice."""
    known = labels.where(training_row() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    return checkpoint(without_copies(rows.select("text", "toxic", F.xxhash64("doc_id", "text").alias("h"))))


def without_copies(rows: DataFrame) -> DataFrame:
    """Of the rows (text, toxic, h) with one label that share their least hash of three words, the one of the least h.

    Copies are no evidence of their own: the rare words of a toxic text that was
    copied often would pass for stems.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(2).to_numpy().copy()
            for at, _, words in tables(pc.ascii_lower(b.column(0))):
                three = grams(words.hashes(), 3)[inside(words.first, 3, len(words.start))] if len(words.start) >= 3 else np.empty(0, np.uint64)
                n = np.maximum(words.counts - 2, 0)
                some = np.flatnonzero(n)
                if len(some):
                    key[at + some] = np.minimum.reduceat(three, (np.cumsum(n) - n)[some]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], ["text", "toxic", "h", "key"])

    kind = rows.schema["toxic"].dataType.simpleString()
    keyed = rows.mapInArrow(marked, f"text string, toxic {kind}, h long, key long")
    return keyed.groupBy("toxic", "key").agg(F.min(F.struct("h", "text")).alias("r")).select("r.text", "toxic", "r.h")


def train(rows: DataFrame, bound: int) -> tuple[dict[str, float], dict[str, float], np.ndarray]:
    """Stems, whole words and logistic weights from rows of (text, toxic, h); the weights from the measures of at most 2 x bound rows."""
    stems, whole, both = learn_lexicon(rows)
    if not both:
        return stems, whole, np.array([0.0, 2.5, 0.0, 0.0, -2.2])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _grammar(stems, whole)
        for b in batches:
            total, n, words = zip(*map(g.measure, b.column(0).cast(pa.binary()).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64()), pa.array(n, pa.int64()), pa.array(words, pa.int64()), b.column(1).cast(pa.int32()), b.column(2)], ["total", "n", "words", "toxic", "h"])

    found = rows.mapInArrow(measure, "total double, n long, words long, toxic int, h long").orderBy("h", "total", "words").limit(2 * bound).collect()
    bad = np.array([r["toxic"] == 1 for r in found])
    return stems, whole, fit(_explain([(r["total"], r["n"], r["words"]) for r in found]), bad.astype(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs, with held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, SAMPLE), SAMPLE))
    rest = docs.drop("held_out", "score", "predicted")
    names = rest.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, whole, w = model.value
        g = _grammar(stems, whole)
        for b in batches:
            x = _explain([g.measure(t) for t in b.column(where).cast(pa.binary()).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*names, "held_out", "score"])

    taken = rest.withColumn("held_out", held_out())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields)
    return taken.mapInArrow(run, schema + ", score double").withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
