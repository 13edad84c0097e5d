"""The pipeline on a small folder, and the queries' SQL."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import mixing, simhash, tokens, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in c.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    packed = c.STAGES[-1][1](spark, docs, SF)
    assert packed.count() >= counts[4]
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_by_brute_force(spark):
    """Each stage's rows on its own input against plain Python."""
    import corpus_pipeline as c

    r = np.random.default_rng(31)
    vocabulary = [f"word{i}" for i in range(400)] + ["über", "été"]
    prose = lambda n: " ".join(r.choice(vocabulary, n))
    passage = prose(60)
    texts = [prose(int(n)) for n in r.integers(30, 200, 40)] + [f"{prose(40)} {passage} {prose(30)}" for _ in range(6)]
    texts += [texts[3], texts[3] + " tail", texts[7].upper()]
    rows = [(int(i), t, "en", f"src{k % 3}", len(t)) for k, (i, t) in enumerate(zip(r.permutation(200), texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)

    scored = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {x.doc_id for x in c.drop_toxic(spark, docs, SF).collect()}
    assert kept == {x.doc_id for x in scored.collect() if x.predicted == 0}

    prints = {i: simhash.fingerprint(t.encode()) for i, t, *_ in rows}
    root = {i: i for i in prints}
    for _ in range(5):
        for a in root:
            root[a] = min(root[b] for b in root if (prints[a] ^ prints[b]).bit_count() <= 3)
    apart = c.drop_near_duplicates(spark, docs, SF).cache()
    left = {x.doc_id: x.text for x in apart.collect()}
    assert set(left) == {i for i in root if root[i] == i} and len(left) < len(rows)

    seen, want = set(), {}
    for i in sorted(left):
        w = left[i].split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            gone[k : k + 20] = [True] * 20 if tuple(w[k : k + 20]) in seen else gone[k : k + 20]
            seen.add(tuple(w[k : k + 20]))
        if not all(gone):
            want[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else left[i]
    cleaned = c.drop_repeated_passages(spark, apart, SF).cache()
    assert {x.doc_id: x.text for x in cleaned.collect()} == want and all(x.n_chars == len(x.text) for x in cleaned.collect())

    taken = {x.doc_id: x for x in mixing.taken_words(cleaned).collect()}
    mixed = c.mix_sources(spark, cleaned, SF).cache()
    places = sorted((p, n, i) for i, x in taken.items() for n, p in enumerate(x.positions))
    assert [x.doc_id for x in mixed.collect()] == [i for _, _, i in places]
    for source in {x.source for x in taken.values()}:
        mine = [x for x in taken.values() if x.source == source]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= max(x.size for x in mine)

    library = tokens.load(tokens.tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}
    packed = c.pack_sequences(spark, mixed, SF).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((x.doc_id, x.start, x.length, x.ids_crc32) for x in packed) == sorted((i, 0, len(ids[i]), crc(ids[i])) for _, _, i in places)
    sequences = {}
    for x in packed:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-sum(x.length for x in packed) // 2048) + 1


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with the names of the operators' own."""
    prose = lambda k, n: " ".join(f"w{(i * k * k + i // 7) % 97}" for i in range(n))
    rows = [(i, prose(i + 2, 30 + i), ["en", None][i % 2], ["a", "b", None][i % 3], 5) for i in range(30)]
    rows += [(40, None, None, None, None), (41, "", "en", "a", 0), (42, " \n ", "en", "a", 3), (43, prose(91, 30_000), "en", "b", 1)]
    rows += [rows[4], rows[4], (None, prose(71, 40), "en", "a", 1), (None, prose(71, 40), "en", "a", 2), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("score", "predicted", "held_out", "n_words", "n_removed", "kept_text", "fp", "tag", "copy", "positions", "size", "key")
    return frame.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in extra}).cache()


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as c

    docs, texts = odd, {}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        for r in out.collect():
            # Extra columns still belong to their row.
            assert r.score == f"score {'-' if r.doc_id is None else r.doc_id}" and r.kept_text == f"kept_text {'-' if r.doc_id is None else r.doc_id}", name
        texts[name] = {(r.doc_id, r.text) for r in out.collect()}
        if name == "simhash":
            assert out.where("doc_id = 4").count() == 1 and out.where("doc_id IS NULL AND text IS NOT NULL").count() == 1
            assert out.where("text IS NULL OR trim(text) IN ('', '\n')").count() == 1
        docs = out
    assert (43, odd.where("doc_id = 43").first().text) in texts["simhash"]
    packed = c.STAGES[-1][1](spark, docs, SF).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) > 20 and max(r.offset + r.length for r in packed) <= 2048


def test_stages_on_an_empty_table(spark, odd):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_run_keeps_the_last_folder_only(spark):
    import corpus_pipeline as c

    got = c.run(spark, SF)
    assert got.count() > 0
    folder = os.path.dirname(os.path.dirname(got.inputFiles()[0].removeprefix("file:")))
    assert os.listdir(folder) == ["4-packing"]


@pytest.mark.parametrize("name", ["op4_licenses", "op8_mixing"])
def test_sql(spark, name):
    from lamina.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    key = list(want.columns)
    got, want = (d[key].sort_values(key, ignore_index=True) for d in (got, want))
    assert got.equals(want.astype(got.dtypes.to_dict()))
