"""A training corpus from documents, in five stages.

Each stage reads what the one before it wrote; all but the last return the
columns of documents.  Toxicity drops the documents it rejects; near-dedup
leaves one document of each group; substring dedup removes repeated spans and
documents that nothing is left of; mixing repeats or leaves out whole
documents by source and sorts them by training position; packing lays their
tokens into sequences.

Defined results: an empty table gives empty stages; extra columns of documents
stay what they were, also where they have the name of an operator's column.
Each stage says what becomes of nulls, empty texts and repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import mixing, packing, simhash, substring, toxicity
from lamina.llm.common import remove_folder, shared_folder, table
from lamina.llm.tokens import tokenizer_path


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and the way back."""
    back = {f"__own_{n}": n for n in names if n in docs.columns}
    return docs.withColumnsRenamed({n: o for o, n in back.items()}), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; a null or empty text is scored as one without matches, repeated rows alike."""
    rows, back = _aside(docs, "held_out", "score", "predicted")
    scored = toxicity.score(rows, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").drop("held_out", "score", "predicted").withColumnsRenamed(back).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: of the least id, one of those that repeat it, and without ids of the least text hash.

    Null and blank texts are near duplicates of each other.
    """
    return simhash.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated spans; documents that nothing is left of go.

    A text without repeats stays as it is, also null and blank ones; another one
    has its kept words joined by blanks, and n_chars follows.
    """
    rows, back = _aside(docs, "n_words", "n_removed", "n_factors", "kept_text")
    found = substring.remove_repeats(rows)
    changed = F.col("n_removed") > 0
    kept = found.where(~changed | (F.col("n_removed") < F.col("n_words")))
    length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    new = {"n_chars": F.when(changed, length).otherwise(F.col("n_chars")), "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    return kept.withColumns(new).drop("n_words", "n_removed", "n_factors", "kept_text").withColumnsRenamed(back).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them, by training position; rows without words go, a null source is one of its own."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences; each row is packed by itself."""
    return packing.pack(packing.cut_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The stages hash with XXH64, learn weights and run a genetic algorithm: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet to the shared folder and read again; what a stage has read is deleted."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove_folder(spark, before)
        before = out
    return docs
