"""A corpus pipeline of five stages: from documents to sampled pieces.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. ``run`` writes each stage's result to the
folder that driver and executors share and reads it again, so that an executor lost later costs a read.

Common to the stages: columns besides doc_id, text, source and n_chars may have any names and stay as they are (the
last stage gives its own columns). Texts of any length are taken whole. An empty table goes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, pieces, suffixes, toxicity
from millrace.llm.common import table, written

MIX_SEED = 20
PIECE_SEED = 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``sf_dir``, predicts toxic go.

    Null and empty texts score as such (in practice clean), null ids are scored like others, rows that repeat stay or go
    together. A score of just the threshold counts as toxic.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingle sets, the one of the smallest id stays.

    Null ids, and null, empty or blank texts, link with nothing and stay. Rows that share an id stay or go together: repeated
    rows of the smallest id of a group all stay. A similarity of just 0.8 links.
    """
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document of a smaller id has go from the texts; n_chars follows the text.

    Null texts, and rows with a null id, stay as they are. Rows that share an id (repeated rows) take nothing from each other. A
    text of which nothing is left stays, empty.
    """
    kept = suffixes.without_repeats(docs)
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source weighs the same, in a global random order.

    A null source is a source of its own. Null and empty texts are repeated like others; rows that share an id (or have none)
    draw the same number of copies. Copies are alike in all columns.
    """
    return mixing.mix(docs, seed=MIX_SEED).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, with the source: a row per row, also for null and empty texts (no pieces). Rows alike in id and text get the same pieces."""
    return pieces.segment(docs, seed=PIECE_SEED, also=("source",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]

#: SQL can't train the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
