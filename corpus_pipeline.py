"""The corpus pipeline: quality filter, near-duplicate removal, repeated-passage removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. All but the last return the columns of ``documents``. ``run``
writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import mixing, ngram_join, packing, quality_model, substring
from strandlog.llm.store import written

#: SQL can't express the learned classifier, the joins' verified hashes and the tokenizer; tests use brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the additive model, fitted on the labels outside the held-out third, rejects.

    A text is judged by itself: a null one as an empty text, equal rows alike.
    Without usable labels every text has the same score and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.kept(docs, quality_model.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate class.

    Equal rows stay once, different texts that share an id are decided about
    each, rows without an id stay. Texts without words are near each other only
    if they are equal; a null text is an empty one.
    """
    return ngram_join.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words under 13-word windows that a document with a smaller id has; documents left without words go.

    A changed document's text is its kept words joined by spaces, and n_chars
    follows. Null and empty texts, texts of fewer than 13 words and rows without
    an id stay as they are; rows that share an id do not change each other.
    """
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so that sources come near their target weights; some come up to three times.

    A null source is one of its own. Texts without words take nothing, so they
    go. Rows that share an id are repeated alike.
    """
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 token ids: a row per piece.

    A null or empty text is its end id alone; repeated rows are packed each.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. An empty table gives an empty result; columns beyond doc_id, text and source pass through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
