"""A corpus pipeline of five operators: documents in, packed sequences out.

Each stage works on all rows that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm import mixing, ngram_jaccard, packing, substring_dedup, toxicity
from rentlens.llm.scratch import columns, store


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not mark as toxic; it learns from ``labels``.

    Null and empty texts are scored as texts without words, and stay; rows that repeat are judged alike. Null labels
    and ids teach nothing. No documents give none. Columns pass through, but for ``toxicity score`` and ``is toxic``.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, names=("toxicity score", "is toxic")).where("`is toxic` = 0").select(*columns(docs))


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link them at 0.8: the one of the least id.

    Null and empty texts are groups of their own and stay, but rows that repeat whole, those too, are one. A null id
    stays only if its group has no other. No documents give none. Columns pass through.
    """
    return ngram_jaccard.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows, and their length; a text without such words stays as it is.

    Every copy of a window goes, the first too, so rows that repeat whole lose such windows alike. Null texts stay null
    and empty ones empty; a text may become empty. No documents give none. Columns pass through; those named n_words,
    n_removed and kept_text are kept as they were.
    """
    own = docs.select(F.struct(*columns(docs)).alias("row"), "doc_id", "text")
    cut = substring_dedup.dedup(own)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in shards; a row a copy.

    A null source is a source, the last. Null and empty texts have no words: their block decides. Rows that repeat
    are taken alike. No documents give none. Columns pass through.
    """
    row = docs.select(F.struct(*columns(docs)).alias("row"), "doc_id", "text", "source")
    return mixing.mix(row).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens.

    A null text is empty: one piece, of the end alone. Equal rows have places of their own. No documents give no rows.
    """
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_similar),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the classifier, the permuted draws or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs)
    return docs
