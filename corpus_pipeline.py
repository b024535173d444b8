"""A pipeline over `documents`: five stages, each by one operator of citegrain.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
documents; the last returns what was packed. Between stages the documents are written as Parquet to
the shared folder and read again.

Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of other names are
handled as the operators' modules say; doc_id, text and lang are the columns that are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm import decontamination, language_id, line_templates, minhash, packing
from citegrain.llm.common import table, written

#: A document whose best language explains a smaller share of its n-grams is in none of the languages.
LEAST_SCORE = 0.25
#: Texts link whose five-word shingles have at least this Jaccard similarity.
SHINGLE, LEAST_SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that are in no language of the training rows."""
    filters = language_id.fit(docs.where(language_id.training(docs)).select("doc_id", "text", "lang"))
    judged = language_id.identify(docs, filters)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates, short ones too; documents stay, n_chars follows the text."""
    out = line_templates.drop_recurring_lines(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. SimHash's trie finds the closest
    copies and MinHash the others; the sets of shingles decide about each link."""
    return minhash.one_of_each(docs, shingle=SHINGLE, least=LEAST_SIMILARITY)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and its place there."""
    return packing.packed(packing.tokenized(docs, packing.default_tokenizer())).drop("row")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", leaks),
    ("packing", sequences),
]

#: SQL can't express the trained filters, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
