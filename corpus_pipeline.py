"""A training corpus out of documents, in five stages of the operators in drafthaus.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drafthaus.llm.common import table, written
from drafthaus.llm.line_dedup import dedup_substrings
from drafthaus.llm.mixing import mixed_documents
from drafthaus.llm.ngram_join import one_of_each
from drafthaus.llm.queries import PASSAGES, held_out, tokenizer_path
from drafthaus.llm.sentencepiece_bpe import sentencepiece_round_trip
from drafthaus.llm.toxicity import clean_documents, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    return clean_documents(docs, train(docs, table(spark, sf_dir, "labels"), usable=~held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; n_chars follows the text."""
    return dedup_substrings(docs, **PASSAGES).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of the text that they decode to."""
    return sentencepiece_round_trip(docs, tokenizer_path(), outputs=("n_tokens", "ids", "decoded_sha256"), keep=("doc_id", "lang", "source"), cache=100_000)  # the workers' memory adds to that of four stages before


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("tokens", tokens)]

#: The classifier and the random rounding can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
