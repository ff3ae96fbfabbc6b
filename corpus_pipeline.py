"""Corpus pipeline: documents through the stages of STAGES, each written as Parquet and reread by the next.

All stages take an empty table, null and empty texts, very long texts, repeated rows, null ids, ties, and extra columns of any name; all but
the last return the columns that they were given. What becomes of the odd rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm.exact_dedup import kept_documents
from histospark.llm.jaccard_join import distinct_documents
from histospark.llm.packing import pack
from histospark.llm.pii import pseudonymise
from histospark.llm.queries import WORD_BPE, pseudonym_key
from histospark.llm.storage import stored
from histospark.llm.toxicity import learn, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from the labels scores below one half. Each row goes or stays by its own whole text; null and empty texts
    score below, and so does every text if the labels that may be learned from are all alike or none. An id with several labels has the largest."""
    return without_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of white space count as one space), the row with the smallest id stays: one row of each text, also where rows repeat an id
    or are equal in all. Null and empty texts are one text; a null id stays only if no other row has the text."""
    return kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.75 or more connect, the row with the smallest id stays: one row of each group, also where rows repeat an
    id. Texts without words are linked with nothing and all stay; a null id stays only if its group has no other."""
    return distinct_documents(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates replaced within the texts, in every row by itself; null and empty texts stay. n_chars follows where the table has it
    and it isn't null."""
    made = pseudonymise(docs, pseudonym_key(spark))
    if "n_chars" not in docs.columns:
        return made
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return made.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. Null and empty texts are a piece of the end token; rows that repeat an id are documents of
    their own."""
    return pack(docs, WORD_BPE)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("pseudonyms", pseudonyms),
    ("best_fit_packing", packing),
]

#: No SQL can express the learned and the permuting stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES in order to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
