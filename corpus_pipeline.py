"""A corpus pipeline over the documents: classify, deduplicate, decontaminate, pseudonymise, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs. The tables beside the
documents (labels, benchmark) are read from sf_dir.

Odd rows: a null text is an empty one, which the classifier scores like any other, near-dedup keeps,
decontamination finds nothing in, pseudonyms leave null and packing takes for the end id alone. Rows that share a
doc_id, or have none, stay rows of their own: each is scored, of those with equal shingles one stays, each is searched,
rewritten and packed. Texts of any length are read whole; extra columns, whatever their names, pass through to the last stage; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import decontam, minhash, packing, pii, rules
from colonnade.llm.common import new_path, ready
from colonnade.llm.queries import pii_key, table, tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at 0.3 or more."""
    return rules.keep(docs, rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more of the five-word shingles) the document with the least id."""
    return minhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data replaced within its format, by the key in COLONNADE_PII_KEY or one drawn for this process."""
    return pii.pseudonymize(docs, pii_key())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), 0, 2048)


STAGES = [("quality classifier", classify), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("pseudonyms", pseudonymize), ("packing", pack)]

#: Feistel networks, token ids and a genetic packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(ready(spark), sf_dir, "documents")
    at = new_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
