"""The corpus pipeline: each stage calls one operator of ``ravenhunt.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and gives it to the next.
All stages but the last return the columns of ``documents``.

Every stage works on all rows that its predecessor kept, and keeps rows with a
null doc_id or text unless its own decision concerns them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenhunt.llm import decontamination, packing, simhash, surrogates, toxicity
from ravenhunt.llm.queries import SURROGATE_KEY, vocabulary
from ravenhunt.session import ensure_on_workers, read_table, scratch_table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    ensure_on_workers(spark)
    rows = toxicity.toxic_documents(docs, read_table(spark, sf_dir, "labels"))
    return rows.filter("not is_toxic").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest doc_id."""
    ensure_on_workers(spark)
    return simhash.one_of_each(docs, shingle=4, distance=4)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ensure_on_workers(spark)
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; ``n_chars`` follows the text."""
    columns = docs.columns
    count = "_entities"
    while count in columns:
        count += "_"
    rows = surrogates.anonymised(docs, SURROGATE_KEY, count)
    if "n_chars" in columns:
        size = F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        rows = rows.withColumn("n_chars", F.coalesce(size, "n_chars"))
    return rows.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stayed, packed into sequences of 4096 tokens."""
    ensure_on_workers(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("toxicity", toxic), ("simhash", near_duplicates), ("decontamination", decontaminated), ("pii", private), ("packing", packed)]

#: A fitted classifier and the tokens of a sequence have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
