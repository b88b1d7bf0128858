"""Documents to training sequences, in five stages; each is written and read again before the next.

Quality rules, SimHash near-duplicates, benchmark decontamination, surrogates for personal data,
packing. All stages but the last return the columns of ``documents``.

Defined results: null, empty and short texts fail the base rule and go in the first stage; a null doc_id is judged by
its text like any other, and of a component only it stays if no row with an id is there; of repeated rows one
stays; very long texts are read whole; without labels only the base rule holds; an empty benchmark removes nothing; an
empty table gives no rows in every stage; columns with other names, also those an operator uses itself, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import decontaminate, packing, pii, quality_rules, simhash
from pointloom.session import dropping, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="documents")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced, and n_chars follows."""
    done = pii.pseudonymise(docs, pii.key_of(spark), count=None)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in done.columns else done


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("surrogates", surrogates), ("packing", packed)]

#: Learned rules, fingerprints, keyed surrogates and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with dropping(spark) as drop:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            # What a stage was made from has been read; its result stays.
            drop(1)
        return STAGES[-1][1](spark, docs, sf_dir)
