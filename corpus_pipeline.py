"""From raw documents to packed sequences: five stages, each over all that the one before kept.

The first four return the columns of ``documents``: rejected by the quality rules, predicted
toxic, second of a near-duplicate group, contaminated by the benchmark - each goes. The last
returns the pieces of the packed sequences. Between stages the documents rest as Parquet in the
shared folder, so a lost executor costs no more than the stage at work.

Defined cases: rows go or stay each on its own. A null or blank text fails the base rules and goes
in the first stage; the later stages take such rows as well. Of a near-duplicate group the row of
the smallest id stays, with rows that repeat its id and text; null ids come last and are linked like
any other. Rows that share an id with one that goes are not taken along. Texts of any length are
read whole. Further columns, whatever their names, reach the last stage, which returns its own. An
empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordermill.llm import decontamination, near_dup, packing, quality, toxicity
from ordermill.llm.inputs import prepare, table, tokenizer_path
from ordermill.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Nearest-example votes and near-duplicate components have no SQL form; the stages are tested
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
