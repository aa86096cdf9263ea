"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontaminate, mixing, simhash, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is trained on those that are labelled.

    Rows without a text or words stay, repeated rows are judged alike, and no row goes if labels lack either class.
    """
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id.

    Rows without an id or text stay; rows that repeat both are left once.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go.

    Rows without a text or words stay, and all rows if the benchmark is empty.
    """
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of documents stay as the apportionment between sources grants them.

    Null sources are one source, and rows that share source and id stay or go together; sources without tokens go.
    """
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, code): the token ids of each row as a directly addressable code; null for a null text."""
    return tokens.token_codes(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
    ("token_output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder.

    Each stage's output goes once the next one's is complete; that of the last but one stays, as the result reads it.
    Extra columns go through all stages but the last. An empty table gives an empty result.
    """
    common.ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
            if k:
                files.delete(path(f"{base}/{k - 1}-{STAGES[k - 1][0]}"), True)
    return docs
