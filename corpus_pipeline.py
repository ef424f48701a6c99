"""The corpus pipeline: from raw documents to mixed, deduplicated token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. SQL cannot express the
learnt first stage, so there is no SQL for the whole; the stages are tested against plain versions.

Defined results of the stages, as of their operators: a null or empty text has a score, size 0, no group and no item;
texts of any length are worked on whole; rows that repeat an id are scored each, but one of them passes the n-gram join;
rows with a null id pass it; ties go to the smallest id; an empty table gives an empty result; further columns, whatever
their names, are carried to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import decontaminate, mixing, ngram_join, quality, tables, token_output


#: Units that the token output remembers: a worker still holds what earlier stages left in its process.
REMEMBERED_UNITS = 400_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return quality.keep_quality(docs, tables.read(spark, sf_dir, "labels"), train)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, tables.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    path = tables.new_path(spark, "tokens")
    token_output.write_tokens(docs, path, units=REMEMBERED_UNITS)
    return token_output.token_digests(spark, path)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token output", write_token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again; what a stage has read is deleted when it is written."""
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = tables.saved_parts([stage(spark, docs, sf_dir)], name.replace(" ", "-"))
        tables.drop(docs)
        docs = made
    return docs
