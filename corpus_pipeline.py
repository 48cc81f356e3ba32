"""A training-corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing and tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

- ``quality`` drops the documents that the classifier of quality rejects.
- ``lines`` cuts lines that repeat an earlier line, sets n_chars anew, and drops documents of which nothing is left.
- ``near_duplicates`` keeps one document, that of the smallest doc_id, of each group that n-gram similarity links.
- ``mixing`` keeps each document as often as its rate says, so that language token totals meet their target shares. Rates
  below one drop some documents and rates above one repeat some; repeats keep their doc_id.
- ``pieces`` returns each document's sampled SentencePiece pieces.

Empty tables pass through every stage. Some stages can't be said in SQL, so there is none for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, ngram_join, pieces, quality
from tessera.llm.queries import TARGETS, labelled_domains
from tessera.llm.shared import table
from tessera.plans.staging import discard, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.lines_removed(docs, least=1).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates_removed(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [("quality", keep_quality), ("lines", cut_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("pieces", tokenise)]

#: Classifiers, sampling by fitted rates and sampled segmentations have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        read, docs = docs, stage(f(spark, docs, sf_dir), f"pipeline-{name}")
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
