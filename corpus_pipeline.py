"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, source mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, to be written as Parquet and read again as
the next one's docs; run() does so in the shared folder. All but the last return the columns of
documents. A stage's working tables go when the next stage starts, so stages run one after another.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stash, tracked
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard_join import drop_near_copies
from tessera.llm.mixing import mix_documents
from tessera.llm.quality_rules import filter_documents
from tessera.llm.token_output import token_table


#: Working tables of the stage before, by session: read no more once its result is written.
_BEFORE: dict[int, list] = {}


def stage(fn):
    """A stage that first drops the working tables of the one before."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for t in _BEFORE.pop(id(spark), []):
            t.drop()
        with tracked() as made:
            out = fn(spark, docs, sf_dir)
        _BEFORE[id(spark)] = made
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers of their language and source go; null and empty texts fail, repeated rows are judged alike."""
    return filter_documents(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near copies stays: the one of smallest doc_id.

    Rows of null doc_id stay only where their group has no other; of its repeated rows one stays; texts without words all stay.
    """
    return drop_near_copies(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those of which hit words are five in a hundred or more. Of the others, matching spans of over 50 words go.

    Null and empty texts stay as they are.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix to target weights says; null texts and those without words count 0 words. Ties in size and doc_id are broken by the text."""
    return mix_documents(docs)


@stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32. A null or empty text is its end id alone; null doc_ids come first, rows of one doc_id in the order of their texts."""
    return token_table(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES[:-1]:
        now = stash(step(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express robust covariance estimates and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None
