"""A training-corpus pipeline out of the operators: each stage works on all its predecessor kept.

``run`` applies the stages to ``documents``; every stage's result is written as Parquet below
the shared checkpoint folder and reread, so a lost executor costs tasks of one stage only.
All stages but the last return rows with the columns of their input.

Defined results: the stages' own (see their operators).  Null and empty texts have no letter, so the language
stage drops them; rows without an id stay in near-dedup, as no other row can name them, and equal texts
under one id stay once; ties are decided as the operators say; texts of any length pass whole; an
empty table passes every stage; extra columns, whatever their names, are carried to the last stage, which
returns its digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from infosieve.llm import decontam, langid, mixing, simhash, token_codec
from infosieve.llm.common import stored, table
from infosieve.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that no learned language explains go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near copies stays, that of the smallest id."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every document as often as its source's target asks for."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the mix as coded token files; a digest per document read back from them."""
    return token_codec.token_digests(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Its stages train models and pass over links until they settle; tests/llm holds brute-force versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
