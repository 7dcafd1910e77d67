"""A corpus pipeline of five stages over `documents`; each stage works on all that its predecessor kept.

All stages take nulls in any column, empty and very long texts, ties, repeated rows, empty tables and columns
of other names, with the results that the operators state: null texts are empty, rows without a doc_id are kept apart
and never dropped as copies, repeated rows are judged and repeated alike, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calorine.functions.session import discard, saved
from calorine.llm import decontaminate, mixing, quality, setjoin, tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, shrunk toward source and language rates, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return setjoin.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    return mixing.mix(docs).drop("mix_copy", "mix_key")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.read(spark, tokens.write(docs, tokens.default_tokenizer()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL can express neither the classifier's fit nor the tokenizer; tests hold columns and row counts of the stages, and single operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
