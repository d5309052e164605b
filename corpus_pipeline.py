"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.llm import bpe, decontaminate, linededup, quality, simhash
from vectide.llm.queries import tokenizer_path
from vectide.llm.shared import kept, table
from vectide.session import apply_settings


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier expects to be good and clean; the others go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_selected(docs, model)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur before; one that loses lines and keeps no word goes.

    n_chars follows the new text.
    """
    lines, (_, removed) = linededup.dedup_lines(docs), linededup.count_columns(docs)
    left = lines.filter((F.col(removed) == 0) | F.col("text").rlike(linededup.WORD))
    changed = F.col(removed) > 0
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked: four-word shingles, four bits of 64 at most."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [
    ("quality", select_quality),
    ("lines", remove_repeated_lines),
    ("near-duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]

# the fitted classifier, the fingerprints and the tokenizer have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(apply_settings(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
