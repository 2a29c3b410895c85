"""A training corpus from ``documents``: drop low quality, keep one of near copies, drop benchmark leaks, mix, tokenize.

Each stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causalbars.llm import common, decontaminate, mixing, ngram_join, quality, token_files


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones that are not held out, does not reject."""
    common.small_batches(spark)
    return quality.keep(docs, quality.train(spark, docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles join, similarity 0.75 or more."""
    return ngram_join.representatives(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item (or a shorter item) occurs."""
    return decontaminate.clean(spark, docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(spark, docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; per document, read back from them: its start, length and checksum."""
    import public_tokenizers

    root = common.new_dir(spark, "corpus-tokens")
    token_files.write_token_files(spark, docs, root, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, root)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("token ids", write_tokens),
]

#: A classifier, shingle components and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = common.written(spark, stage(spark, docs, sf_dir), f"stage-{at + 1}")
    return docs
