"""A training corpus in five stages; each takes and returns the columns of documents, the last its token files' index."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasefold.llm import base, decontaminate, langid, mixing, near_dedup, token_output


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """docs with columns that are not used renamed, so that no result of an operator takes their place; what gives all columns back."""
    names = [c if c in used else f"own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language, go; others without a lang get the one found."""
    rows, back = apart(docs, "doc_id", "text", "lang")
    return langid.identify(rows).where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked at 0.8, over any number of links, the row with the smallest id stays."""
    return near_dedup.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, back = apart(docs, "doc_id", "text")
    return decontaminate.decontaminate(rows, base.table(spark, sf_dir, "benchmark"), remove="documents").select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; documents come as often as the mix takes them."""
    return mixing.Mixer(docs).mix()


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; per document its place and checksum, read back from them."""
    return token_output.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark_free), ("mixing", mix), ("tokens", tokens)]
#: language ID and sampling are no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    scratch = base.Scratch(spark, "corpus")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
