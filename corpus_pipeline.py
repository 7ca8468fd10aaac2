"""The corpus pipeline: rules, language, near duplicates, mixing, packing.

Defined cases, by stage: rows whose text is null, empty or without words go with the rules; those without a letter go with
the language; rows that are equal in id and text, and all but the smallest id of a group of near duplicates, go with the
join, rows without an id stay; the mix takes rows as often as its slots read them, a null source is a source; every copy
that is left is packed. Further columns, whatever their names, are kept by all stages but the last; an empty table stays
empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featurelab.llm import language_id, mixing, ngram_join, packing, quality_rules
from featurelab.llm.common import materialize, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return language_id.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, 0.8 or more."""
    return ngram_join.filter_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of 1,024 tokens."""
    return packing.packed_pieces(docs, tokenizer_path(), ranks=tokenizer_path("byte_bpe_50k.tiktoken"), remember=150_000)


STAGES = [("quality_rules", quality), ("language_id", language), ("ngram_jaccard_join", near_duplicates), ("source_mixing", mix), ("best_fit_packing", pack)]

#: The posterior of the rules, the languages' machines and the packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
