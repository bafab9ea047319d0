"""The corpus pipeline: five stages from raw documents to shards, each one of the operators of citegrid.llm.

A stage takes the documents its predecessor kept. Its result is written as Parquet and read again, so a lost executor
costs no stage before it.

Each stage judges rows, not keys: equal doc_ids are rows of their own but where a stage says otherwise, and repeated rows
are near-duplicates of each other, of which one stays. Null and empty texts have no letter, so the first stage drops them. An
empty table passes through all stages as an empty table. Texts are read whole, however long. Columns beyond those of
documents pass through, whatever their names; of columns named like those that the last stage adds the added ones stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citegrid.llm import decontam, langid, mixing, sharding, simhash
from citegrid.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter (null, empty or of signs alone), or like no language that was
    learnt, go. What is learnt comes from the rows of docs with a lang; without any, nothing is known and all go. Of ties
    between languages the first by name is taken; a very long text is scored in pieces that are summed."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates. Of rows of equal text and doc_id, nulls
    included (they come last), one stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null texts hold none; an empty benchmark keeps every document; of
    repeated rows all stay or all go; passages are looked for in the whole of long texts."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most; a null source is a source, the last one. Equal
    doc_ids of a source have one place on its line and are taken alike."""
    return mixing.apply_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it, along a Hilbert curve over language, source and length. Nulls are in
    the lowest step of a dimension; rows equal in doc_id and all three, such as repeats of the mix, get slots in any order."""
    return sharding.hilbert_shards(docs, ["lang", "source", "n_chars"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Language ID, fingerprints and retrieval are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir: the columns of documents with shard, slot and curve_index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
