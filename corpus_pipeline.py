"""A corpus from documents to token sequences, in stages that are written one by one.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return rows of ``documents`` as they came, with columns of any name;
all return no rows for an empty table, and read texts of any length whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coppice.llm import exact_dedup, langid, mixing, packing, simhash
from coppice.llm.common import cut_of
from coppice.llm.queries import word_tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that are rejected go.

    Null and empty texts and those without a letter are rejected; rows alike are judged alike.
    """
    return langid.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id.

    Null and empty texts are equal, a null id is smallest, and of repeated rows one stays.
    """
    return exact_dedup.survivors(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id.

    Null ids come last, ties go to the smaller text hash, and of repeated rows one stays;
    texts without words are one group.
    """
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words are not taken, a null source is a source, equal ranks go by id and
    text hash, and repeated rows are taken alike.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in its sequence; a document taken twice has its pieces twice.

    A null or empty text is the closing id alone; null ids are kept; ties go by row and piece.
    """
    return packing.pack(docs, word_tokenizer()).drop("row_id")


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Fingerprints and token ids are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_of(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
