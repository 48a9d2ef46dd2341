"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import common, langid, linededup, minhash, mixing, packing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go.

    Without any label every text with a letter stays. Very long texts are labelled whole; repeated rows
    and rows without a doc_id fare by their text; an empty table stays empty; other columns pass through.
    """
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents stay in one of them; a document with nothing left goes.

    Null and empty texts lose nothing and stay; a row without a doc_id neither counts nor loses lines;
    of ties the smallest doc_id keeps the line; rows that share a doc_id are one document; other columns
    pass through, and n_chars follows the text.
    """
    return linededup.keep_fresh(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 5-word shingle similarity 0.8 or more: the one with the smallest doc_id.

    Null and empty texts are copies of each other; rows without a doc_id stay; of rows that share the
    kept doc_id one stays; other columns pass through.
    """
    return simhash.keep_one(docs, minhash.near_copies)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target mixture takes it, which may be never.

    Null and empty texts count no tokens and get the rate that their prior implies; without labels every
    document stays once; repeated rows are taken alike; other columns pass through.
    """
    labels = mixing.label_domains(common.read_table(spark, sf_dir, "labels"))
    return mixing.resample(docs, labels)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one end token; each row is packed once, also where rows share a doc_id or
    have none; very long texts are cut into whole sequences and a rest.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]
#: Classifiers, rates and packing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read again.

    What a stage stored for itself goes when its result is written, and that result when the next one is.
    """
    docs, last = common.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            common.forget(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
