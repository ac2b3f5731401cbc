"""A corpus pipeline: quality rules, near-duplicate removal, repeated-passage removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents, and any more that come with them; run() writes each stage's rows to shared storage and reads
them again. An empty table passes through all stages. Columns of any name are safe: a row travels as one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from tidegate.llm.common import stored, table
from tidegate.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's thresholds go.

    Null and empty texts fail the base rules; a null lang or source is a group of its own; a null doc_id is no reason to
    go. Repeated rows are judged alike. Long texts are read whole.
    """
    return quality.quality_filter(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Texts without a word are nobody's duplicates and stay; rows without doc_id stay. Of rows that repeat a doc_id one
    stays, any of them.
    """
    return jaccard_join.one_of_each(docs)


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller doc_id also has go; a character that loses a byte goes whole.

    A document may be left empty, and stays. Null texts stay null; rows without doc_id lose nothing and take nothing; rows
    that repeat a doc_id are one document. n_chars follows the text.
    """
    return suffix_dedup.cut_texts(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, stay, are cut or go, as their source's budget says.

    Null and blank texts have no words, take nothing and go; a null source is a source of its own; null ids stand
    by their texts. Ties in order are settled by size and text.
    """
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: a row for each row. A null text is empty; a null doc_id stays null."""
    return bpe.bpe_digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("suffix_array_dedup", repeated_passages_stage),
    ("mixing_sources", mixing_stage),
    ("bpe_encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: Near duplicates, byte-level removal and BPE have no SQL form; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None
