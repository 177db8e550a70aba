"""A corpus pipeline: five stages, each of which works on what its predecessor kept.

run(spark, sf_dir) reads documents, and writes each stage's rows as Parquet in the shared folder, from where the next one reads them.

Defined cases of all stages: a null text counts as empty and stays null where a stage keeps the row; null ids are kept and never equal a label's; repeated
rows are all kept or all go, but for the near-duplicate stage, of which one stays; further columns, whatever their names, pass through all stages but the last;
empty tables give empty results, and without labels or benchmark items nothing goes for their sake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cyclespan.llm import bpe, common, decontaminate, line_dedup, quality, similar, simhash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Without labels of both classes none is rejected."""
    return quality.good_documents(docs, common.table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal an earlier one, or lie within the edit distance of one of its class, go from the texts; all documents stay."""
    common.ship(spark)
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles: SimHash fingerprints within two bits, or similarity 0.8) the document with the smallest id stays; of rows that share it, the one with the least text hash.
    Texts without words are one group. A group whose ids are all null keeps one row."""
    common.ship(spark)
    return simhash.heads_of(docs, similar.near_duplicates(docs, shingle=5, similarity=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; items without words are contained in none."""
    return decontaminate.without_benchmark(docs, common.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with their digests and whether they decode to the text; a null text has no ids."""
    common.ship(spark)
    return bpe.encode(docs, with_ids=True).drop("decoded")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", repeated_lines),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: The classifier's training can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = common.table(spark, sf_dir, "documents"), common.Scratch(spark, "pipeline"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.keep(out)
        scratch.drop(last)
        last = docs
    return docs
