"""From raw documents to packed sequences, in five stages.

A stage works on all rows that the one before it kept.  Between stages ``run``
writes Parquet to the shared folder and reads it again, so a lost executor
costs one stage at most.

All stages take null and empty texts, repeated rows, empty tables and extra columns
of any name; all but the last return the columns they were given.  The folders that they
write are cleared by ``victual.llm.common.remove_work``, once the result is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from victual.llm import classifier, lines, minhash, mixing, packing, simhash
from victual.llm.common import shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; those without text stand or fall with the share of good labels."""
    model = classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of passages; of equal ones that of the smallest doc_id stays."""
    return lines.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id; texts without words are a group.

    Groups are those of SimHash fingerprints; then, of what they leave, those of texts whose five-word
    shingles are alike by 0.8 or more, most of which differ in too many bits.
    """
    return simhash.keep_one(simhash.keep_one(docs), minhash.by_shingles)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken into the mix; those without words are never taken."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and their places in sequences; a document taken twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix),
    ("best-fit packing", pack),
]
#: The classifier is trained, and fingerprints are hashes that DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := shared_folder(spark, f"stage{k}"))
        docs = spark.read.parquet(path)
    return docs
