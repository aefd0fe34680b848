"""The corpus pipeline: five stages over documents, each on all that the one before kept.

Toxic documents go; one document of each near-duplicate class stays; repeated passages are cut out of the texts;
documents that hold benchmark items go; what is left is encoded. Stages but the last return the columns of documents;
each stage's rows are written as Parquet in the shared folder and read again as the next one's documents.

The last stage's rows are checked against brute-force versions in the tests: learned scores, sketches and merges have
no SQL form, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, lexicon, neardup, repeats, toxicity
from quarry.llm.queries import vocabulary
from quarry.llm.shared import node_key, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay. The model learns from the labels of the corpus that comes in."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, machine, "_toxicity").where("_toxicity < 0.5").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the row with the least doc_id stays; rows are known by doc_id and text, and of
    several with the same doc_id and text one stays."""
    found = written(neardup.decided(docs), "near-decided")
    gone = found.where("not kept").select(F.col("node").alias("_gone")).distinct()
    left = docs.withColumn("_node", node_key()).join(gone, F.col("_node") == F.col("_gone"), "left_anti")
    twins = found.where("kept").groupBy(F.col("node").alias("_twin")).count().where("count > 1").select("_twin")
    alone = left.join(twins, F.col("_node") == F.col("_twin"), "left_anti")
    one = left.join(twins, F.col("_node") == F.col("_twin"), "left_semi").dropDuplicates(["_node"])
    return alone.unionByName(one).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a passage that also starts earlier are cut; a text that loses none stays as it is, line ends and all."""
    return repeats.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item stay; each row goes or stays by its own text."""
    leaked = decontaminate.leaked(docs, table(spark, sf_dir, "benchmark")).select(F.col("node").alias("_leaked")).distinct()
    return docs.join(leaked, node_key() == F.col("_leaked"), "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, as digests beside their number."""
    return lexicon.digest(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
