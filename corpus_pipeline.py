"""The corpus pipeline: quality, near duplicates, benchmark contamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. The mixing stage writes its rows in
mixed order (files by range of slots, rows sorted within them); the last stage encodes them in that order. An empty
table passes through all stages as an empty table; extra columns, whatever their names, are kept by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard_join, mixing, quality_classifier, shared, token_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null texts are scored as empty ones; repeated rows are judged alike."""
    return quality_classifier.keep_good(docs, shared.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id; of its rows one for each text.
    Null and empty texts are in no group; rows with a null doc_id stay."""
    return jaccard_join.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go. Null and empty texts, and rows with a null doc_id, stay."""
    return decontaminate.drop_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt by source to the target weights; the order of the written rows is the decision.
    A null source is a source; a null text counts as one character; every row stays once."""
    return mixing.mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards' index, in the order in which the stage before wrote its rows.

    Rows that no file holds (a table made in memory) are encoded in ascending doc_id order. A null text is the end id alone."""
    order = ["doc_id"]
    if docs.inputFiles():
        name = F.col("_metadata.file_name")
        part = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")  # as a number: names are longer from part 100000 on
        docs = docs.select("doc_id", "text", part.alias("part"), name.alias("file"), F.col("_metadata.row_index").alias("row"))
        order = ["part", "file", "row"]
    return token_shards.read_index(token_shards.write_shards(docs, shared.new_path(spark, "shards"), order))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", contamination),
    ("mixing sources to target weights", mix),
    ("token-ID output", tokens),
]

#: Learned scores and token ids are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written into the shared folder and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared.new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
