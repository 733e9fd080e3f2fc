"""A training corpus from ``documents``: toxic texts out, near copies and repeated passages out,
sources mixed to their weights, and the result packed into sequences.

Each stage takes (spark, docs, sf_dir) and gives rows with the columns of ``documents``; the last
gives the packed pieces. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import mixing, packing, partenum, substrings, toxicity
from waymark.llm.common import checkpointed, crc_bucket, numbered
from waymark.session import ship_package, stage, table

#: No SQL gives a fitted classifier's decisions or a packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label")
    model = toxicity.learn(docs, labels, crc_bucket("doc_id") != 2)
    scored = toxicity.score(docs, model, docs.columns, "_score")
    return scored.filter(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that of the least id, rows without an id last.

    Every row is a document of its own here, whatever its id, so repeated rows are copies of each
    other, and rows of one id with unlike texts stay."""
    ship_package(spark)
    rows = numbered(docs)
    groups = partenum.near_groups(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    ids = groups.join(rows.select("_row", "doc_id"), "_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    kept = ids.groupBy("component_id").agg(least.alias("least")).select(F.col("least._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; texts that have none stay as they are."""
    ship_package(spark)
    left = substrings.remove_repeats(docs, columns=docs.columns)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return left.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of words that the mix takes, as whole texts or cut ones."""
    ship_package(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place. ``row`` tells the rows of one id apart, as mixing may repeat them."""
    from public_tokenizers import path

    ship_package(spark)
    files = path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json")
    return packing.pack(checkpointed(packing.pieces(numbered(docs, "row"), *files, columns=("doc_id", "row"))))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeats),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
