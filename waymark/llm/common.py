"""Helpers the operators of this package share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.columns import as_col
from waymark.session import shared_folder, stage

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(c="text") -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(as_col(c), F.lit(""))


def word_count(c="text") -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD)).cast("long")


def crc_bucket(c, buckets: int = 4) -> Column:
    """crc32 of a value written as text, modulo ``buckets``."""
    return F.crc32(text_of(as_col(c).cast("string")).cast("binary")) % buckets


MOST_FILES = 100_000  # file names that are broadcast; rows of more files are written with their numbers


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a number of its own to every row; each reading sees the same numbers.

    Rows read from parquet files are numbered by the place of their file among all (by name) and their
    place in it, so nothing is written. Any other rows, or those of very many files, are written once."""
    if not _from_files(df):
        df = stage(df)
    if len(df.inputFiles()) > MOST_FILES:
        return stage(df.withColumn(name, F.monotonically_increasing_id()))
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = at.select("_file").distinct().select(
        F.col("_file").alias("_f"), F.row_number().over(Window.orderBy("_file")).alias("_nth")
    )
    # at most MOST_FILES rows; 2 ** 40 rows fit a file
    met = at.join(F.broadcast(files), F.col("_file") == F.col("_f"))
    return met.select(*df.columns, (F.shiftleft(F.col("_nth").cast("long"), 40) + F.col("_place")).alias(name))


def _from_files(df: DataFrame) -> bool:
    """Whether rows are those of parquet files one by one, picked or filtered at most."""
    plan = df._jdf.queryExecution().analyzed().toString()
    steps = {re.match(r"\W*(\w+)", line)[1] for line in plan.strip().splitlines()}
    return steps <= {"Project", "Filter", "Relation"} and " parquet" in plan.strip().splitlines()[-1]


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder; later reads do not recompute them."""
    spark: SparkSession = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
