"""Episode logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from waymark.schema import EPISODE_DDL


def read_jsonl(spark: SparkSession, path, schema: str | T.StructType) -> DataFrame:
    """Strict read: a malformed line fails the job; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_episodes(spark: SparkSession, path) -> DataFrame:
    """Episode records plus ``episode_seq``, their order of ingest.

    The sequence is (file, start of the split, running id inside the split): it sorts
    like the lines of the files and does not depend on how splits were scheduled.
    """
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return read_jsonl(spark, path, EPISODE_DDL).select("*", seq.alias("episode_seq"))


def malformed_lines(spark: SparkSession, path) -> DataFrame:
    """Audit of a log: ``file, line_number, line`` of each non-blank line that is not valid JSON.

    Numbers count all lines of a file from 1, blank ones too. Lines are counted per split of a file; the
    number of a line is its place in its split plus the lines of the splits before. Only those counts, one row per
    split, and the malformed lines move.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    splits = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    wrong = lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNull())
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return wrong.join(splits, ["file", "_start"]).select("file", number.alias("line_number"), "line")


def first_malformed(spark: SparkSession, path) -> str | None:
    """The first malformed line of a log as ``file:line``; None when there is none."""
    found = malformed_lines(spark, path).orderBy("file", "line_number").select("file", "line_number").first()
    return f"{found[0]}:{found[1]}" if found else None


def sorted_fields(column: Column, dt: T.DataType) -> Column:
    """The same value with struct fields in name order at every level."""
    if isinstance(dt, T.StructType):
        fields = sorted(dt.fields, key=lambda f: f.name)
        built = F.struct(*[sorted_fields(column[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(column.isNotNull(), built)
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: sorted_fields(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)))
    return column


def to_json_line(df: DataFrame, *, keep_nulls: bool = True) -> Column:
    """One JSON object per row, keys sorted, NULL fields written out."""
    record = F.struct(
        *[sorted_fields(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    )
    return F.to_json(record, {"ignoreNullFields": str(not keep_nulls).lower()})


def _records(df: DataFrame) -> DataFrame:
    return df.drop("episode_seq").select(to_json_line(df.drop("episode_seq")).alias("value"))


def append_jsonl(df: DataFrame, path: str) -> None:
    _records(df).write.mode("append").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    _records(df).write.mode("overwrite").text(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Append the records as a named batch; writing the same batch again adds nothing.

    A batch owns the folder ``batches/batch=<name>``, which a second attempt replaces, and is listed in ``manifest``
    with its number of records only after it was written. :func:`read_batches` goes by the list, so what
    an interrupted write left behind is never read.
    """
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a batch is named by letters, digits, - and _: {batch!r}")
    target = f"{path}/batches/batch={batch}"
    _records(df).write.mode("overwrite").text(target)
    spark = df.sparkSession
    count = spark.read.text(target).agg(F.count("*").alias("n_records")).withColumn("name", F.lit(batch))
    count.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of all listed batches, with ``batch``; strict as :func:`read_jsonl`."""
    listed = spark.read.schema("name string, n_records long").json(f"{path}/manifest/batch=*").select("name")
    records = spark.read.schema(schema).option("mode", "FAILFAST").option("basePath", f"{path}/batches").json(f"{path}/batches/batch=*")
    return records.join(listed, F.col("batch").cast("string") == F.col("name"), "left_semi")
