"""Report tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps, structs and variants as JSON text, other columns unchanged."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table still writes its column names."""
    flat_columns(df).write.mode("overwrite").option("header", True).csv(path)


def write_reports(tables: dict[str, DataFrame], out: str, *, fmt: str = "parquet") -> None:
    """One folder per table below ``out``, as parquet or csv."""
    for name, df in tables.items():
        if fmt == "csv":
            write_csv(df, f"{out}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{out}/{name}")
