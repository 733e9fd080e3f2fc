"""``spark-submit`` entry: reports and models of an episode log."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from waymark.plans.bundle import analyze_log
from waymark.session import clear_staged


def main() -> None:
    parser = argparse.ArgumentParser(description="Analyse an episode log.")
    parser.add_argument("--episodes", required=True, help="JSON lines file or folder")
    parser.add_argument("--out", default="reports", help="output folder")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--no-models", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("waymark-analyze").getOrCreate()
    summary = analyze_log(
        spark, args.episodes, args.out, fmt=args.format, models=not args.no_models
    )
    clear_staged(spark)
    for name, value in summary.items():
        print(f"{name}: {value}")


if __name__ == "__main__":
    main()
