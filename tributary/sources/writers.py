"""Sinks.  Measurements are Parquet tables, a folder for each name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def save_measurements(results: dict[str, DataFrame], folder: str) -> None:
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load_measurements(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The saved tables of ``names``; missing ones are left out."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return found


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_array(df: DataFrame, path: str) -> None:
    """One array of records, written by one task; for results that fit one file."""
    from pyspark.sql import functions as F

    one = df.select(F.to_json(F.struct(*df.columns)).alias("r")).agg(F.concat(F.lit("["), F.concat_ws(", ", F.collect_list("r")), F.lit("]")).alias("value"))
    one.write.mode("overwrite").text(path)


def parent_mapping_csv(df: DataFrame, path: str) -> None:
    df.select("nodeID", "parentID").write.mode("overwrite").option("header", True).csv(path)
