"""Reading and writing vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vectors_from_text(col: Column | str) -> Column:
    """Parse the text literal ``[1,2,3]`` into ``array<float>``; null when it is not one."""
    return F.from_json(F.col(col) if isinstance(col, str) else col, "array<float>")


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows to a Parquet vector table."""
    df.write.mode(mode).parquet(path)
