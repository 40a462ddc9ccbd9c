"""Scans of tables and of values kept by reference."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_any(spark: SparkSession, path: str, kind: str = "parquet", **options: Any) -> DataFrame:
    """A table in any format that Spark reads."""
    return spark.read.format(kind).options(**options).load(path)


def read_inputs(spark: SparkSession, path: str, schema: str | None = None) -> dict[str, Any]:
    """Inputs of a flow from one JSON document, as plain values."""
    reader = spark.read.option("multiLine", True)
    row = (reader.schema(schema) if schema else reader).json(path).first()
    if row is None:
        raise ValueError(f"{path} holds no document")
    return row.asDict(recursive=True)


@dataclass(frozen=True)
class ByReference:
    """A table that is passed by its path and scanned lazily where it is used."""

    path: str
    kind: str = "parquet"

    def load(self, spark: SparkSession) -> DataFrame:
        return read_any(spark, self.path, self.kind)

    @classmethod
    def write(cls, df: DataFrame, path: str) -> ByReference:
        df.write.mode("overwrite").parquet(path)
        return cls(path)
