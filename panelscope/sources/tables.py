"""Panel tables at rest: Parquet by year, and CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .microdata import by_header


def write_table(df: DataFrame, path: str, partition: str = "year", sort: str = "inst_id", even: bool = False) -> None:
    """Full refresh of a table: replace it, one folder per year.

    Rebalancing lets adaptive execution merge small and split large outputs;
    rows sorted by entity make point lookups skip row groups. ``even`` rows come from a
    shuffle by keys that has done so, and are written without another one.
    """
    placed = df if even else df.hint("rebalance", F.col(partition))
    placed.sortWithinPartitions(partition, sort).write.mode("overwrite").partitionBy(partition).parquet(path)


def read_table(spark: SparkSession, path: str, table_schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if table_schema is None else spark.read.schema(table_schema)
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Export a result with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_table(spark: SparkSession, paths: str | list[str], table_schema: T.StructType) -> DataFrame:
    """Read per-year CSV files of one table with a fixed schema.

    Columns are matched by name file by file: a year whose file lacks a column
    gets nulls there, as stacking frames by name does. Files of one header are one
    scan.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for header, files in by_header(spark, paths).items():
        raw = spark.read.option("header", True).schema(
            T.StructType([T.StructField(c, T.StringType()) for c in header])
        ).csv(files)
        parts.append(raw.toDF(*[c.strip() for c in header]))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    missing = [f for f in table_schema if f.name not in stacked.columns]
    stacked = stacked.withColumns({f.name: F.lit(None).cast("string") for f in missing}) if missing else stacked
    return stacked.select(*[_typed(f) for f in table_schema])


def _typed(field: T.StructField):
    col = F.col(field.name)
    if isinstance(field.dataType, (T.LongType, T.IntegerType)):
        # pandas writes whole numbers next to missing ones as 1234.0
        col = col.cast("decimal(38,6)")
    return col.cast(field.dataType).alias(field.name)


def refresh_from_csv(
    spark: SparkSession, paths: str | list[str], table_schema: T.StructType, out: str
) -> DataFrame:
    """Load CSV files into a table, replacing what was there; returns the table."""
    write_table(read_csv_table(spark, paths, table_schema), out)
    return read_table(spark, out).select(table_schema.names)
