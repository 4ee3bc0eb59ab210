"""Plain-text usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed format: "YYYY-MM-DD HH:MM:SS,mmm - User: <name> | Question: <text>"
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - User: (.*?) \| Question: (.*)$"


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_usage_log(spark.read.text(path))


def parse_usage_log(lines: DataFrame) -> DataFrame:
    """Timestamp, user and question per line; blank lines and exact repeats go.

    Repeats collapse before the shuffle and before any line is parsed, so a
    line copied many times is cheap.
    """
    kept = lines.select("value").where(F.length("value") > 0).distinct()
    return kept.where(F.col("value").rlike(LINE)).select(
        F.to_timestamp_ntz(F.substring("value", 1, 23), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        F.regexp_extract("value", LINE, 2).alias("username"),
        F.regexp_extract("value", LINE, 3).alias("question"),
    )
