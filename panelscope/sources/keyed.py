"""Tables kept by key: a merge rewrites only the buckets that its rows belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import latest_preferences
from ..session import exists, write_scratch

BUCKETS = 64
PART_ROWS = 1 << 20  # rows of a bucket that one task merges, about


def _in_buckets(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    # one folder per bucket; only folders that rows are written to are replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_keyed(
    spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], order: Sequence[str],
    buckets: int = BUCKETS,
) -> list[int]:
    """Put ``changes`` into the table at ``path``, the row of the greatest ``order`` staying per key.

    Only the buckets of changed keys are read and written; the files of all others stay
    as they are. The buckets touched are returned, at most ``buckets`` numbers. Merging
    the same changes again changes nothing, so a merge that broke off is run again. The
    table is made if it is not there; ``keys`` and ``buckets`` must stay the same.
    Changes of no rows touch nothing; a null key is a value like any other.
    """
    new = write_scratch(_in_buckets(latest_preferences(changes, keys, order), keys, buckets), "changes")
    sizes = {r["bucket"]: r["count"] for r in new.groupBy("bucket").count().collect()}
    touched = sorted(sizes)
    if touched and exists(spark, path):
        old = read_keyed(spark, path, new).where(F.col("bucket").isin(touched))
        for r in old.groupBy("bucket").count().collect():
            sizes[r["bucket"]] += r["count"]
        # moved once: a part of a bucket is merged and written where it lies; the files read go when all are written
        parts = 1 + max(sizes.values()) // PART_ROWS
        both = old.unionByName(new).withColumn("_part", F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(parts)))
        dealt = both.repartition("bucket", "_part")
        _write(latest_preferences(dealt, ["bucket", "_part", *keys], order).drop("_part"), path)
    elif touched:
        _write(new.hint("rebalance", F.col("bucket")), path)
    return touched


def read_keyed(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table with the columns of ``like``; ``bucket`` is one if ``like`` has it."""
    return spark.read.schema(like.schema).parquet(path).select(like.columns)


def merge_sink(path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS):
    """A ``foreachBatch`` function that merges every micro-batch; ``batch`` is its number.

    A batch that is run again merges the same rows again.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        merge_keyed(batch.sparkSession, path, batch.withColumn("batch", F.lit(batch_id).cast("long")),
                    keys, order, buckets)

    return run
