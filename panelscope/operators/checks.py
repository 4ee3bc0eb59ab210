"""Load summaries, key checks and accounting invariants of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import full_dollars
from .common import Ids, latest, only


def load_summary(df: DataFrame, code: str | None = None) -> DataFrame:
    """Rows, year range, distinct ids and codes, parent and sub rows where known.

    Distinct ids are counted in a second step over distinct values, so no task
    holds a set of all ids.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("year").alias("first_year"),
            F.max("year").alias("last_year"), F.count_distinct("inst_id").alias("n_entities")]
    if code:
        aggs.append(F.count_distinct(code).alias("n_codes"))
    if "is_parent" in df.columns:
        aggs += [F.count_if(F.col("is_parent") == 1).alias("n_parent_rows"),
                 F.count_if(F.col("is_parent") == 0).alias("n_sub_rows")]
    return df.agg(*aggs)


def profile(inst: DataFrame) -> DataFrame:
    """Size, year range and mean and largest total as text."""
    return inst.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("inst_id").alias("institutions"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        full_dollars(F.avg("total_rd")).alias("avg_total_rd"),
        full_dollars(F.max("total_rd")).alias("max_total_rd"),
    )


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once."""
    keys = schema.KEYS[table]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def agency_reconciliation(inst: DataFrame, agencies: DataFrame) -> DataFrame:
    """Federal total against the sum over agencies, every entity and year."""
    sums = agencies.groupBy("inst_id", "year").agg(F.sum("amount").cast("long").alias("agency_total"))
    return inst.select("inst_id", "year", "federal").join(sums, ["inst_id", "year"], "left").withColumn(
        "matches", F.col("federal").eqNullSafe(F.col("agency_total"))
    )


def broken_invariants(inst: DataFrame, fields: DataFrame, agencies: DataFrame) -> DataFrame:
    """All rows that violate one of the four accounting rules.

    Field and agency rows of an entity and year that ``inst`` lacks are violations
    too: their sums stand against nothing. Each table is read once.
    """
    key = ["inst_id", "year"]
    by_branch = fields.groupBy(*key, "parent_field").agg(
        F.max(F.when(F.col("is_parent") == 1, F.col("total"))).alias("parent_total"),
        F.sum(F.when(F.col("is_parent") == 0, F.col("total"))).cast("long").alias("sub_total"),
        F.sum(F.when(F.col("is_parent") == 1, F.col("total"))).cast("long").alias("total"),
        F.sum(F.when(F.col("is_parent") == 1, F.col("federal"))).cast("long").alias("federal"),
    )
    uneven = F.col("sub_total").isNotNull() & ~F.col("parent_total").eqNullSafe(F.col("sub_total"))
    sums = by_branch.groupBy(*key).agg(
        F.sum("total").cast("long").alias("field_total"), F.sum("federal").cast("long").alias("field_federal"),
        F.collect_list(F.when(uneven, F.struct(  # as many as parents, of which the taxonomy has few
            F.col("parent_field").alias("code"), F.col("parent_total").alias("expected"),
            F.col("sub_total").alias("found")))).alias("uneven"),
    )
    by_agency = agencies.groupBy(*key).agg(F.sum("amount").cast("long").alias("agency_total"))
    joined = inst.select(*key, "total_rd", "federal").join(sums, key, "full").join(by_agency, key, "full")

    def told(name: str, expected: str, found: str) -> Column:
        return F.struct(F.lit(name).alias("check_name"), F.lit(None).cast("string").alias("code"),
                        F.col(expected).alias("expected"), F.col(found).alias("found"))

    whole = F.array(told("parents_sum_to_total", "total_rd", "field_total"),
                    told("parents_sum_to_federal", "federal", "field_federal"),
                    told("agencies_sum_to_federal", "federal", "agency_total"))
    parts = F.transform(F.coalesce("uneven", F.array()), lambda u: F.struct(
        F.lit("parent_is_sum_of_subfields").alias("check_name"), u["code"].alias("code"),
        u["expected"].alias("expected"), u["found"].alias("found")))
    broken = F.filter(whole, lambda c: ~c["expected"].eqNullSafe(c["found"]))
    return joined.select(*key, F.inline(F.concat(broken, parts))).select(
        "check_name", *key, "code", "expected", "found")


def latest_snapshot(df: DataFrame, ids: Ids = None) -> DataFrame:
    """Rows of the newest year, for the chosen entities if any are given."""
    return only(latest(df), ids)
