"""Long survey microdata to the three panel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims, schema
from ..functions.text import article_first, source_column


def dollars(thousands: Column) -> Column:
    """Thousands to whole dollars, fraction cut off; null counts as 0."""
    return F.coalesce((thousands * 1000).cast("long"), F.lit(0))


def funding_lines(micro: DataFrame) -> DataFrame:
    """The seven funding-source lines, without their detail lines."""
    return micro.where(F.col("questionnaire_no").rlike(dims.FUNDING_LINE))


def discovered_schema(micro: DataFrame) -> DataFrame:
    """Which code carries which label in which years, one row per pair."""
    return funding_lines(micro).groupBy("questionnaire_no", "row").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count_distinct("year").alias("n_years"),
    ).withColumn("column_name", source_column(F.col("row")))


def institutions(micro: DataFrame) -> DataFrame:
    """One row per institution and year with the seven amounts as columns.

    Duplicates of a line give its largest amount, so the result does not depend
    on row order; a missing line gives 0.
    """
    lines = funding_lines(micro).withColumn("metric", source_column(F.col("row")))
    wide = lines.groupBy("inst_id", "year").agg(
        F.min("inst_name_long").alias("name"), F.min("inst_city").alias("city"),
        F.min("inst_state_code").alias("state"),
        *[F.max(F.when(F.col("metric") == m, F.col("data"))).alias(m) for m in schema.METRICS],
    )
    return wide.select(
        "inst_id", article_first(F.col("name")).alias("name"), "city", "state", "year",
        *[dollars(F.col(m)).alias(m) for m in schema.METRICS],
    )


def _field_cells(micro: DataFrame) -> DataFrame:
    federal, nonfederal = F.lit(dims.FEDERAL_QUESTION), F.lit(dims.NONFEDERAL_QUESTION)
    return micro.where(
        F.col("question").isin(dims.FEDERAL_QUESTION, dims.NONFEDERAL_QUESTION)
        & (F.col("column") == dims.TOTAL_COLUMN) & (F.col("row") != dims.ALL_FIELDS_ROW)
    ).select(
        "inst_id", "year", F.col("row").alias("field_name"),
        F.when(F.col("question") == federal, F.col("data")).alias("federal"),
        F.when(F.col("question") == nonfederal, F.col("data")).alias("nonfederal"),
    )


def field_expenditures(micro: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Federal and nonfederal money per field.

    One aggregation over both questions gives the same rows as a full outer
    join of the two: a field in only one of them has 0 in the other. Labels are
    summed up first, so only the sums carry what the taxonomy says of them.
    """
    sums = _field_cells(micro).groupBy("inst_id", "year", "field_name").agg(
        dollars(F.max("federal")).alias("federal"), dollars(F.max("nonfederal")).alias("nonfederal")
    )
    known = taxonomy.select("field_name", "field_code", "parent_field", "is_parent").distinct()
    return sums.join(known, "field_name").withColumn("total", F.col("federal") + F.col("nonfederal")).select(
        schema.FIELDS.names)


def unmapped_fields(micro: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Field labels the taxonomy does not know, with the years they occur."""
    unknown = _field_cells(micro).join(taxonomy.select("field_name"), "field_name", "left_anti")
    return unknown.groupBy("field_name").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def agency_funding(micro: DataFrame) -> DataFrame:
    """Federal money per agency over all fields; zero rows are kept."""
    cells = micro.where(
        (F.col("question") == dims.FEDERAL_QUESTION) & (F.col("row") == dims.ALL_FIELDS_ROW)
        & F.col("column").isin(list(dims.AGENCY_NAMES))
    )
    return cells.groupBy("inst_id", "year", F.col("column").alias("agency_code")).agg(
        dollars(F.max("data")).alias("amount")
    ).select("inst_id", "year", "agency_code",
             dims.lookup(dims.AGENCY_NAMES, F.col("agency_code")).alias("agency_name"), "amount")
