"""Checks on logged SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def _used(sql: Column, column: str) -> Column:
    return F.regexp_extract_all(sql, F.lit(rf"(?i){column}\s*=\s*'([^']+)'"), F.lit(1))


def unknown_codes(
    queries: DataFrame, id_column: str, sql_column: str,
    field_codes: Sequence[str] | None = None, agency_codes: Sequence[str] | None = None,
) -> DataFrame:
    """Field and agency codes in SQL texts that do not exist, with suggestions.

    A field code suggests the codes of its family, by the part before the first
    underscore, or all codes if the family is unknown; an agency code suggests
    all agencies.
    """
    fields = sorted(dims.field_codes() if field_codes is None else field_codes)
    agencies = sorted(dims.AGENCY_NAMES if agency_codes is None else agency_codes)
    spark = queries.sparkSession
    # as long as the lists of codes
    known = spark.createDataFrame(
        [("field_code", c) for c in fields] + [("agency_code", c) for c in agencies], "kind string, code string")
    families = {}
    for c in fields:
        families.setdefault(c.split("_")[0], []).append(c)
    prefixes = spark.createDataFrame(
        [("field_code", f, ", ".join(held)) for f, held in families.items()], "kind string, family string, alike string")
    sql = F.col(sql_column)
    uses = F.concat(
        F.transform(_used(sql, "field_code"), lambda c: F.struct(F.lit("field_code").alias("kind"), c.alias("code"))),
        F.transform(_used(sql, "agency_code"), lambda c: F.struct(F.lit("agency_code").alias("kind"), c.alias("code"))),
    )
    used = queries.select(F.col(id_column), F.explode(F.array_distinct(uses)).alias("u")).select(
        id_column, "u.kind", "u.code"
    )
    unknown = used.join(F.broadcast(known), ["kind", "code"], "left_anti")
    # a family's suggestions are put together once, not for each use
    family = F.split_part("code", F.lit("_"), F.lit(1))
    every = F.when(F.col("kind") == "field_code", ", ".join(fields)).otherwise(", ".join(agencies))
    return unknown.withColumn("family", family).join(
        F.broadcast(prefixes), ["kind", "family"], "left").select(
        id_column, "kind", "code", F.coalesce("alike", every).alias("suggestions"))


VERBS = r"(?i)^(SELECT|WITH|INSERT|UPDATE|DELETE)\b"
REMARKS = r"^(```|--|Note:|This |The )"


def first_statement(answer: Column) -> Column:
    """The first SQL statement in a text that may hold fences and prose; empty if none.

    The statement starts at the first line that begins with a verb and ends at the
    first semicolon, or at the end; remarks between its lines are left out.
    """
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(x))
    marked = F.transform(lines, lambda x: F.struct(x.alias("x"), x.rlike(VERBS).alias("v")))
    start = F.array_position(F.transform(marked, lambda m: m["v"]), True).cast("int")
    rest = F.when(start > 0, F.slice(lines, start, F.size(lines))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(rest, lambda x: (x != "") & ~x.rlike(REMARKS))
    text = F.trim(F.split_part(F.array_join(kept, "\n"), F.lit(";"), F.lit(1)))
    return F.when(text == "", text).otherwise(F.concat(text, F.lit(";")))
