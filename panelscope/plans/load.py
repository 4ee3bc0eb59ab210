"""Microdata files to stored panel tables in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .. import dims, schema
from ..operators import etl
from ..session import write_scratch
from ..sources import microdata, tables
from .panel import Panel

TABLES = {"institutions": schema.INSTITUTIONS, "field_expenditures": schema.FIELDS, "agency_funding": schema.AGENCIES}


def load_microdata(
    spark: SparkSession, paths: Sequence[str], out_dir: str, taxonomy: DataFrame | None = None
) -> Panel:
    """Read the yearly files, write the three panel tables and return them.

    The text is parsed once; the three tables then read the columns and
    questions they need from a columnar copy. Existing tables are replaced. Lines that
    are not as they should be are also written, with reasons, to ``refused_lines``.
    """
    checked = write_scratch(microdata.read_checked(spark, paths), "microdata")
    microdata.refused_lines(checked).write.mode("overwrite").parquet(f"{out_dir}/refused_lines")
    raw = checked.drop("line", "refused")
    known = dims.taxonomy(spark) if taxonomy is None else taxonomy
    built = {
        "institutions": etl.institutions(raw),
        "field_expenditures": etl.field_expenditures(raw, known),
        "agency_funding": etl.agency_funding(raw),
    }
    for name, df in built.items():
        tables.write_table(df, f"{out_dir}/{name}", even=True)
    return read_panel(spark, out_dir)


def read_panel(spark: SparkSession, folder: str) -> Panel:
    """The three stored tables of ``load_microdata``."""
    read = [tables.read_table(spark, f"{folder}/{name}").select(s.names) for name, s in TABLES.items()]
    return Panel(*read)
