"""Raw survey microdata: long-format CSV, one file per year."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema


CORRUPT = "_corrupt_line"
NEEDED = ("inst_id", "year")
# a file, or a folder of one survey's parts; names are tried from their first letter only, as lines are read with it
SURVEY_FILE = r"(?<![^/])([^/]+\.csv)(\.gz)?(/|$)"


def survey_file(path: Column) -> Column:
    return F.regexp_extract(path, SURVEY_FILE, 1)


def file_year(name: Column) -> Column:
    """First run of four digits in a file name."""
    return F.regexp_extract(name, r"(\d{4})", 1)


def survey_years(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files found and the year each is for; only names are listed."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.csv{,.gz}").load(paths).select("path")
    name = survey_file(F.col("path"))
    digits = file_year(name)
    return listed.select(name.alias("file"), digits.alias("digits")).where(F.col("digits") != "").select(
        "file", F.col("digits").cast("int").alias("year")
    ).distinct()


def years_with_several_files(files: DataFrame) -> DataFrame:
    """Years more than one file claims; reading them would count a survey twice."""
    return files.groupBy("year").agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") > 1)


def by_header(spark: SparkSession, paths: Sequence[str], **options) -> dict[tuple[str, ...], list[str]]:
    """The files of each header line, of which there are few; only first lines are read."""
    found: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        found.setdefault(tuple(spark.read.options(header=True, **options).csv(path).columns), []).append(path)
    return found


def read_microdata(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Read Latin-1 CSV files, packed or not; ids stay text, column names are trimmed.

    Columns are found by their trimmed name, and files of one header are one scan;
    ``file_year`` is the year in the file's name. Values that are no numbers and missing
    cells are null; ``read_checked`` tells them.
    """
    return read_checked(spark, paths).drop("line", "refused")


def read_checked(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``read_microdata`` with ``refused``, why a line is not as it should be, and its text in ``line``.

    Reasons are ``columns`` (too few or too many), ``<column>: missing`` for the id and the
    year, and ``<column>: not a <type>``. Good lines have no reasons and a null ``line``.
    """
    years = survey_years(spark, list(paths))
    twice = [r["year"] for r in years_with_several_files(years).collect()]
    if twice:
        raise ValueError(f"several files for the years {sorted(twice)}")
    options = {"encoding": "ISO-8859-1", "quote": '"', "escape": '"'}
    stacked = None
    for header, files in by_header(spark, paths, **options).items():
        part = _read_files(spark, header, files, options)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def _read_files(
    spark: SparkSession, header: Sequence[str], paths: list[str], options: dict[str, str]
) -> DataFrame:
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in (*header, CORRUPT)])
    # lines are judged whole, whatever columns are read of them
    raw = spark.read.options(header=True, columnNameOfCorruptRecord=CORRUPT, columnPruning=False, **options).schema(
        as_text).csv(paths)
    year = file_year(survey_file(F.col("_metadata.file_path"))).cast("int")
    raw = raw.select("*", year.alias("file_year"))
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    whole = F.col(CORRUPT).isNull()
    reasons = [("columns", ~whole)]
    for f in schema.MICRODATA:
        text, kind = F.trim(F.col(f"`{f.name}`")), f.dataType.simpleString()
        if f.name in NEEDED:
            reasons.append((f"{f.name}: missing", whole & (F.coalesce(text, F.lit("")) == "")))
        if not isinstance(f.dataType, T.StringType):
            bad = (text != "") & F.expr(f"try_cast(`{f.name}` AS {kind})").isNull()
            reasons.append((f"{f.name}: not a{'n' if kind[0] in 'aeiou' else ''} {kind}", whole & bad))
    # lists are made for refused lines only
    any_bad = reduce(lambda x, y: x | y, [F.coalesce(bad, F.lit(False)) for _, bad in reasons])
    told = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons]))
    refused = F.when(any_bad, told).otherwise(F.array().cast("array<string>"))
    cells = [F.coalesce(F.col(f"`{c.strip()}`"), F.lit("")) for c in header]
    line = F.when(any_bad, F.coalesce(F.col(CORRUPT), F.concat_ws(",", *cells)))
    typed = [
        F.col(f.name) if isinstance(f.dataType, T.StringType)
        else F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
        for f in schema.MICRODATA
    ]
    return raw.select(*typed, "file_year", line.alias("line"), refused.alias("refused"))


def refused_lines(checked: DataFrame) -> DataFrame:
    """One row per refused line and reason of what ``read_checked`` read."""
    return checked.where(F.size("refused") > 0).select("file_year", "line", F.explode("refused").alias("reason"))
