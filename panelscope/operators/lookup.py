"""Entity lists, names, time windows and the resolution of everyday names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import stripped
from .common import latest, max_year


def year_bounds(inst: DataFrame, first_year: int = dims.FIRST_YEAR) -> DataFrame:
    """Newest year in the panel and the fixed first year of the survey."""
    return inst.agg(F.max("year").alias("max_year"), F.lit(first_year).alias("min_year"))


def time_windows(inst: DataFrame, first_year: int = dims.FIRST_YEAR) -> DataFrame:
    """Start and end year of the 5- and 10-year windows ending in the newest year."""
    spans = F.array(
        F.struct(F.lit("5-Year").alias("time_window"), (F.col("max_year") - 5).alias("start_year")),
        F.struct(F.lit("10-Year").alias("time_window"), (F.col("max_year") - 10).alias("start_year")),
    )
    return year_bounds(inst, first_year).select(F.inline(spans), F.col("max_year").alias("end_year"))


def custom_windows(asked: DataFrame, inst: DataFrame, first_year: int = dims.FIRST_YEAR) -> DataFrame:
    """Append ``start_year`` and ``end_year`` to requested years ``y0`` and ``y1``.

    Both are moved into the survey's years, and the start before the end. A missing
    year is the survey's first or newest one.
    """
    newest = max_year(inst)
    end = F.least(F.greatest(F.coalesce("y1", newest), F.lit(first_year + 1)), newest)
    start = F.least(F.greatest(F.coalesce("y0", F.lit(first_year)), F.lit(first_year)), newest - 1)
    return asked.withColumn("end_year", end).withColumn("start_year", F.least(start, F.col("end_year") - 1))


def latest_names(inst: DataFrame) -> DataFrame:
    """Name per entity in the panel's newest year; others are absent."""
    return latest(inst).select("inst_id", "name")


def last_known_names(inst: DataFrame) -> DataFrame:
    """Name per entity in its own newest year."""
    return inst.groupBy("inst_id").agg(F.max_by("name", "year").alias("name"))


def eligible_entities(inst: DataFrame, span: int = 5, min_years: int = 5) -> DataFrame:
    """Entities for the picker: enough recent years, some money, a current name."""
    newest = max_year(inst)
    steady = (
        inst.where(F.col("year").between(newest - span, newest))
        .groupBy("inst_id")
        .agg(F.count_distinct("year").alias("n_years"), F.sum("total_rd").alias("recent_rd"))
        .where((F.col("n_years") >= min_years) & (F.col("recent_rd") > 0))
    )
    return latest_names(inst).join(steady, "inst_id").select("inst_id", "name", "n_years")


def _largest() -> Column:
    """Aggregate: id and name of the largest spender, smallest id on ties."""
    order = F.struct((-F.coalesce("total_rd", F.lit(-1))).alias("size"), "inst_id")
    return F.min_by(F.struct("inst_id", "name"), order)


def _grams(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))))


def _best_containing(patterns: DataFrame, current: DataFrame) -> DataFrame:
    """Largest current entity whose name contains each (lower-case) pattern.

    A pattern is looked up by the rarest of its trigrams, so a name has at most as
    many rows as letters and a common part costs only those patterns that have
    nothing rarer. Patterns of one or two letters are grams themselves: the largest
    holder of each is found without pairing names and patterns.
    """
    names = current.select("inst_id", "name", "total_rd", F.lower("name").alias("low"))
    wanted = patterns.where(F.length("pattern") > 0).distinct()
    short = []
    for n in (1, 2):
        holders = names.select("inst_id", "name", "total_rd", F.explode(_grams(F.col("low"), n)).alias("pattern"))
        asked = wanted.where(F.length("pattern") == n)
        short.append(holders.join(asked, "pattern", "left_semi").groupBy("pattern").agg(_largest().alias("hit")))
    grams = names.select("*", F.explode(_grams(F.col("low"), 3)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no name has is rarest of all, and rightly finds nothing
    keyed = (
        wanted.where(F.length("pattern") >= 3).select("pattern", F.explode(_grams(F.col("pattern"), 3)).alias("gram"))
        .join(counts, "gram", "left").groupBy("pattern")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    )
    long = (
        grams.join(keyed, "gram").where(F.col("low").contains(F.col("pattern")))
        .groupBy("pattern").agg(_largest().alias("hit"))
    )
    return long.unionByName(short[0]).unionByName(short[1])


def resolve_entities(queries: DataFrame, inst: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve every text in ``queries(query)`` to an entity of the newest year.

    In order: an exact current name, a nickname, a part of a current name.
    Among several hits the largest spender wins. Texts are taken literally.
    Unresolved texts stay, with null id.
    """
    current = latest(inst).select("inst_id", "name", "total_rd")
    asked = queries.select("query").distinct()
    exact = (
        asked.join(current, asked["query"] == current["name"])
        .groupBy("query")
        .agg(_largest().alias("exact_hit"))
    )
    nick = aliases.select(F.upper("alias").alias("nick"), F.lower("full_name").alias("alias_pattern"))
    texts = (
        asked.join(nick, F.upper("query") == F.col("nick"), "left")
        .select("query", "alias_pattern", F.lower("query").alias("own_pattern"))
    )
    patterns = texts.select(F.explode(F.array_compact(F.array("alias_pattern", "own_pattern"))).alias("pattern"))
    found = _best_containing(patterns, current)
    by_alias = found.select(F.col("pattern").alias("alias_pattern"), F.col("hit").alias("alias_hit"))
    by_part = found.select(F.col("pattern").alias("own_pattern"), F.col("hit").alias("part_hit"))
    hits = (
        texts.join(exact, "query", "left")
        .join(by_alias, "alias_pattern", "left")
        .join(by_part, "own_pattern", "left")
    )
    priority = (
        F.when(F.col("exact_hit").isNotNull(), 1)
        .when(F.col("alias_hit").isNotNull(), 2)
        .when(F.col("part_hit").isNotNull(), 3)
    )
    # a text can have several nicknames only if they differ in case; first one wins
    ranked = hits.select(
        "query", priority.alias("priority"),
        F.coalesce("exact_hit", "alias_hit", "part_hit").alias("hit"),
    ).groupBy("query").agg(
        F.min_by(F.struct("priority", "hit"),
                 F.struct(F.coalesce("priority", F.lit(9)).alias("p"), F.col("hit.inst_id").alias("i"))).alias("best")
    )
    return ranked.select(
        "query", F.col("best.hit.inst_id").alias("inst_id"), F.col("best.hit.name").alias("name"),
        F.col("best.priority").alias("priority"),
    )


def normalise_terms(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """Map everyday field and agency words to codes; unknown words keep null."""
    known = terms.select(F.lower("term").alias("known"), "kind", "code")
    return (
        asked.select("term").distinct()
        .join(known, F.lower(stripped(F.col("term"))) == F.col("known"), "left")
        .select("term", "kind", "code")
    )
