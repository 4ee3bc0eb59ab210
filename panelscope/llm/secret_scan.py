"""Secrets, told apart by how many owners hold them; DataFrame expressions only.

Assignments, access keys and hexadecimal runs are found in every text, and as
further candidates bare tokens of letters and digits. The candidates' hashes are
counted over the whole corpus: distinct owners and repositories. A value that many
owners hold is a copied example; one that a single owner holds looks live. Bare
tokens become spans only if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import whole_text
from .spans import SPAN, all_in, as_spans, matches, met, written

KINDS = ("assign", "access", "hex", "bare")
# fixed patterns: letters of the names in either case
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
LEAST_VALUE = 6
EXAMPLE_OWNERS = 3  # a value held by so many owners is a copied example
LIVE_REPOSITORIES = 2  # a value of one owner in at most so many repositories looks live


def found_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    named = F.filter(matches(text, ASSIGN, 2, text.contains("=") | text.contains(":")),
                     lambda m: F.length(m["inner"]) >= LEAST_VALUE)
    assign = F.transform(named, lambda m: F.struct(
        m["start"].alias("start"), F.lit(0).alias("kind_no"), m["end"].alias("end"),
        F.lit("assign").alias("kind"), m["inner"].alias("value")))
    access = as_spans(matches(text, ACCESS, 0, text.contains("AKIA")), "access", 1)
    return F.array_sort(all_in(assign, access, as_spans(matches(text, HEX), "hex", 2)))


def bare_spans(text: Column) -> Column:
    mixed = F.filter(matches(text, BARE, 0, text.rlike(r"[A-Za-z0-9+/_=-]{20}")),
                     lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    return as_spans(mixed, "bare", 3)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: its number, base spans and bare spans apart from them, stored."""
    text = F.col("text")
    rows = docs.select(
        "doc_id", owner.alias("owner"), repository.alias("repository"), whole_text().alias("text"))
    placed = rows.select(
        "doc_id", "owner", "repository", found_spans(text).alias("base"), bare_spans(text).alias("more"))
    apart = F.transform(F.filter(met(F.col("base"), F.col("more")), lambda x: ~x["met"]), lambda x: x["item"])
    return write_scratch(placed.withColumn("more", apart).withColumn(
        "row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash the numbers of owners and repositories, and the verdict on it.

    Counts are distinct, and combined before they are moved, so a value that a third
    of all rows hold is no hot spot. A null owner or repository counts as one.
    """
    counts = found.groupBy("value").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    verdict = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(
        (F.col("owners") <= 1) & (F.col("repositories") <= LIVE_REPOSITORIES), "live").otherwise("shared")
    return counts.withColumn("verdict", verdict)


def secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: its spans, and how many of them look live or copied.

    Null and empty texts have no spans. Repeated rows are kept; they add no owners.
    Columns that are not named are not read.
    """
    rows = candidates(docs, F.coalesce(owner, F.lit("")), F.coalesce(repository, F.lit("")))
    spread = rows.where((F.size("base") > 0) | (F.size("more") > 0)).select(
        "row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span"))
    hashed = spread.withColumn("value", F.sha2("span.value", 256))
    judged = hashed.join(ownership(hashed), "value").groupBy("row").agg(
        F.collect_list(F.when((F.col("span.kind") == "bare") & (F.col("verdict") == "live"), F.col("span")))
        .alias("_added"),
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"),
        F.count(F.when(F.col("verdict") == "example", 1)).alias("n_example"))
    joined = rows.join(judged, "row", "left")
    added = F.coalesce("_added", F.array().cast(f"array<{SPAN}>"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select(
        "doc_id", *[number(k) for k in KINDS[:3]], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", added))).alias("spans"),
        F.size(added).cast("long").alias("n_bare_live"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"))
