"""Personal data by bootstrapped contextual extraction; DataFrame expressions only.

Patterned entities (email, ip, card, phone) are the seeds. An instance is a whole run
of neighbouring tokens that hold a digit or an @; the words beside it are its contexts.
Each instance induces up to three lexical patterns: the word before with the run's
shape (digit runs and letter runs are one class each), the two words before with any
shape, and the words on both sides with any shape. Patterns and instances form a
graph, scored in rounds: a pattern is as trustworthy as the instances it holds, an
instance as the best of its patterns. Runs in the slot of a trusted pattern that no
base rule covers are reported as ``found``, if they hold enough digits or an @.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import whole_text
from .spans import SPAN, all_in, as_spans, matches, met, written

KINDS = ("email", "ip", "card", "phone")
# fixed patterns, written so that no text makes them go back over what they read
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
TOKEN = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = rf"(?<![^\x20\x09-\x0D]){TOKEN}(?:\x20++{TOKEN})*+"
ROUNDS = 3  # a pattern whose slot holds seeds in 54 of 100 cases is trusted after three
LEAST_SEEDS = 5  # different seeds that a pattern needs
TRUST = 0.9
LEAST_DIGITS = 5  # of a run without @ that is reported
SHAPE = 48  # characters of a shape


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Base spans by kind, then start."""
    some = text.rlike("[0-9]")
    email = matches(text, EMAIL, 0, text.contains("@"))
    ip = F.filter(matches(text, IP, 0, some), lambda m: m["value"].rlike(OCTETS))
    card = F.filter(matches(text, CARD, 0, some & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
                    lambda m: F.length(digits(m["value"])).between(13, 19) & F.call_function(
                        "luhn_check", digits(m["value"])))
    phone = F.filter(matches(text, PHONE, 0, text.contains("+")),
                     lambda m: F.length(digits(m["value"])).between(9, 15))
    return all_in(*[as_spans(m, kind, i) for i, (kind, m) in enumerate(zip(KINDS, (email, ip, card, phone)))])


def shape(value: Column) -> Column:
    """Runs of digits as 9, of letters as a, of blanks as one; the rest as it is."""
    told = F.regexp_replace(F.regexp_replace(value, r"[0-9]++", "9"), r"\p{L}++", "a")
    return F.left(F.regexp_replace(told, r"\x20++", " "), F.lit(SHAPE))


def word(found: Column) -> Column:
    """Lower case, letters and digits only; empty if there are none."""
    return F.regexp_replace(F.lower(found), r"[^\p{L}\p{N}]++", "")


def patterns_of(before: Column, after: Column, core: Column) -> Column:
    """The lexical patterns of an instance; those with an empty word are left out."""
    white, some = r"[\x20\x09-\x0D]", r"([^\x20\x09-\x0D]+)"
    last = word(F.regexp_extract(before, rf"{some}{white}*$", 1))
    second = word(F.regexp_extract(before, rf"{some}{white}+[^\x20\x09-\x0D]+{white}*$", 1))
    following = word(F.regexp_extract(after, rf"^{white}*{some}", 1))
    kind = F.when(core.contains("@"), "@").otherwise("9")
    return F.filter(F.array(
        F.when(last != "", F.concat(F.lit("1 "), last, F.lit(" "), shape(core))),
        F.when((second != "") & (last != ""), F.concat(F.lit("2 "), second, F.lit(" "), last, F.lit(" "), kind)),
        F.when((last != "") & (following != ""), F.concat(F.lit("3 "), last, F.lit(" "), following, F.lit(" "), kind))
    ), lambda x: x.isNotNull())


def instances(docs: DataFrame) -> DataFrame:
    """One row per document: its number, base spans, and its runs, each told if a base span overlaps it. Stored."""
    text = F.col("text")
    rows = docs.select("doc_id", whole_text().alias("text"))
    placed = rows.select("doc_id", base_spans(text).alias("base"), matches(text, RUN, 0, text.rlike("[0-9@]")).alias("runs"))
    return write_scratch(placed.withColumn("runs", met(F.col("base"), F.col("runs"))).withColumn(
        "row", F.monotonically_increasing_id()), "pii")


def slots(rows: DataFrame) -> DataFrame:
    """(row, start, end, value, seed, likely, patterns) of every run, without the punctuation around it. Stored."""
    run = F.col("run.item")
    spread = rows.where(F.size("runs") > 0).select("row", F.explode("runs").alias("run"))
    lead = spread.withColumn("_lead", F.length(F.regexp_extract(run["value"], r"^[^\p{L}\p{N}+(]*+", 0)))
    core = lead.withColumn("_core", F.regexp_replace(
        F.substr(run["value"], F.col("_lead") + 1), r"(?<=[\p{L}\p{N})])[^\p{L}\p{N})]++$", ""))
    start = run["start"] + F.col("_lead")
    many = (F.length(digits(F.col("_core"))) >= LEAST_DIGITS) | F.col("_core").rlike(r"[^@]@[^@]")
    return write_scratch(core.select(
        "row", start.alias("start"), (start + F.length("_core")).alias("end"), F.sha2("_core", 256).alias("value"),
        F.col("run.met").alias("seed"), many.alias("likely"),
        patterns_of(run["before"], run["after"], F.col("_core")).alias("patterns")), "pii-slots")


def pattern_scores(edges: DataFrame) -> DataFrame:
    """(pattern) of the patterns trusted after all rounds.

    ``edges`` are (pattern, value, n, seeds, likely): how often a pattern holds a value,
    how often as a seed, and whether the value can be reported. Counting comes before
    every join, so a pattern or value with a third of all runs costs one row per partner.
    """
    scored = edges.withColumn("worth", (F.col("seeds") > 0).cast("double"))
    support = F.count(F.when(F.col("seeds") > 0, 1)).alias("support")
    patterns = None
    for turn in range(ROUNDS):
        patterns = write_scratch(scored.groupBy("pattern").agg(
            support, (F.sum(F.col("worth") * F.col("n")) / F.sum("n")).alias("trust")
        ).where(F.col("support") >= LEAST_SEEDS), "pii-patterns")
        if turn == ROUNDS - 1:
            break
        # the best of a value's patterns; what no pattern holds is worth nothing
        values = edges.join(patterns.drop("support"), "pattern").groupBy("value").agg(
            F.when(F.max("seeds") > 0, 1.0).when(F.bool_or("likely"), F.max("trust")).otherwise(0.0).alias("worth"))
        seeds = (F.col("seeds") > 0).cast("double")
        scored = edges.join(values, "value", "left").withColumn("worth", F.coalesce("worth", seeds))
    return patterns.where(F.col("trust") >= TRUST).select("pattern")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, all spans, and the number found by context.

    Null and empty texts have no spans. Repeated rows are kept and counted as often
    as they occur. Other columns are not read.
    """
    rows = instances(docs)
    seen = slots(rows)
    spread = seen.select("*", F.explode("patterns").alias("pattern")).drop("patterns")
    edges = write_scratch(spread.groupBy("pattern", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("seed"), 1)).alias("seeds"),
        F.bool_or("likely").alias("likely")), "pii-edges")
    span = F.struct(F.col("start"), F.lit(len(KINDS)).alias("kind_no"), F.col("end"),
                    F.lit("found").alias("kind"), F.lit("").alias("value"))
    added = spread.where(~F.col("seed") & F.col("likely")).join(
        pattern_scores(edges), "pattern", "left_semi").groupBy("row").agg(
        F.array_sort(F.collect_set(span)).alias("_added"))
    joined = rows.join(added, "row", "left")
    more = F.coalesce("_added", F.array().cast(f"array<{SPAN}>"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select(
        "doc_id", *[number(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", more)).alias("spans"), F.size(more).cast("long").alias("n_found"))
