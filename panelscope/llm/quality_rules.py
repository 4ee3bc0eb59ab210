"""Quality rules by hashed n-gram log-likelihood ratios, as DataFrame expressions only.

Words and word pairs are hashed to buckets. Two multinomials over the buckets are
estimated, one from trusted documents and one from the whole corpus; a document's
score is the mean log ratio of its n-grams, so length does not count. Documents
under a fixed threshold are rejected, as are those failing the base rules.

Bound: the trusted documents are at most ``TRUSTED_ROWS`` labelled as good (least
hash of the id first). The raw counts cover every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import whole_text, words_pattern

BUCKETS = 1 << 17  # per n-gram length
TRUSTED_ROWS = 50_000
SMOOTHING = 1.0
THRESHOLD = -0.3  # mean log ratio per n-gram
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words in repeated windows
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(words_pattern()), F.lit(0))


def base_columns(docs: DataFrame) -> DataFrame:
    """Append _words and the base counts to rows that have ``text``.

    Repeated windows are found by sorting window hashes with their places; texts
    whose windows are all different skip that.
    """
    text = whole_text()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(words_pattern()))
    counted = docs.withColumn("_words", words_of(text)).withColumn("_lines", lines)
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    counted = counted.select(
        "*", n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    ).drop("_lines")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    counted = counted.withColumn("_placed", F.when(repeated, placed)).drop("_windows")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    m = F.size("_placed")
    before = F.concat(none, F.slice("_placed", 1, F.greatest(m - 1, F.lit(0))))
    after = F.concat(F.slice("_placed", 2, F.greatest(m - 1, F.lit(0))), none)
    same = F.zip_with(
        F.zip_with("_placed", before, lambda a, b: F.when(a["h"] == b["h"], a["i"])),
        F.zip_with("_placed", after, lambda a, b: F.when(a["h"] == b["h"], a["i"])),
        lambda a, b: F.coalesce(a, b))
    counted = counted.withColumn("_at", F.array_sort(F.array_compact(same))).drop("_placed")
    steps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))),
                       lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)
    return counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")


def failed_base() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ngram_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per word: its bucket, and that of the word with the next one (null at the end)."""
    nexts = F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1)))
    pairs = rows.select(*keep, F.inline_outer(F.arrays_zip(F.col("_words").alias("a"), nexts.alias("b"))))
    return pairs.select(
        *keep, F.pmod(F.xxhash64("a"), F.lit(BUCKETS)).alias("one"),
        F.when(F.col("b").isNotNull(), F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)) + BUCKETS).alias("two"),
        F.col("a").isNotNull().alias("_some"))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``rows`` ids labelled as good only; unknown labels are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return (known.groupBy("doc_id").agg(F.min("quality").alias("_good")).where("_good = 1")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, ratio), stored; as large as the number of buckets."""
    marked = docs.select("doc_id", words_of(whole_text()).alias("_words")).join(
        F.broadcast(trusted), "doc_id", "left")
    rows = ngram_rows(marked, "_good").where("_some")
    counts = write_scratch(
        rows.select("_good", F.explode(F.array("one", "two")).alias("bucket")).where("bucket is not null")
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good")), "ngrams")
    totals = {r.two: r for r in counts.groupBy((F.col("bucket") >= BUCKETS).alias("two"))
              .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()}

    def share(kind: str) -> Column:
        space = SMOOTHING * BUCKETS
        total = F.when(F.col("bucket") >= BUCKETS, totals[True][kind] if True in totals else 0).otherwise(
            totals[False][kind] if False in totals else 0)
        return (F.col(kind) + SMOOTHING) / (total + space)

    return write_scratch(counts.select("bucket", F.log(share("good") / share("raw")).alias("ratio")), "ratios")


def score_rows(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """Base columns and ``score`` of every row; rows are told apart by a number of their own."""
    columns = ["_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    based = base_columns(docs.select("doc_id", "text")).withColumn("_row", F.monotonically_increasing_id())
    rows = ngram_rows(based, *columns)
    for name in ("one", "two"):
        table = ratios.select(F.col("bucket").alias(name), F.col("ratio").alias(f"_{name}"))
        rows = rows.join(F.broadcast(table), name, "left")
    total = F.sum(F.coalesce("_one", F.lit(0.0)) + F.coalesce("_two", F.lit(0.0)))
    ngrams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return rows.groupBy(*columns).agg(total.alias("_total")).select(
        *columns[1:], (F.col("_total") / ngrams).alias("score"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: base counts, base_failed, score and kept.

    Null and empty texts have no words and fail the base rules; their score is 0.
    Repeated rows are scored one by one. Other columns are not carried.
    """
    ratios = log_ratios(docs, trusted_ids(labels))
    scored = score_rows(docs, ratios)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed_base().alias("base_failed"),
        (~failed_base() & (F.col("score") >= THRESHOLD)).alias("kept"), "score")
