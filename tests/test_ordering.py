"""The run forms must give what plain windows give, whatever the skew."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelscope.plans import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        year = 2001 if i % 3 else 2000  # one year holds two thirds
        value = 0 if i % 3 == 0 else rng.choice([None, rng.randint(-50, 50), rng.randint(0, 10**12), 12345])
        rows.append((f"{i:06d}", year, value))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, "inst_id string, year int, v long").repartition(6).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("by", [[], ["year"]])
@pytest.mark.parametrize("descending", [True, False])
def test_rank(skewed, by, descending):
    order = F.desc_nulls_last("v") if descending else F.asc_nulls_first("v")
    plain = skewed.withColumn("r", F.rank().over(Window.partitionBy(*by).orderBy(order)))
    runs = ordering.ranked(skewed, "v", by, "r", descending)
    assert table(plain, "inst_id", "r") == table(runs, "inst_id", "r")


def test_rank_of_doubles(skewed):
    doubles = skewed.withColumn("v", F.col("v") / 7.0)
    plain = doubles.withColumn("r", F.rank().over(Window.partitionBy("year").orderBy(F.desc_nulls_last("v"))))
    runs = ordering.ranked(doubles, "v", ["year"], "r")
    assert table(plain, "inst_id", "r") == table(runs, "inst_id", "r")


@pytest.mark.parametrize("by", [[], ["year"]])
def test_positions(skewed, by):
    plain = skewed.withColumn("position", F.row_number().over(
        Window.partitionBy(*by).orderBy(F.desc_nulls_last("v"), "inst_id")))
    runs = ordering.positions(skewed, "v", "inst_id", by)
    assert table(plain, "inst_id", "position") == table(runs, "inst_id", "position")


def test_medians(skewed):
    plain = skewed.groupBy("year").agg(F.median("v").alias("median"))
    runs = ordering.medians(skewed, "v", ["year"])
    assert table(plain, "year", "median") == table(runs, "year", "median")


@pytest.mark.parametrize("kind", ["ties", "tails", "near", "wide", "few"])
def test_medians_of_odd_values(spark, kind, monkeypatch):
    """Ties, values over many powers of ten, values next to each other, and ranges that cannot be parted."""
    rng = random.Random(3)
    make = {"ties": lambda: float(rng.choice([1, 1, 1, 2, 3])), "tails": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300),
            "near": lambda: 1.0 + rng.randint(0, 9) * 2.0**-52, "wide": lambda: rng.choice([-1.7e308, 1.7e308, 0.0]),
            "few": lambda: rng.random()}[kind]
    rows = [(g if g else None, make() if rng.random() < 0.9 else None) for g in range(7) for _ in range(1 + g * g if kind == "few" else 150)]
    table_of = spark.createDataFrame(rows, "g int, v double")
    plain = table_of.where("v is not null").groupBy("g").agg(F.median("v").alias("median"))
    for ranges in (4, 4096):
        monkeypatch.setattr(ordering, "RANGES", ranges)
        assert table(ordering.medians(table_of, "v", ["g"]), "g", "median") == table(plain, "g", "median")
    whole = ordering.medians(table_of, "v", [])
    assert table(whole, "median") == table(table_of.agg(F.median("v").alias("median")), "median")
    assert ordering.medians(table_of.where("false"), "v", ["g"]).count() == 0


def test_ranks_in_one_plan(skewed):
    """Nothing is sorted whole or by group alone; a hot value is one row of its bucket."""
    plan = ordering.ranked(skewed, "v", ["year"], "r")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "_bucket" in plan


def test_previous_values(skewed):
    plain = skewed.withColumn("previous", F.lag("v").over(Window.partitionBy("year").orderBy("inst_id")))
    runs = ordering.previous_values(skewed, "v", ["year"], ["inst_id"])
    assert table(plain, "inst_id", "previous") == table(runs, "inst_id", "previous")


def test_following_values(skewed):
    sparse = skewed.withColumn("v", F.when(F.col("inst_id").cast("int") % 400 == 0, F.col("v")))
    order = Window.partitionBy("year").orderBy(F.desc("inst_id"))
    plain = sparse.withColumn("following", F.last("v", ignorenulls=True).over(order))
    runs = ordering.following_values(sparse, "v", ["year"], [F.desc("inst_id")])
    assert table(plain, "inst_id", "following") == table(runs, "inst_id", "following")


def test_runs_split_a_hot_group(skewed):
    """No run may hold a whole year, or all rows of the hot value's year."""
    keys = [F.col("year"), F.desc_nulls_last("v"), F.col("inst_id")]
    runs = ordering.sorted_runs(skewed, keys)
    assert runs.select("_run").distinct().count() >= 4
    largest = runs.groupBy("_run").count().agg(F.max("count")).first()[0]
    assert largest < skewed.count() / 3


def test_dense_positions_and_neighbours(spark):
    values = spark.range(0, 500).select((F.col("id") * 3).alias("v"))
    at = ordering.dense_positions(values, "v", "p")
    around = ordering.neighbours(at, "p", 4, F.col("v"), block=16).orderBy("p").collect()
    assert [r["p"] for r in around] == list(range(500))
    for r in around:
        lo, hi = max(0, r["p"] - 4), min(499, r["p"] + 4)
        assert r["around"] == [3 * i for i in range(lo, hi + 1)]


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("g"), "id")
    top = ordering.top_k(df, ["g"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial and final
    assert table(top, "g", "id", "rank")[0] == (0, 996, 2)
