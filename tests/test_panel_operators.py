"""Rank, growth, portfolio, agency and lookup operators on edge cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelscope import dims, schema
from panelscope.functions import ratios
from panelscope.operators import agency, growth, lookup, patterns, portfolio, rank
from panelscope.plans import adhoc
from panelscope.plans.panel import Panel

COLUMNS = "inst_id string, name string, state string, year int, total_rd long, federal long"


@pytest.fixture(scope="module")
def inst(spark):
    rows = [
        ("a", "Alpha U, The", "TX", 2015, 100, 50), ("a", "The Alpha U", "TX", 2020, 200, 50),
        ("b", "Beta", "TX", 2015, 300, 0), ("b", "Beta", "TX", 2020, 200, 100),   # tie with a in 2020
        ("c", "Gamma", "TX", 2020, 500, 100),                                     # no start year
        ("d", "Delta", "OH", 2015, 0, 0), ("d", "Delta", "OH", 2020, 90, 9),      # zero start
        ("e", "Eps", "OH", 2015, 70, 7),                                          # not in newest year
        ("f", "Phi", "OH", 2020, None, None),                                     # unknown total
    ]
    return spark.createDataFrame(rows, COLUMNS).cache()


def by_id(df, *key):
    key = key or ("inst_id",)
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_guards(spark):
    df = spark.createDataFrame([(0, 10, 5), (10, 0, 5), (-1, 5, 5), (10, -5, 5), (10, 20, 0), (10, None, 5), (32, 1, 5)],
                               "s long, e long, n int")
    got = [r[0] for r in df.select(ratios.cagr(F.col("s"), F.col("e"), F.col("n"))).collect()]
    assert got == [None, -100.0, None, None, None, None, -50.0]
    assert spark.range(1).select(ratios.pct(F.lit(1), F.lit(0))).first()[0] is None
    assert spark.range(1).select(ratios.pct(F.lit(1), F.lit(8))).first()[0] == 12.5
    assert spark.range(1).select(ratios.pct(F.lit(-25), F.lit(2000), 1)).first()[0] == -1.3  # half away from zero


def test_rank_ties_and_nulls(inst):
    rows = by_id(rank.rank_trend(inst, 2015, 2020), "inst_id", "year")
    places = {k: r["national_rank"] for k, r in rows.items() if k[1] == 2020}
    assert places == {("c", 2020): 1, ("a", 2020): 2, ("b", 2020): 2, ("d", 2020): 4, ("f", 2020): 5}
    # ranked among all, then restricted
    assert by_id(rank.rank_trend(inst, 2015, 2020, ["d"]), "inst_id", "year")["d", 2020]["national_rank"] == 4


def test_rank_movement(inst):
    rows = by_id(rank.rank_movement(inst, 2015, 2020))
    assert (rows["a"]["start_rank"], rows["a"]["current_rank"], rows["a"]["rank_change"]) == (2, 2, 0)
    assert rows["c"]["rank_change"] == 0 and rows["c"]["rd_change"] == 0


def test_state_ranking_and_band(inst):
    ranking = rank.state_ranking(inst, 2015, 2020)
    rows = by_id(ranking)
    assert set(rows) == {"a", "b", "c", "d"}  # e has no newest year, f no money
    assert (rows["a"]["state_rank"], rows["b"]["state_rank"], rows["c"]["state_rank"]) == (2, 2, 1)
    assert rows["a"]["cagr"] == 14.9 and rows["c"]["cagr"] is None and rows["d"]["cagr"] is None
    assert rows["d"]["market_share"] == 100.0 and rows["c"]["market_share"] == 55.6
    band = by_id(rank.state_band(ranking, 0, 0), "state", "target_rank", "inst_id")
    assert set(band) == {("TX", 1, "c"), ("TX", 2, "a"), ("TX", 2, "b"), ("OH", 1, "d")}


def test_band_stays_linear_under_ties(spark):
    """1,000 entities tied at one rank: their band has 1,000 rows, not a million."""
    rows = [(f"t{i:04d}", 5) for i in range(1000)] + [("top", 9), ("low", 1)]
    band = rank.metric_band(spark.createDataFrame(rows, "inst_id string, v long"), "v", 1, 1)
    counts = {r["target_rank"]: r["count"] for r in band.groupBy("target_rank").count().collect()}
    assert counts == {1: 1001, 2: 1001, 1002: 1}


def test_anchor_view(spark):
    inst = spark.createDataFrame([(f"{i:03d}", 2020, 1000 - i) for i in range(1, 121)], "inst_id string, year int, total_rd long")
    view = rank.anchor_view(inst, 2020, ids=["030", "011"]).collect()

    def seen(target):
        return sorted(r["national_rank"] for r in view if r["from_rank"] <= target <= r["to_rank"])

    assert seen(30) == [1, 10, 25, 30, 50, 100, 120]
    assert seen(11) == [1, 11, 25, 50, 120]  # 10 is too close
    assert sorted(r["inst_id"] for r in view if r["is_target"]) == ["011", "030"]


def test_anchor_view_lists_all_tied(spark):
    """A third of all entities share a landmark rank; each is listed once per segment."""
    rows = [(f"{i:04d}", 2020, 5000 if 9 <= i < 109 else 9000 - i if i < 9 else 4000 - i) for i in range(300)]
    view = rank.anchor_view(spark.createDataFrame(rows, "inst_id string, year int, total_rd long"), 2020).collect()
    tied = [r for r in view if r["national_rank"] == 10 and not r["is_target"]]
    segments = {(r["from_rank"], r["to_rank"]) for r in tied}
    assert len(tied) == 100 * len(segments) and len(segments) <= 48
    assert sum(r["is_target"] for r in view) == 300


def test_resolution_by_rare_parts(spark):
    inst = spark.createDataFrame([(str(i), f"University of {n}", "TX", 2020, i, 0) for i, n in enumerate(
        ["Alpha", "Beta", "Aa", "Zürich", "the Alpha Coast"])], COLUMNS)
    asked = spark.createDataFrame([(q,) for q in ("alpha", "OF B", "a", "zü", "x", "", "University of Alpha", "versity", "coastal")], "query string")
    none = spark.createDataFrame([], "alias string, full_name string")
    got = {r["query"]: r["inst_id"] for r in lookup.resolve_entities(asked, inst, none).collect()}
    assert got == {"alpha": "4", "OF B": "1", "a": "4", "zü": "3", "x": None, "": None,
                   "University of Alpha": "0", "versity": "4", "coastal": None}


def test_positions_have_no_gaps(inst):
    rows = by_id(rank.state_positions(inst))
    assert [rows[i]["state_position"] for i in "cab"] == [1, 2, 3]
    assert rows["f"]["total_rd"] == 0 and rows["f"]["state_total"] == 2


def test_growth_variants(inst):
    fixed, real = by_id(growth.cagr_window(inst, 2015, 2020)), by_id(growth.cagr_available(inst, 2010, 2020))
    assert fixed["b"]["cagr"] == -7.8 and fixed["e"]["cagr"] is None and fixed["c"]["cagr"] is None
    assert set(real) == {"a", "b"}  # the others have one year or no positive start
    yoy = by_id(growth.year_on_year(inst, 2015, 2020), "inst_id", "year")
    assert all(r["previous"] is None for r in yoy.values()) and len(yoy) == 9


def test_median_share(inst):
    rows = by_id(growth.national_median_share(inst, 2015, 2020), "year")
    assert rows[2015]["median_pct"] == 10.0  # 50, 0, 10; the zero total does not count
    assert rows[2020]["median_pct"] == 22.5  # 25, 50, 20, 10


def test_growth_not_before_a_field_existed(spark):
    rows = [("a", y, c, c, "p", 0, v) for c in ("eng_industrial", "eng_civil") for y, v in ((2015, 10), (2020, 20))]
    fields = spark.createDataFrame(
        rows, "inst_id string, year int, field_code string, field_name string, parent_field string, is_parent int, total long")
    assert set(by_id(portfolio.subfield_growth(fields, 2015, 2020), "field_code")) == {"eng_civil"}
    later = fields.withColumn("year", F.col("year") + 1)
    assert len(portfolio.subfield_growth(later, 2016, 2021).collect()) == 2


@pytest.fixture(scope="module")
def fields(spark):
    rows = [
        ("a", 2020, "eng", "eng", 1, "Engineering, all", 60, 40, 100), ("a", 2020, "eng_civil", "eng", 0, "Engineering, civil", 30, 0, 30),
        ("a", 2020, "eng_other", "eng", 0, "Engineering, other", 30, 40, 70), ("a", 2020, "math", "math", 1, "Mathematics and statistics, all", 0, 100, 100),
        ("a", 2015, "eng", "eng", 1, "Engineering, all", 10, 40, 50),
        ("b", 2020, "eng", "eng", 1, "Engineering, all", 200, 0, 200), ("c", 2020, "law", "law", 1, "Law, all", 0, 500, 500),
        ("b", 2020, "orphan", "gone", 0, "Gone, x", 1, 1, 2),
    ]
    return spark.createDataFrame(rows, schema.FIELDS).cache()


def test_portfolio(inst, fields):
    rows = by_id(portfolio.field_portfolio(inst, fields, 2020), "inst_id", "field_code")
    assert rows["a", "eng"]["portfolio_share"] == 50.0 and rows["a", "eng"]["federal_pct"] == 60.0
    drill = by_id(portfolio.field_drilldown(fields, 2020), "inst_id", "field_code")
    assert drill["a", "eng_civil"]["share_of_parent"] == 30.0 and drill["a", "eng_civil"]["discipline"] == "Civil"
    assert drill["b", "orphan"]["share_of_parent"] is None
    have = by_id(portfolio.parents_with_subfields(fields, 2020), "inst_id", "field_code")
    assert set(have) == {("a", "eng")}
    momentum = by_id(portfolio.field_momentum(inst, fields, 2015, 2020), "inst_id", "field_code")
    assert momentum["a", "eng"]["cagr"] == 14.9 and momentum["a", "math"]["cagr"] is None
    best = by_id(portfolio.field_highlights(portfolio.field_momentum(inst, fields, 2015, 2020),
                                            portfolio.field_portfolio(inst, fields, 2020)))
    assert best["a"]["fastest_field"] == "eng" and best["a"]["most_federal_field"] == "eng"
    assert best["c"]["fastest_field"] is None and best["c"]["most_federal_field"] == "law"


def test_distinctiveness(spark, fields):
    edges = spark.createDataFrame([("a", "b", 1, 0.0), ("a", "c", 2, 0.0)], schema.EDGES)
    rows = by_id(portfolio.field_distinctiveness(fields, edges, 2020), "target_id", "field_code")
    # only peers that report a field enter its mean
    assert rows["a", "eng"]["peer_avg_pct"] == 100.0 and rows["a", "eng"]["difference"] == -50.0
    assert rows["a", "math"]["peer_avg_pct"] == 0.0 and rows["a", "law"]["your_pct"] == 0.0
    zeros = by_id(portfolio.field_distinctiveness(fields, edges, 2020, missing_as_zero=True), "target_id", "field_code")
    assert zeros["a", "eng"]["peer_avg_pct"] == 50.0


def test_agencies(spark, inst):
    codes = list(dims.AGENCY_NAMES)
    amounts = {"a": [50, 0, 0, 0, 0, 0, 0], "b": [25, 25, 50, 0, 0, 0, 0], "c": [20, 20, 20, 10, 10, 10, 10],
               "d": [0, 0, 0, 0, 9, 0, 0]}
    rows = [(i, 2020, c, dims.AGENCY_NAMES[c], v) for i, vs in amounts.items() for c, v in zip(codes, vs)]
    rows += [("f", 2020, c, dims.AGENCY_NAMES[c], 0) for c in codes]
    agencies = spark.createDataFrame(rows, schema.AGENCIES)
    scores = by_id(agency.concentration(agency.agency_mix(inst, agencies, 2020)))
    assert scores["a"]["hhi"] == 1.0 and scores["a"]["diversification_score"] == 0.0
    assert scores["b"]["top_agency"] == "HHS (incl. NIH)" and scores["b"]["hhi"] == 0.375
    assert scores["f"]["hhi"] is None and scores["f"]["diversification_score"] is None  # no federal money
    place = by_id(agency.concentration_percentile(agencies, 2020))
    assert {i: r["national_percentile"] for i, r in place.items()} == {"c": 0, "b": 25, "a": 50, "d": 50}
    change = by_id(growth.agency_change(agencies, 2015, 2020), "inst_id", "agency_code")
    assert change["a", "DOD"]["funding_start"] == 0 and change["a", "DOD"]["pct_change"] is None
    ranks = by_id(patterns.concentration_ranks(inst, agencies, 2020))
    assert ranks["a"]["concentration_rank"] == ranks["d"]["concentration_rank"] == 1
    band = by_id(patterns.concentration_band(inst, agencies, 2020, "b"))
    assert set(band) == {"b"}


def test_names(spark, inst):
    assert by_id(lookup.latest_names(inst))["a"]["name"] == "The Alpha U"
    assert "e" not in by_id(lookup.latest_names(inst)) and by_id(lookup.last_known_names(inst))["e"]["name"] == "Eps"


def test_eligible(spark):
    years = {"full": range(2015, 2021), "five": range(2016, 2021), "four": range(2017, 2021), "gone": range(2015, 2020)}
    rows = [(i, i, "TX", y, 1, 0) for i, ys in years.items() for y in ys]
    rows += [("poor", "poor", "TX", y, 0, 0) for y in range(2015, 2021)]
    got = by_id(lookup.eligible_entities(spark.createDataFrame(rows, COLUMNS)))
    assert set(got) == {"full", "five"}  # "gone" has five years but no current name


def test_windows(spark):
    inst = spark.createDataFrame([("a", "A", "TX", 2024, 1, 1)], COLUMNS)
    asked = spark.createDataFrame(
        [(1, 2012, 2020), (2, 2005, 2030), (3, 2020, 2015), (4, None, None), (5, 2024, 2024)], "k int, y0 int, y1 int")
    got = {r["k"]: (r["start_year"], r["end_year"]) for r in lookup.custom_windows(asked, inst).collect()}
    assert got == {1: (2012, 2020), 2: (2010, 2024), 3: (2014, 2015), 4: (2010, 2024), 5: (2023, 2024)}


def test_resolution(spark):
    names = [
        ("1", "Massachusetts Institute of Technology", 900), ("2", "Smith College", 10),
        ("3", "University of North Texas, Denton", 500), ("4", "University of North Texas, Dallas", 50),
        ("5", "Rice University", 300), ("6", "Price Tower", 800), ("7", "UT", 1), ("8", "A% U_t", 5),
    ]
    inst = spark.createDataFrame([(i, n, "TX", 2020, t, 0) for i, n, t in names]
                                 + [("9", "Old Smith", "TX", 2019, 9999, 0)], COLUMNS)
    asked = ["mit", "UNT", "Rice", "smith", "Denton", "Rice University", "ut", "UT", "a%", "U", "zzz", "GT"]
    got = by_id(lookup.resolve_entities(spark.createDataFrame([(q,) for q in asked], "query string"), inst,
                                        dims.aliases(spark)), "query")
    assert {q: (r["inst_id"], r["priority"]) for q, r in got.items()} == {
        "mit": ("1", 2), "UNT": ("3", 2), "Rice": ("5", 2), "smith": ("2", 3), "Denton": ("3", 3),
        "Rice University": ("5", 1), "ut": ("1", 3), "UT": ("7", 1), "a%": ("8", 3), "U": ("1", 3),
        "zzz": (None, None), "GT": (None, None),
    }


def test_terms(spark):
    asked = spark.createDataFrame([(" BME ",), ("NIH",), ("agriculture",), ("poetry",)], "term string")
    got = {(r["term"], r["kind"], r["code"]) for r in lookup.normalise_terms(asked, dims.terms(spark)).collect()}
    assert got == {(" BME ", "field", "eng_biomedical"), ("NIH", "agency", "HHS"), ("agriculture", "field", "life_agricultural"),
                   ("agriculture", "agency", "USDA"), ("poetry", None, None)}


def test_guarded_sql(spark, inst, fields, tmp_path):
    adhoc.register(Panel(inst, fields, spark.createDataFrame([], schema.AGENCIES)))
    assert adhoc.guarded_query(spark, " select count(*) n from institutions where year = :y", {"y": 2020}).first()["n"] == 5
    assert adhoc.guarded_query(spark, "WITH t AS (SELECT 1 AS x) SELECT * FROM t").first()["x"] == 1
    target = str(tmp_path / "t")
    bad = [
        "DROP TABLE institutions", "WITH t AS (SELECT 1 AS x) INSERT INTO institutions SELECT * FROM t",
        f"INSERT OVERWRITE DIRECTORY '{target}' USING parquet SELECT 1", "DELETE FROM institutions", "SET a=b",
        f"WITH t AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{target}' USING parquet SELECT * FROM t",
    ]
    java = "reflect('java.lang.System', 'getProperty', 'user.home')"
    (tmp_path / "f.txt").write_text("secret")
    spark.range(3).createOrReplaceTempView("other_view")
    leak = f"text.`{tmp_path}/f.txt`"
    bad += [f"SELECT {java}", f"SELECT * FROM {leak}", "SELECT * FROM other_view", "SELECT * FROM range(5)"]
    bad += [f"SELECT * FROM institutions WHERE name = (SELECT {java})", f"SELECT (SELECT max(value) FROM {leak}) x",
            f"WITH t AS (SELECT * FROM {leak}) SELECT * FROM t", f"WITH t AS (SELECT {java} AS x) SELECT * FROM t",
            f"SELECT * FROM institutions WHERE EXISTS (SELECT 1 FROM {leak})", "SELECT * FROM t, (WITH t AS (SELECT 1) SELECT * FROM t)",
            f"SELECT * FROM institutions i JOIN (SELECT * FROM {leak}) USING (name)", f"SELECT transform(array(1), x -> {java})"]
    dynamic = ["IDENTIFIER('reflect')", "IDENTIFIER('re' || 'flect')", "IDENTIFIER('java_method')", "identifier('try_' || 'reflect')"]
    bad += [f"SELECT {name}('java.lang.System', 'getProperty', 'user.home') AS x FROM institutions" for name in dynamic]
    bad += ["SELECT * FROM IDENTIFIER('other_view')", f"SELECT * FROM IDENTIFIER('text.`{tmp_path}/f.txt`')",
            "SELECT IDENTIFIER('na' || 'me') FROM institutions", f"SELECT * FROM VALUES ({java}) t(x)",
            "SELECT input_file_name() FROM institutions", "SELECT current_user()", "SELECT plus_one(1)", "SELECT rand()",
            "SELECT * FROM institutions ORDER BY IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')",
            "SELECT * FROM institutions WHERE EXISTS (SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home'))"]
    spark.udf.register("plus_one", lambda x: x + 1, "int")
    good = ["SELECT name, round(avg(total_rd), 1) a, rank() OVER (ORDER BY max(year) DESC) r FROM institutions GROUP BY name HAVING count(*) > 0",
            "SELECT state, nullif(coalesce(sum(federal), 0), 0) * 1.0 / sum(total_rd) s, upper(state) u, nvl(state, '') v,"
            " CASE WHEN state LIKE 'T%' THEN 1 ELSE 0 END t FROM institutions WHERE state IN ('TX', 'OH') GROUP BY state ORDER BY 2 LIMIT 5",
            "SELECT i.name, f.field_code FROM institutions i LEFT JOIN field_expenditures f ON i.inst_id = f.inst_id AND i.year = f.year"
            " WHERE i.total_rd > (SELECT avg(total_rd) FROM institutions) AND NOT EXISTS (SELECT 1 FROM agency_funding a WHERE a.inst_id = i.inst_id)",
            "SELECT year, lag(total_rd) OVER (PARTITION BY inst_id ORDER BY year) l FROM institutions",
            "SELECT explode(transform(array(1, 2), x -> x + 1)) e", "SELECT DISTINCT substr(name, 1, 2) s, CAST(year AS STRING) y FROM institutions",
            "SELECT * FROM (VALUES (1), (2)) v(x)", "SELECT inst_id FROM Institutions WHERE year IN (SELECT max(year) FROM institutions)",
            "WITH a AS (SELECT 1 AS x), b AS (SELECT x + 1 AS y FROM a) SELECT * FROM b UNION ALL SELECT * FROM a"]
    for sql in good:
        adhoc.guarded_query(spark, sql).collect()
    for sql in bad:
        with pytest.raises(adhoc.NotReadOnly):
            adhoc.guarded_query(spark, sql)
    assert not (tmp_path / "t").exists()


def test_top_questions(spark, inst):
    top = by_id(patterns.top_total(inst, 2020, 3))
    assert {i: r["national_rank"] for i, r in top.items()} == {"c": 1, "a": 2, "b": 2}
    faster = patterns.faster_in_state(inst, "b", "TX", 2015, 2020).collect()
    assert [(r["inst_id"], r["cagr"], r["target_cagr"]) for r in faster] == [("a", 14.9, -7.8)]
    counts = by_id(patterns.faster_than_each(inst, 2015, 2020))
    assert {i: r["n_faster"] for i, r in counts.items()} == {"a": 0, "b": 1}
