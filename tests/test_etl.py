"""Microdata files to panel tables, on hand-made files."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from panelscope import dims, schema
from panelscope.operators import checks, etl
from panelscope.plans import derived, load, panel
from panelscope.sources import microdata, tables

HEADER = " inst_id ,inst_name_long,inst_city,inst_state_code,year,questionnaire_no,question,row,column, data"
FED, NON = dims.FEDERAL_QUESTION, dims.NONFEDERAL_QUESTION


def line(inst, year, no, question, row, column, data, name='"Ohio Université, The"'):
    return f'{inst},{name},Town,OH,{year},{no},{question},"{row}",{column},{data}'


LINES_2015 = [
    line("003594", 2015, "01.a", "Sources", "Federal government", "Total", "12.3456"),
    line("003594", 2015, "01.a", "Sources", "Federal government", "Total", "10"),  # duplicate
    line("003594", 2015, "01.b", "Sources", "State and local government", "Total", ""),  # null
    line("003594", 2015, "01.g", "Sources", "Total", "Total", "20"),
    line("003594", 2015, "01.1", "Sources", "Institution funds, detail", "Total", "99"),
    line("003594", 2015, "09", FED, "Engineering, all", "Total", "7"),  # federal only
    line("003594", 2015, "11", NON, "Life sciences, all", "Total", "5"),  # nonfederal only
    line("003594", 2015, "09", FED, "Psychology, all", "Total", "2"),
    line("003594", 2015, "11", NON, "Psychology, all", "Total", "1.5"),
    line("003594", 2015, "09", FED, "Alchemy, all", "Total", "4"),  # unknown label
    line("003594", 2015, "09", FED, "All", "Total", "9"),
    line("003594", 2015, "09", FED, "All", "NSF", "9"),
    line("003594", 2015, "09", FED, "All", "DOD", ""),  # null: kept as 0
]
LINES_2016 = [
    line("000007", 2016, "01.g", "Sources", "Total", "Total", "3", name="Plain College"),
    line("000007", 2016, "09", FED, "All", "USDA", "0", name="Plain College"),
]


@pytest.fixture(scope="module")
def micro(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for year, lines in ((2015, LINES_2015), (2016, LINES_2016)):
        (folder / f"survey_{year}_v2.csv").write_bytes("\n".join([HEADER, *lines]).encode("latin-1"))
    paths = [str(folder / f"survey_{y}_v2.csv") for y in (2015, 2016)]
    return microdata.read_microdata(spark, paths).cache()


def test_read(micro):
    first = micro.where(F.col("inst_id") == "003594").first()
    assert first["inst_name_long"] == "Ohio Université, The"
    assert {r[0] for r in micro.select("file_year").distinct().collect()} == {2015, 2016}
    assert [f.name for f in micro.schema][:-1] == schema.MICRODATA.names
    assert micro.schema["data"].dataType.simpleString() == "double"


def test_two_files_for_a_year_are_refused(spark, tmp_path):
    for name in ("a_2015.csv", "b_2015.csv"):
        (tmp_path / name).write_text(HEADER + "\n")
    with pytest.raises(ValueError, match="2015"):
        microdata.read_microdata(spark, [str(tmp_path / n) for n in ("a_2015.csv", "b_2015.csv")])


def test_packed_files(spark, tmp_path):
    """A packed file is read and listed as the plain one; names in folders above count only if they are surveys."""
    folder = tmp_path / "kept_1999.csvs"
    folder.mkdir()
    packed = gzip.compress("\n".join([HEADER, *LINES_2015]).encode("latin-1"))
    (folder / "survey_2015_v2.csv.gz").write_bytes(packed)
    path = str(folder / "survey_2015_v2.csv.gz")
    assert [tuple(r) for r in microdata.survey_years(spark, [path]).collect()] == [("survey_2015_v2.csv", 2015)]
    read = microdata.read_checked(spark, [path])
    assert read.count() == len(LINES_2015) and {r[0] for r in read.select("file_year").distinct().collect()} == {2015}
    assert read.where(F.size("refused") > 0).isEmpty()


def test_fields_summed_before_labels(spark, micro):
    """No shuffle carries more of a field than its label; a label listed twice counts once."""
    twice = dims.taxonomy(spark).union(dims.taxonomy(spark))
    got = etl.field_expenditures(micro, twice)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [inst_id#" in plan and "parent_field" not in plan.split("Aggregate [inst_id#")[1].split("]")[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, etl.field_expenditures(micro, dims.taxonomy(spark)).collect()))


def test_stored_taxonomy(spark, sf_small):
    """Joins know the size of the taxonomy: it is a stored table, not a plan over the parts."""
    assert "Aggregate" not in derived.taxonomy(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()


def test_one_shuffle_for_both_levels(spark, sf_small, tmp_path):
    """Sub-fields, parents and the written table read one shuffle by supplier, year and type."""
    plan = panel._field_rows(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    by = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines()
          if "Exchange hashpartitioning(" in line]
    assert by and all("p_brand" not in b for b in by)
    assert {b.count(",") for b in by if "l_suppkey" in b} == {3}  # three keys and the number of partitions
    stored = tables.read_table(spark, panel._once(spark, sf_small, "suppliers", panel.build_supplier_panel) + "/field_expenditures")
    assert stored.select(schema.FIELDS.names).exceptAll(panel._field_rows(spark, sf_small).select(schema.FIELDS.names)).isEmpty()


def test_institutions(micro):
    rows = {r["inst_id"]: r.asDict() for r in etl.institutions(micro).collect()}
    assert rows["003594"]["name"] == "The Ohio Université"
    assert rows["003594"]["federal"] == 12345  # thousands to dollars, cut off; largest duplicate
    assert rows["003594"]["state_local"] == 0 and rows["003594"]["institutional"] == 0
    assert rows["003594"]["total_rd"] == 20000
    assert rows["000007"]["name"] == "Plain College" and rows["000007"]["year"] == 2016


def test_fields(spark, micro):
    rows = {r["field_code"]: r for r in etl.field_expenditures(micro, dims.taxonomy(spark)).collect()}
    assert set(rows) == {"engineering", "life_sciences", "psychology"}
    assert (rows["engineering"]["federal"], rows["engineering"]["nonfederal"]) == (7000, 0)
    assert (rows["life_sciences"]["federal"], rows["life_sciences"]["nonfederal"]) == (0, 5000)
    assert rows["psychology"]["total"] == 3500 and rows["psychology"]["is_parent"] == 1
    assert etl.unmapped_fields(micro, dims.taxonomy(spark)).collect()[0]["field_name"] == "Alchemy, all"


def test_agencies(micro):
    rows = {(r["inst_id"], r["agency_code"]): r for r in etl.agency_funding(micro).collect()}
    assert rows["003594", "NSF"]["amount"] == 9000
    assert rows["003594", "DOD"]["amount"] == 0 and rows["003594", "DOD"]["agency_name"] == "Dept of Defense"
    assert rows["000007", "USDA"]["amount"] == 0 and len(rows) == 3


def test_discovered_schema(micro):
    rows = {r["questionnaire_no"]: r for r in etl.discovered_schema(micro).collect()}
    assert set(rows) == {"01.a", "01.b", "01.g"}
    assert (rows["01.g"]["first_year"], rows["01.g"]["last_year"], rows["01.g"]["column_name"]) == (2015, 2016, "total_rd")


def test_taxonomy(spark):
    rows = dims.taxonomy(spark).collect()
    assert len(rows) == 46 and sum(r["is_parent"] for r in rows) == 10
    assert len({r["field_code"] for r in rows}) == 46


def test_csv_tables_with_different_columns(spark, tmp_path):
    (tmp_path / "p_2015.csv").write_text("inst_id,name,year,total_rd\n0001,A,2015,5.0\n")
    (tmp_path / "p_2016.csv").write_text("year,inst_id,total_rd,federal\n2016,0001,7,3\n")
    files = [str(tmp_path / f"p_{y}.csv") for y in (2015, 2016)]
    out = tables.refresh_from_csv(spark, files, schema.INSTITUTIONS, str(tmp_path / "table"))
    rows = {r["year"]: r for r in out.collect()}
    assert rows[2015]["inst_id"] == "0001" and rows[2015]["total_rd"] == 5 and rows[2015]["federal"] is None
    assert rows[2016]["federal"] == 3 and rows[2016]["name"] is None
    again = tables.refresh_from_csv(spark, files[:1], schema.INSTITUTIONS, str(tmp_path / "table"))
    assert again.count() == 1  # a refresh replaces everything


def test_checks(spark):
    inst = spark.createDataFrame([("a", 2020, 10, 6), ("b", 2020, 5, 1)], "inst_id string, year int, total_rd long, federal long")
    fields = spark.createDataFrame(
        [("a", 2020, "p", "p", 1, 6, 10), ("a", 2020, "p1", "p", 0, 6, 4), ("a", 2020, "p2", "p", 0, 0, 5),
         ("b", 2020, "q", "q", 1, 1, 5)],
        "inst_id string, year int, field_code string, parent_field string, is_parent int, federal long, total long",
    )
    agencies = spark.createDataFrame([("a", 2020, "NSF", 6)], "inst_id string, year int, agency_code string, amount long")
    broken = {(r["check_name"], r["inst_id"]): (r["expected"], r["found"])
              for r in checks.broken_invariants(inst, fields, agencies).collect()}
    assert broken == {
        ("agencies_sum_to_federal", "b"): (1, None), ("parent_is_sum_of_subfields", "a"): (10, 9),
    }
    lost = checks.broken_invariants(inst.where("inst_id = 'b'"), fields, agencies).collect()
    assert {r["check_name"]: r["found"] for r in lost if r["inst_id"] == "a"} == {
        "parents_sum_to_total": 10, "parents_sum_to_federal": 6, "agencies_sum_to_federal": 6, "parent_is_sum_of_subfields": 9}
    matches = {r["inst_id"]: r["matches"] for r in checks.agency_reconciliation(inst, agencies).collect()}
    assert matches == {"a": True, "b": False}
    assert checks.duplicate_keys(inst.union(inst.limit(1)), "institutions").count() == 1


def test_refused_lines(spark, tmp_path):
    names = [f.name for f in schema.MICRODATA]
    good = "1,Ann,c,TX,2015,01.a,q,r,Total,1.5"
    lines = [good, "2,short", good + ",more", good.replace("1.5", "n/a"), good.replace("2015", "MMXV").replace("1.5", "x"),
             ",Ann,c,TX,,01.a,q,r,Total,", '"3","a, b",c,TX,2015,01.a,q,r,Total,']
    (tmp_path / "s_2015.csv").write_text("\n".join([" , ".join(names), *lines]) + "\n", encoding="latin-1")
    checked = microdata.read_checked(spark, [str(tmp_path / "s_2015.csv")])
    got = sorted((r["line"], r["reason"], r["file_year"]) for r in microdata.refused_lines(checked).collect())
    assert got == sorted([
        ("2,short", "columns", 2015), (good + ",more", "columns", 2015), (lines[3], "data: not a double", 2015),
        (lines[4], "data: not a double", 2015), (lines[4], "year: not an int", 2015),
        (lines[5], "inst_id: missing", 2015), (lines[5], "year: missing", 2015)])
    assert checked.where("line is null").count() == 2 and checked.count() == 7
    plain = microdata.read_microdata(spark, [str(tmp_path / "s_2015.csv")])
    assert plain.columns == [*names, "file_year"] and plain.count() == 7


def test_load_microdata(spark, tmp_path):
    """Files in, three stored tables out; the rules of the panel hold."""
    total = [line("000007", 2015, "01.a", "S", "Federal government", "Total", "7", name="Plain College"),
             line("000007", 2015, "01.g", "S", "Total", "Total", "10", name="Plain College")]
    by_field = [line("000007", 2015, "09", FED, label, "Total", x) for label, x in
                (("Engineering, all", "7"), ("Engineering, civil", "3"), ("Engineering, other", "4"))]
    by_field += [line("000007", 2015, "11", NON, "Psychology, all", "Total", "3")]
    by_agency = [line("000007", 2015, "09", FED, "All", c, "1") for c in dims.AGENCY_NAMES]
    path = tmp_path / "panel_2015.csv"
    path.write_bytes("\n".join([HEADER, *total, *by_field, *by_agency]).encode("latin-1"))
    panel = load.load_microdata(spark, [str(path)], str(tmp_path / "out"))
    assert (panel.inst.count(), panel.fields.count(), panel.agencies.count()) == (1, 4, 7)
    assert checks.broken_invariants(panel.inst, panel.fields, panel.agencies).count() == 0
    again = load.load_microdata(spark, [str(path)], str(tmp_path / "out"))
    assert again.agencies.count() == 7


def test_panels_follow_their_tables(spark, tmp_path, sf_small):
    """A panel built from tables that are rewritten is built again."""
    for name in panel.RAW_TABLES:
        spark.read.parquet(f"{sf_small}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = panel.supplier_panel(spark, str(tmp_path)).inst.count()
    assert panel.supplier_panel(spark, str(tmp_path)).inst.count() == before
    half = spark.read.parquet(f"{sf_small}/lineitem.parquet").where("l_suppkey % 2 = 0")
    half.write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    assert 0 < panel.supplier_panel(spark, str(tmp_path)).inst.count() < before
