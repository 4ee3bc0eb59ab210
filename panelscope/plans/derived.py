"""Inputs of the non-panel operators, derived from the same star schema.

Long survey microdata comes from the panel, peer preferences from orders, the
usage log and logged SQL from the event table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, schema
from ..operators import knn
from ..session import scratch_dir, write_scratch
from . import panel

LINES_PER_ORDER = 7
CHANGE_ORDER = ("updated_at", "change_id")
SLICES, FILES_PER_SLICE = 6, 4
SOURCE_LINES = [
    ("01.a", "Federal government", "federal"),
    ("01.b", "State and local government", "state_local"),
    ("01.c", "Business", "business"),
    ("01.d", "Nonprofit organizations", "nonprofit"),
    ("01.e", "Institution funds", "institutional"),
    ("01.f", "All other sources", "other_sources"),
    ("01.g", "Total", "total_rd"),
]


def microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as the long survey form, amounts read as thousands.

    Every fifth name ends in ', The'; some nonprofit cells are empty; a detail
    line (01.1) stands next to the funding lines.
    """
    p = panel.supplier_panel(spark, sf_dir)
    number = F.col("inst_id").cast("long")
    survey_name = F.when(number % 5 == 0, F.concat("name", F.lit(", The"))).otherwise(F.col("name"))

    def cell(no: str, row: str, metric: str):
        data = F.col(metric).cast("double")
        if metric == "nonprofit":
            data = F.when(F.col(metric) % 7 != 0, data)
        return F.struct(F.lit(no).alias("questionnaire_no"), F.lit(row).alias("row"), data.alias("data"))

    cells = [cell(*line) for line in SOURCE_LINES] + [cell("01.1", "Institution funds, detail", "institutional")]
    who = ["inst_id", "inst_name_long", "inst_city", "inst_state_code", "year"]
    lines = (
        p.inst.withColumns({"inst_name_long": survey_name, "inst_city": F.col("city"),
                            "inst_state_code": F.col("state")})
        .select(*who, F.inline(F.array(*cells)))
        .withColumns({"question": F.lit("Expenditures by source"), "column": F.lit(dims.TOTAL_COLUMN)})
    )
    nobody = {c: F.lit(None).cast("string") for c in who[1:4]}
    both = F.array(
        F.struct(F.lit("09").alias("questionnaire_no"), F.lit(dims.FEDERAL_QUESTION).alias("question"),
                 F.col("federal").cast("double").alias("data")),
        F.struct(F.lit("11").alias("questionnaire_no"), F.lit(dims.NONFEDERAL_QUESTION).alias("question"),
                 F.col("nonfederal").cast("double").alias("data")),
    )
    by_field = (
        p.fields.withColumns(nobody).select(*who, F.col("field_name").alias("row"), F.inline(both))
        .where(F.col("data") > 0).withColumn("column", F.lit(dims.TOTAL_COLUMN))
    )
    by_agency = p.agencies.withColumns(nobody).select(
        *who, F.lit("09").alias("questionnaire_no"), F.lit(dims.FEDERAL_QUESTION).alias("question"),
        F.lit(dims.ALL_FIELDS_ROW).alias("row"), F.col("agency_code").alias("column"),
        F.col("amount").cast("double").alias("data"),
    )
    names = schema.MICRODATA.names
    return lines.select(names).unionByName(by_field.select(names)).unionByName(by_agency.select(names))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, code and parent of every part type and type-and-brand; stored, so that its size is known to joins."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type", "p_brand").distinct()
    code = F.lower("p_type")
    levels = F.array(
        F.struct(F.concat("p_type", F.lit(", all")).alias("field_name"), code.alias("field_code"),
                 code.alias("parent_field"), F.lit(1).alias("is_parent")),
        F.struct(F.concat("p_type", F.lit(", "), "p_brand").alias("field_name"),
                 F.concat(code, F.lit("_"), F.lower(F.replace("p_brand", F.lit("Brand#"), F.lit("b")))).alias("field_code"),
                 code.alias("parent_field"), F.lit(0).alias("is_parent")),
    )
    return write_scratch(part.select(F.inline(levels)).distinct(), "taxonomy")


def survey_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The microdata as one packed Latin-1 CSV per year: padded header, tabs behind labels, accents."""
    folder = scratch_dir(spark, "surveys")
    rows = microdata(spark, sf_dir).withColumns({
        "inst_name_long": F.concat(F.lit("Université "), "inst_name_long"),
        "row": F.when(F.col("questionnaire_no").startswith("01."), F.concat("row", F.lit("\t"))).otherwise(F.col("row")),
    })
    p = panel.supplier_panel(spark, sf_dir)
    # a few dozen at most; the panel is stored by year, so each survey reads only its own rows
    years = sorted(r[0] for r in p.inst.select("year").union(p.fields.select("year")).distinct().collect())
    keep = {"header": True, "encoding": "ISO-8859-1", "escape": '"', "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False, "compression": "gzip"}
    paths = []
    for year in years:
        paths.append(f"{folder}/survey_{year}_v2.csv")
        one = rows.where(F.col("year") == year)
        one.toDF(*[f" {c} " for c in one.columns]).write.options(**keep).csv(paths[-1])
    return paths


def malformed_survey_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The survey files and, in each, a bad line for every supplier: short, long, no number, or no id and year."""
    paths = survey_files(spark, sf_dir)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    number, names = F.col("s_suppkey").cast("string"), schema.MICRODATA.names
    for path in paths:
        def cells(inst=number, year=path.split("survey_")[1][:4], data="1.5"):
            given = {"inst_id": inst, "year": F.lit(year), "data": F.lit(data)}
            return F.concat_ws(",", *[given.get(c, F.lit("x")) for c in names])

        line = (F.when(F.col("s_suppkey") % 4 == 0, F.concat(number, F.lit(",only")))
                .when(F.col("s_suppkey") % 4 == 1, F.concat(cells(), F.lit(",one,more")))
                .when(F.col("s_suppkey") % 4 == 2, cells(data="n/a"))
                .otherwise(cells(inst=F.lit(""), year="MMXX")))
        # the lines as they are: nothing is quoted, as nothing holds the separator
        suppliers.select(line.alias(",".join(f" {c} " for c in names))).write.mode("append").options(
            header=True, encoding="ISO-8859-1", sep="\x01", quote="").csv(path)
    return paths


def with_orphans(p: panel.Panel) -> panel.Panel:
    """The panel and, for every seventh entity, field and agency rows of one that has no totals."""
    def copies(df: DataFrame) -> DataFrame:
        some = df.where(F.col("inst_id").cast("long") % 7 == 0)
        return df.unionByName(some.withColumn("inst_id", F.concat(F.lit("9"), F.substring("inst_id", 2, 99))))

    return panel.Panel(p.inst, copies(p.fields), copies(p.agencies))


def with_unknown_fields(micro: DataFrame) -> DataFrame:
    """Each field line again under a label that no taxonomy has, for every fifth entity."""
    unknown = micro.where((F.col("inst_id").cast("long") % 5 == 0) & F.col("row").contains(", Brand"))
    return micro.unionByName(unknown.withColumn("row", F.concat(F.lit("Unlisted "), "row")))


def with_childless_parents(fields: DataFrame) -> DataFrame:
    """The fields and, of every parent, a copy without sub-fields."""
    alone = fields.where("is_parent = 1").withColumns({
        "field_code": F.concat(F.lit("alone_"), "field_code"), "parent_field": F.concat(F.lit("alone_"), "parent_field"),
        "field_name": F.concat(F.lit("Alone "), "field_name")})
    return fields.unionByName(alone)


def asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every part name, and beside some of them a term that is known."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word"), "p_size")
    planted = F.when(F.col("p_size") % 3 == 0, F.lit(" Physics ")).when(F.col("p_size") % 7 == 0, F.lit("NIH"))
    return words.select(F.explode(F.array_compact(F.array("word", planted))).alias("term"))


def ordered_files(df: DataFrame, order: str) -> tuple[str, int]:
    """Write time slices of ``df`` one after the other; the folder, and files per slice.

    File streams take files by their time of writing, so each slice is a
    micro-batch of its own and slices come in order.
    """
    spark = df.sparkSession
    folder, stored = scratch_dir(spark, "slices"), write_scratch(df, "sliced")
    at = F.unix_micros(F.col(order).cast("timestamp"))
    cuts = stored.agg(F.percentile_approx(at, [i / SLICES for i in range(1, SLICES)], 1000)).first()[0] or []
    bounds = sorted(set(cuts))
    for low, high in zip([None, *bounds], [*bounds, None]):
        inside = F.lit(True)
        if low is not None:
            inside &= at > low
        if high is not None:
            inside &= at <= high
        stored.where(inside).repartition(FILES_PER_SLICE).write.mode("append").parquet(folder)
    return folder, FILES_PER_SLICE


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a customer's peer list for the supplier of its first line.

    One aggregate per line number, of which there are seven, so an order never
    collects more than seven suppliers however many rows carry its key.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    per_order = lines.groupBy("l_orderkey").agg(*[
        F.max(F.when(F.col("l_linenumber") == i, F.col("l_suppkey"))).alias(f"line_{i}")
        for i in range(1, LINES_PER_ORDER + 1)
    ])
    keys = F.array_compact(F.array(*[F.col(f"line_{i}") for i in range(1, LINES_PER_ORDER + 1)]))
    names = F.transform(keys, lambda k: F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0")))
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("custom_peers", names)
        .select(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("custom_peers")[0].alias("institution"), "custom_peers",
            F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("change_id"),
        )
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_institution(spark.read.parquet(f"{sf_dir}/events.parquet"))


def with_institution(events: DataFrame) -> DataFrame:
    """Events with the viewed institution, one of four, on view events."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return events.select(
        "event_id", "ts", "user_id", "event_type", k.alias("k"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("Inst "), (k % 4).cast("string")))
        .alias("institution"),
    )


def usage_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log text, with repeated and blank lines."""
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - User: u"), F.col("user_id").cast("string"),
        F.lit(" | Question: "), "event_type", F.lit(" "), F.col("k").cast("string"),
    )
    copies = F.array_compact(F.array(
        line, F.when(F.col("event_id") % 3 == 0, line), F.when(F.col("event_id") % 5 == 0, F.lit("")),
    ))
    return usage_events(spark, sf_dir).select(F.explode(copies).alias("value"))


# codes that SQL in the log uses, some of them unknown
LOGGED_FIELDS = ["cs", "eng_robotics", "life_health", "biology", "soc_politics"]
LOGGED_AGENCIES = ["NSF", "NIH", "DOD"]


def logged_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SQL text per event, filtering on a field and an agency code."""
    field = F.element_at(F.array(*[F.lit(c) for c in LOGGED_FIELDS]), F.col("k") % 5 + 1)
    agency = F.element_at(F.array(*[F.lit(c) for c in LOGGED_AGENCIES]), F.col("k") % 3 + 1)
    return usage_events(spark, sf_dir).select("event_id", F.concat(
        F.lit("SELECT * FROM t WHERE field_code = '"), field, F.lit("' AND AGENCY_CODE='"), agency, F.lit("'")
    ).alias("sql"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated answer per event: fenced, with prose, with a second statement, without any."""
    k, number = F.col("k"), F.col("k").cast("string")
    answer = (
        F.when(k % 4 == 0, F.concat(F.lit("```sql\nSELECT a FROM t WHERE k = "), number, F.lit(";\n```\nThis counts.")))
        .when(k % 4 == 1, F.concat(F.lit("Here it is:\n\n  select a\n-- only these\n  FROM t WHERE k = "), number))
        .when(k % 4 == 2, F.concat(F.lit("WITH x AS (SELECT "), number, F.lit(") SELECT * FROM x; DROP TABLE t;")))
        .otherwise(F.lit("Selecting is not needed.\nThe answer is 4."))
    )
    return usage_events(spark, sf_dir).select("event_id", answer.alias("answer"))


def asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to resolve, one per customer: full names, parts, numbers, nicknames."""
    c = F.col("c_custkey")
    text = (
        F.when(c % 4 == 0, F.concat(F.lit("Supplier#"), F.lpad((c % 150).cast("string"), 9, "0")))
        .when(c % 4 == 1, F.concat(F.lit("SUPPLIER#0000000"), (c % 10).cast("string")))
        .when(c % 4 == 2, F.substring("c_name", -3, 3))
        .otherwise(F.concat(F.lit("s"), (c % 120).cast("string")))
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(text.alias("query"))


def nicknames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nickname for every supplier."""
    key = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("S"), key.cast("string")).alias("alias"), F.substring("s_name", 5, 99).alias("full_name")
    )


_edges: dict[tuple, DataFrame] = {}


def benchmark_edges(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Suppliers' nearest neighbours, written once per application."""
    key = (*panel.source_state(spark, sf_dir), k)
    if key not in _edges:
        features = knn.feature_rows(panel.supplier_panel(spark, sf_dir).inst)
        _edges[key] = write_scratch(knn.knn_edges(features, k), "edges")
    return _edges[key]
