"""The three panel tables, projected from a star schema of orders and shipments.

Suppliers are the entities, nations the states, ship years the survey years.
The six return-flag / line-status pairs stand for the six funding sources, the
line numbers of federal lines for the seven agencies, part type and brand for
field and sub-field. Money is whole cents, so sums do not depend on row order.

Customers by order year make a second, unbalanced panel with names that change
over time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, schema
from ..session import last_change, scratch_dir
from ..sources import tables

# return flag + line status -> source
SOURCE_OF = {
    "AF": "federal", "AO": "state_local", "NF": "business",
    "NO": "nonprofit", "RF": "institutional", "RO": "other_sources",
}
# order priority -> source; other_sources stays 0 for every customer
PRIORITY_SOURCE = {
    "1-URGENT": "federal", "2-HIGH": "state_local", "3-MEDIUM": "business",
    "4-NOT SPECIFIED": "nonprofit", "5-LOW": "institutional",
}
ID_WIDTH = 12
RENAME_YEAR = 1999


@dataclass(frozen=True)
class Panel:
    inst: DataFrame
    fields: DataFrame
    agencies: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_id(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), ID_WIDTH, "0")


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def _sum_where(test: Column, name: str) -> Column:
    return F.sum(F.when(test, F.col("cents")).otherwise(F.lit(0))).cast("long").alias(name)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("city")
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_linenumber",
        F.year("l_shipdate").alias("year"),
        F.concat("l_returnflag", "l_linestatus").alias("src"),
        cents("l_extendedprice").alias("cents"),
    )


def _supplier_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and year: totals, sources and agency amounts."""
    sums = shipments(spark, sf_dir).groupBy("l_suppkey", "year").agg(
        F.sum("cents").cast("long").alias("total_rd"),
        *[_sum_where(F.col("src") == s, m) for s, m in SOURCE_OF.items()],
        *[
            _sum_where((F.col("src") == "AF") & (F.col("l_linenumber") == i + 1), f"agency_{i}")
            for i in range(len(dims.AGENCY_NAMES))
        ],
    )
    supplier = _read(spark, sf_dir, "supplier")
    return (
        sums.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            entity_id("l_suppkey").alias("inst_id"), F.col("s_name").alias("name"), "city", "state",
            "year", *schema.METRICS, *[f"agency_{i}" for i in range(len(dims.AGENCY_NAMES))],
        )
    )


def _agency_rows(wide: DataFrame) -> DataFrame:
    """All seven agencies of every supplier-year, zeros included."""
    items = [
        F.struct(F.lit(code).alias("agency_code"), F.lit(name).alias("agency_name"),
                 F.col(f"agency_{i}").alias("amount"))
        for i, (code, name) in enumerate(dims.AGENCY_NAMES.items())
    ]
    return wide.select("inst_id", "year", F.inline(F.array(*items)))


def _field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-field rows and, as their roll-up, parent rows.

    One shuffle by supplier, year and type serves both levels and the writing.
    """
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    placed = (
        shipments(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_suppkey", "year", "p_type", "p_brand", "src", "cents")
        .repartition("l_suppkey", "year", "p_type")
    )
    sub = placed.groupBy("l_suppkey", "year", "p_type", "p_brand").agg(
        F.sum("cents").cast("long").alias("total"), _sum_where(F.col("src") == "AF", "federal"))
    parent = sub.groupBy("l_suppkey", "year", "p_type").agg(
        F.sum("total").alias("total"), F.sum("federal").alias("federal")
    )
    parent_code = F.lower("p_type")
    sub_code = F.concat(parent_code, F.lit("_"), F.replace("p_brand", F.lit("Brand#"), F.lit("b")))
    sub_label = F.concat("p_type", F.lit(", "), "p_brand")

    def rows(level: DataFrame, code: Column, is_parent: int, label: Column) -> DataFrame:
        return level.select(
            entity_id("l_suppkey").alias("inst_id"), "year", code.alias("field_code"),
            parent_code.alias("parent_field"), F.lit(is_parent).alias("is_parent"),
            label.alias("field_name"), "federal",
            (F.col("total") - F.col("federal")).alias("nonfederal"), "total",
        )

    return rows(sub, sub_code, 0, sub_label).unionByName(
        rows(parent, parent_code, 1, F.concat("p_type", F.lit(", all")))
    )


def _customer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority",
        cents("o_totalprice").alias("cents"),
    )
    sums = orders.groupBy("o_custkey", "year").agg(
        F.sum("cents").cast("long").alias("total_rd"),
        *[_sum_where(F.col("o_orderpriority") == p, m) for p, m in PRIORITY_SOURCE.items()],
    )
    renamed = (F.col("o_custkey") % 3 == 0) & (F.col("year") >= RENAME_YEAR)
    customer = _read(spark, sf_dir, "customer")
    return (
        sums.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            entity_id("o_custkey").alias("inst_id"),
            F.when(renamed, F.concat("c_name", F.lit(", "), "c_mktsegment")).otherwise(F.col("c_name"))
            .alias("name"),
            "city", "state", "year",
            *[F.col(m) if m != "other_sources" else F.lit(0).cast("long").alias(m)
              for m in schema.METRICS],
        )
    )


def build_supplier_panel(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    """Write the supplier panel; one scan feeds two tables, a second the fields."""
    tables.write_table(_supplier_years(spark, sf_dir), f"{out_dir}/supplier_years")
    tables.write_table(_field_rows(spark, sf_dir), f"{out_dir}/field_expenditures", even=True)


def build_customer_panel(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    tables.write_table(_customer_years(spark, sf_dir), f"{out_dir}/institutions")


RAW_TABLES = ("lineitem", "orders", "supplier", "customer", "part", "nation", "region")

_built: dict[tuple, str] = {}


def source_state(spark: SparkSession, sf_dir: str) -> tuple[str, str, int]:
    """Application, folder, and when its tables last changed: the key of what is built from them."""
    changed = last_change(spark, [f"{sf_dir}/{t}.parquet" for t in RAW_TABLES])
    return spark.sparkContext.applicationId, sf_dir, changed


def _once(spark: SparkSession, sf_dir: str, kind: str, build) -> str:
    key = (*source_state(spark, sf_dir), kind)
    if key not in _built:
        out = scratch_dir(spark, f"panel-{kind}")
        build(spark, sf_dir, out)
        _built[key] = out
    return _built[key]


def supplier_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """The supplier panel, written once per application and read from there."""
    out = _once(spark, sf_dir, "suppliers", build_supplier_panel)
    wide = tables.read_table(spark, f"{out}/supplier_years")
    fields = tables.read_table(spark, f"{out}/field_expenditures")
    return Panel(
        inst=wide.select(schema.INSTITUTIONS.names),
        fields=fields.select(schema.FIELDS.names),
        agencies=_agency_rows(wide),
    )


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _once(spark, sf_dir, "customers", build_customer_panel)
    return tables.read_table(spark, f"{out}/institutions").select(schema.INSTITUTIONS.names)
