"""Every operator as a query over a folder of tables, named by inventory id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, schema
from ..functions import text
from ..operators import (
    agency, audit, checks, etl, events, growth, knn, lookup, patterns, peers, portfolio, rank,
)
from ..session import scratch_dir
from ..sources import keyed, logs, microdata, tables
from ..streaming import events as streams
from . import adhoc, derived
from .load import load_microdata
from .panel import Panel, customer_panel, source_state, supplier_panel

Query = Callable[[SparkSession, str], DataFrame]
Y0, Y1 = 1996, 2001
QUOTA = {"limit": 2, "window_seconds": 86_400}

_queries: dict[str, Query] = {}


def _query(name: str):
    def add(fn: Query) -> Query:
        _queries[name] = fn
        return fn
    return add


def _panel_query(name: str):
    """Register a function of the supplier panel."""
    def add(fn: Callable[[Panel], DataFrame]):
        _queries[name] = lambda spark, sf: fn(supplier_panel(spark, sf))
        return fn
    return add


def _edge_query(name: str, k: int = 10):
    """Register a function of the supplier panel and its benchmark edges."""
    def add(fn: Callable[[Panel, DataFrame], DataFrame]):
        _queries[name] = lambda spark, sf: fn(
            supplier_panel(spark, sf), derived.benchmark_edges(spark, sf, k)
        )
        return fn
    return add


def _customer_query(name: str):
    def add(fn: Callable[[DataFrame], DataFrame]):
        _queries[name] = lambda spark, sf: fn(customer_panel(spark, sf))
        return fn
    return add


def all_queries() -> dict[str, Query]:
    return dict(_queries)


# --- sources, sinks and SQL ---------------------------------------------------


_loaded: dict[tuple, tuple[Panel, list[str]]] = {}


def _microdata_panel(spark: SparkSession, sf: str) -> tuple[Panel, list[str]]:
    """The survey files loaded into tables, once per application, and the files."""
    key = source_state(spark, sf)
    if key not in _loaded:
        files = derived.survey_files(spark, sf)
        _loaded[key] = load_microdata(
            spark, files, scratch_dir(spark, "survey-tables"), derived.taxonomy(spark, sf)), files
    return _loaded[key]


@_query("S1_microdata_institutions")
def _(spark, sf):
    return _microdata_panel(spark, sf)[0].inst


@_query("S1_microdata_fields")
def _(spark, sf):
    return _microdata_panel(spark, sf)[0].fields


@_query("S1_microdata_agencies")
def _(spark, sf):
    return _microdata_panel(spark, sf)[0].agencies


@_query("S1_refused_lines")
def _(spark, sf):
    """How many lines of each file are refused, by reason."""
    checked = microdata.read_checked(spark, derived.malformed_survey_files(spark, sf))
    return microdata.refused_lines(checked).groupBy(F.col("file_year").alias("year"), "reason").agg(
        F.count(F.lit(1)).alias("n_lines"))


@_query("S2_survey_years")
def _(spark, sf):
    return microdata.survey_years(spark, _microdata_panel(spark, sf)[1])


@_panel_query("S4_institutions_table")
def _(p):
    return p.inst


@_panel_query("S4_field_table")
def _(p):
    return p.fields


@_panel_query("S4_agency_table")
def _(p):
    return p.agencies


@_query("S3_S5_S9_csv_round_trip")
def _(spark, sf):
    out = scratch_dir(spark, "csv")
    tables.write_csv(supplier_panel(spark, sf).inst, f"{out}/inst.csv")
    return tables.refresh_from_csv(spark, f"{out}/inst.csv", schema.INSTITUTIONS, f"{out}/table")


@_query("S6_parameterised_sql")
def _(spark, sf):
    adhoc.register(supplier_panel(spark, sf))
    return adhoc.query(
        spark,
        "SELECT inst_id, year, total_rd, federal FROM institutions"
        " WHERE year BETWEEN :y0 AND :y1 AND total_rd > :floor",
        {"y0": Y0, "y1": Y1, "floor": 500_000_000},
    )


@_query("S7_guarded_sql")
def _(spark, sf):
    adhoc.register(supplier_panel(spark, sf))
    return adhoc.guarded_query(spark, """
        WITH best AS (
            SELECT inst_id, year, max(amount) AS top_amount FROM agency_funding GROUP BY inst_id, year
        )
        SELECT i.state, i.year, sum(b.top_amount) AS top_amount, count(*) AS n
        FROM institutions i JOIN best b ON i.inst_id = b.inst_id AND i.year = b.year
        GROUP BY i.state, i.year
    """)


@_panel_query("S8_features")
def _(p):
    return knn.feature_rows(p.inst)


# --- ETL ----------------------------------------------------------------------


@_query("T1_T4_T5_institutions")
def _(spark, sf):
    return etl.institutions(derived.microdata(spark, sf))


@_query("T2_source_labels")
def _(spark, sf):
    lines = derived.microdata(spark, sf).groupBy("row").agg(F.count(F.lit(1)).alias("n_cells"))
    return lines.select("row", text.source_column(F.col("row")).alias("column_name"), "n_cells")


@_query("T3_article_first")
def _(spark, sf):
    names = etl.funding_lines(derived.microdata(spark, sf)).select("inst_id", "inst_name_long").distinct()
    return names.select("inst_id", text.article_first(F.col("inst_name_long")).alias("name"))


@_query("T6_discovered_schema")
def _(spark, sf):
    return etl.discovered_schema(derived.microdata(spark, sf))


@_query("T7_T8_field_expenditures")
def _(spark, sf):
    return etl.field_expenditures(derived.microdata(spark, sf), derived.taxonomy(spark, sf))


@_query("T9_unmapped_fields")
def _(spark, sf):
    return etl.unmapped_fields(derived.with_unknown_fields(derived.microdata(spark, sf)), derived.taxonomy(spark, sf))


@_query("T10_agency_funding")
def _(spark, sf):
    return etl.agency_funding(derived.microdata(spark, sf))


@_panel_query("T11_load_summary")
def _(p):
    return checks.load_summary(p.fields, "field_code")


@_panel_query("T11_agency_summary")
def _(p):
    return checks.load_summary(p.agencies, "agency_code")


@_panel_query("T12_profile")
def _(p):
    return checks.profile(p.inst)


@_panel_query("T13_agency_reconciliation")
def _(p):
    return checks.agency_reconciliation(_with_breaks(p).inst, p.agencies)


def _with_breaks(p: Panel) -> Panel:
    """Every tenth entity reports a unit too much federal money and total."""
    off = F.when(F.col("inst_id").cast("long") % 10 == 0, 1).otherwise(0)
    broken = p.inst.withColumns({"federal": F.col("federal") + off, "total_rd": F.col("total_rd") + off})
    child = F.when((F.col("is_parent") == 0) & (F.col("inst_id").cast("long") % 25 == 0), 1).otherwise(0)
    return Panel(broken, p.fields.withColumn("total", F.col("total") + child), p.agencies)


@_panel_query("T14_invariants")
def _(p):
    return checks.broken_invariants(p.inst, p.fields, p.agencies)


@_panel_query("T14_invariants_planted")
def _(p):
    b = _with_breaks(p)
    return checks.broken_invariants(b.inst, b.fields, b.agencies)


@_panel_query("T14_invariants_orphans")
def _(p):
    b = derived.with_orphans(p)
    return checks.broken_invariants(b.inst, b.fields, b.agencies)


@_panel_query("T14_duplicate_keys")
def _(p):
    return checks.duplicate_keys(p.fields.unionByName(p.fields.where(F.col("year") == Y1)), "field_expenditures")


@_panel_query("T15_latest_snapshot")
def _(p):
    return checks.latest_snapshot(p.agencies)


@_panel_query("T15_latest_institutions")
def _(p):
    return checks.latest_snapshot(p.inst)


@_panel_query("T15_latest_fields")
def _(p):
    return checks.latest_snapshot(p.fields)


@_customer_query("T16_time_windows")
def _(c):
    return lookup.time_windows(c)


@_query("T16_custom_windows")
def _(spark, sf):
    key = F.col("c_custkey")
    asked = spark.read.parquet(f"{sf}/customer.parquet").select(
        key.alias("user_id"), F.when(key % 11 > 0, 1988 + key % 17).cast("int").alias("y0"),
        F.when(key % 13 > 0, 1990 + key * 7 % 19).cast("int").alias("y1"))
    return lookup.custom_windows(asked, customer_panel(spark, sf), first_year=1993)


# --- lookup -------------------------------------------------------------------


@_customer_query("N1_eligible_entities")
def _(c):
    return lookup.eligible_entities(c)


@_customer_query("N2_year_bounds")
def _(c):
    return lookup.year_bounds(c)


@_customer_query("N3_latest_names")
def _(c):
    return lookup.latest_names(c)


@_customer_query("N3_last_known_names")
def _(c):
    return lookup.last_known_names(c)


@_query("N4_resolve_entities")
def _(spark, sf):
    return lookup.resolve_entities(
        derived.asked_names(spark, sf), supplier_panel(spark, sf).inst, derived.nicknames(spark, sf)
    )


@_query("N5_normalise_terms")
def _(spark, sf):
    return lookup.normalise_terms(derived.asked_terms(spark, sf), dims.terms(spark))


# --- rank ---------------------------------------------------------------------


@_panel_query("R1_rank_trend")
def _(p):
    return rank.rank_trend(p.inst, Y0, Y1)


@_customer_query("R1_rank_trend_customers")
def _(c):
    return rank.rank_trend(c, Y0, Y1)


@_panel_query("R2_anchor_view")
def _(p):
    return rank.anchor_view(p.inst, Y1)


@_customer_query("R3_rank_movement")
def _(c):
    return rank.rank_movement(c, Y0, Y1)


@_customer_query("R4_R5_state_ranking")
def _(c):
    return rank.state_ranking(c, Y0, Y1)


@_panel_query("R6_state_band")
def _(p):
    return rank.state_band(rank.state_ranking(p.inst, Y0, Y1))


@_customer_query("R7_state_leaders")
def _(c):
    return rank.state_leaders(rank.state_ranking(c, Y0, Y1))


@_customer_query("R8_state_positions")
def _(c):
    return rank.state_positions(c)


@_panel_query("R9_Q11_metric_band")
def _(p):
    one = p.fields.where((F.col("year") == Y1) & (F.col("field_code") == "economy"))
    band = rank.metric_band(one.select("inst_id", F.col("total").alias("field_rd")), "field_rd")
    return band.join(lookup.latest_names(p.inst), "inst_id")


# --- growth and share ---------------------------------------------------------


@_customer_query("C1_cagr_window")
def _(c):
    return growth.cagr_window(c, Y0, Y1)


@_customer_query("C2_cagr_available")
def _(c):
    return growth.cagr_available(c, Y0, Y1)


@_panel_query("C3_funding_mix")
def _(p):
    return growth.funding_mix(p.inst, Y1)


@_customer_query("C4_federal_share_trend")
def _(c):
    return growth.federal_share_trend(c, Y0, Y1)


@_customer_query("C5_national_median_share")
def _(c):
    return growth.national_median_share(c, Y0, Y1)


@_panel_query("C6_Q7_agency_change")
def _(p):
    return growth.agency_change(p.agencies, Y0, Y1)


@_edge_query("C7_growth_label")
def _(p, edges):
    g = peers.peer_growth(p.inst, edges, Y0, Y1)
    return g.select("target_id", growth.growth_label(F.col("target_cagr"), F.col("peer_avg_cagr")).alias("label"))


@_customer_query("C8_year_on_year")
def _(c):
    return growth.year_on_year(c, Y0, Y1)


@_panel_query("G6_agency_growth")
def _(p):
    return growth.agency_growth(p.agencies, Y0, Y1)


# --- portfolio ----------------------------------------------------------------


@_panel_query("P1_field_portfolio")
def _(p):
    return portfolio.field_portfolio(p.inst, p.fields, Y1)


@_panel_query("P2_P8_field_drilldown")
def _(p):
    return portfolio.field_drilldown(p.fields, Y1)


@_panel_query("P3_field_momentum")
def _(p):
    return portfolio.field_momentum(p.inst, p.fields, Y0, Y1)


@_panel_query("P4_momentum_quadrants")
def _(p):
    return portfolio.momentum_quadrants(portfolio.field_momentum(p.inst, p.fields, Y0, Y1))


@_panel_query("P5_field_highlights")
def _(p):
    return portfolio.field_highlights(
        portfolio.field_momentum(p.inst, p.fields, Y0, Y1), portfolio.field_portfolio(p.inst, p.fields, Y1)
    )


@_edge_query("P6_field_distinctiveness")
def _(p, edges):
    return portfolio.field_distinctiveness(p.fields, edges, Y1)


@_panel_query("P7_callouts")
def _(p):
    return portfolio.callouts(
        portfolio.field_portfolio(p.inst, p.fields, Y1), agency.agency_mix(p.inst, p.agencies, Y1)
    )


@_panel_query("P8_labels")
def _(p):
    labels = F.broadcast(p.fields.sparkSession.createDataFrame(
        [("economy", "Economy"), ("large", "Large Scale"), ("promo", "Promotion")],
        "field_code string, label string",
    ))
    return portfolio.labelled(p.fields, labels).groupBy("label", "is_parent").agg(
        F.sum("total").cast("long").alias("total")
    )


@_panel_query("P9_parents_with_subfields")
def _(p):
    return portfolio.parents_with_subfields(derived.with_childless_parents(p.fields), Y1)


# --- agencies -----------------------------------------------------------------


@_panel_query("G1_agency_mix")
def _(p):
    return agency.agency_mix(p.inst, p.agencies, Y1)


@_panel_query("G2_agency_trend")
def _(p):
    return agency.agency_trend(p.agencies, Y0, Y1)


@_panel_query("G3_concentration")
def _(p):
    return agency.concentration(agency.agency_mix(p.inst, p.agencies, Y1))


@_panel_query("G4_concentration_percentile")
def _(p):
    return agency.concentration_percentile(p.agencies, Y1)


@_edge_query("G5_agency_distinctiveness")
def _(p, edges):
    return agency.agency_distinctiveness(p.agencies, edges, Y1)


# --- peers --------------------------------------------------------------------


def _rounded(edges: DataFrame) -> DataFrame:
    return edges.withColumn("distance", F.round("distance", 6))


@_panel_query("K1_K2_standardised")
def _(p):
    f = knn.feature_rows(p.inst)
    z = f.select("inst_id", knn.standardised(f, schema.METRICS).alias("z"))
    return z.select("inst_id", *[F.round(F.col("z")[i], 6).alias(f"z_{m}") for i, m in enumerate(schema.METRICS)])


@_panel_query("K3_knn_edges")
def _(p):
    return _rounded(knn.knn_edges(knn.feature_rows(p.inst), 10))


@_customer_query("K3_knn_edges_customers")
def _(c):
    return _rounded(knn.knn_edges(knn.feature_rows(c), 10, leaf_size=512))


@_panel_query("K3_served_peers")
def _(p):
    """A model fitted on the newest year answers for every entity's vector of the year before."""
    spark = p.inst.sparkSession
    model = knn.PeerModel.fit(knn.feature_rows(p.inst), scratch_dir(spark, "peer-model"), 10)
    before = p.inst.where(F.col("year") == Y1 - 1).na.drop(how="all", subset=model.metrics)
    return _rounded(model.peers(before))


@_edge_query("K4_peer_gap")
def _(p, edges):
    return peers.peer_gap(knn.feature_rows(p.inst), edges)


@_query("K5_custom_peer_gap")
def _(spark, sf):
    p = supplier_panel(spark, sf)
    own = peers.custom_edges(_latest_prefs(spark, sf), p.inst)
    merged = own.select("target_id", "peer_id").distinct()
    return peers.peer_gap(knn.feature_rows(p.inst), merged)


@_edge_query("K6_peer_trend")
def _(p, edges):
    return peers.peer_trend(p.inst, edges, Y0, Y1)


@_edge_query("K7_peer_growth")
def _(p, edges):
    return peers.peer_growth(p.inst, edges, Y0, Y1)


@_query("K8_custom_peer_growth")
def _(spark, sf):
    p = supplier_panel(spark, sf)
    merged = peers.custom_edges(_latest_prefs(spark, sf), p.inst).select("target_id", "peer_id").distinct()
    return peers.peer_growth(p.inst, merged, Y0, Y1, ranked=False)


@_edge_query("K9_state_edges", k=100)
def _(p, edges):
    return _rounded(peers.state_edges(edges, knn.feature_rows(p.inst)))


@_customer_query("K10_parity_edges")
def _(c):
    return peers.parity_edges(c, Y0)


@_customer_query("K10_parity_trend")
def _(c):
    return peers.parity_trend(c, peers.parity_edges(c, Y0), Y0, Y1)


@_customer_query("K11_parity_growth")
def _(c):
    return peers.parity_growth(c, peers.parity_edges(c, Y0), Y0, Y1)


@_edge_query("K12_peer_band")
def _(p, edges):
    return peers.peer_band(peers.peer_trend(p.inst, edges, Y0, Y1))


def _latest_prefs(spark: SparkSession, sf: str) -> DataFrame:
    return events.latest_preferences(derived.preferences(spark, sf), order=derived.CHANGE_ORDER)


@_query("K13_effective_edges")
def _(spark, sf):
    inst = supplier_panel(spark, sf).inst
    return peers.effective_edges(_latest_prefs(spark, sf), inst, derived.benchmark_edges(spark, sf))


@_edge_query("K14_landing_signal")
def _(p, edges):
    told = portfolio.callouts(
        portfolio.field_portfolio(p.inst, p.fields, Y1), agency.agency_mix(p.inst, p.agencies, Y1)
    )
    return peers.landing_signal(
        rank.rank_movement(p.inst, Y0, Y1), peers.peer_growth(p.inst, edges, Y0, Y1), told
    )


# --- question patterns --------------------------------------------------------

TARGET = "000000000003"
OTHER_TARGET = "000000000052"


@_customer_query("Q1_top_total")
def _(c):
    return patterns.top_total(c, Y1)


@_panel_query("Q2_faster_in_state")
def _(p):
    home = p.inst.where((F.col("inst_id") == TARGET) & (F.col("year") == Y1)).select("state").scalar()
    return patterns.faster_in_state(p.inst, TARGET, home, Y0, Y1)


@_customer_query("Q2_faster_counts")
def _(c):
    return patterns.faster_than_each(c, Y0, Y1)


@_panel_query("Q3_top_field")
def _(p):
    return patterns.top_field(p.inst, p.fields, Y1, "economy")


@_panel_query("Q4_compare_entities")
def _(p):
    return patterns.compare_entities(p.inst, ["000000000001", TARGET, "000000000007"], Y0, Y1)


@_panel_query("Q5_top_agency")
def _(p):
    return patterns.top_agency(p.inst, p.agencies, Y1, "NSF")


@_panel_query("Q6_field_in_states")
def _(p):
    return patterns.field_in_states(p.inst, p.fields, Y1, "economy")


@_panel_query("Q8_subfield_growth")
def _(p):
    return portfolio.subfield_growth(p.fields, Y0, Y1)


@_panel_query("Q9_concentration_band")
def _(p):
    return patterns.concentration_band(p.inst, p.agencies, Y1, TARGET)


@_panel_query("Q9_concentration_ranks")
def _(p):
    return patterns.concentration_ranks(p.inst, p.agencies, Y1)


@_customer_query("Q10_state_totals")
def _(c):
    return patterns.state_totals(c, Y1)


@_panel_query("Q12_more_agency_less_total")
def _(p):
    home = p.inst.where((F.col("inst_id") == OTHER_TARGET) & (F.col("year") == Y1)).select("state").scalar()
    return patterns.more_agency_less_total(p.inst, p.agencies, Y1, "NSF", OTHER_TARGET, home)


@_panel_query("Q13_agency_share_rank")
def _(p):
    return patterns.agency_share_rank(p.inst, p.agencies, Y1)


@_panel_query("Q13_mix_shift")
def _(p):
    return growth.mix_shift(p.inst, Y0, Y1)


@_customer_query("Q14_guarded_growth")
def _(c):
    return growth.guarded_growth(c, Y0, Y1, floor=30_000_000)


@_customer_query("Q14_fastest")
def _(c):
    return patterns.fastest(c, Y0, Y1)


# --- logs, preferences and audit ----------------------------------------------


@_query("E1_usage_log")
def _(spark, sf):
    return logs.parse_usage_log(derived.usage_log_lines(spark, sf))


@_query("E2_dedup_consecutive")
def _(spark, sf):
    kept = events.dedup_consecutive(derived.usage_events(spark, sf))
    return kept.select("event_id", "user_id", "institution")


@_query("E3_quota_flags")
def _(spark, sf):
    return events.quota_flags(derived.usage_events(spark, sf), **QUOTA).drop("ts")


@_query("E4_latest_preferences")
def _(spark, sf):
    return _latest_prefs(spark, sf).withColumn("custom_peers", F.array_join("custom_peers", "|"))


@_query("E5_usage_counts")
def _(spark, sf):
    return events.usage_counts(derived.usage_events(spark, sf), ["event_type", "institution"])


@_query("E5_adoption")
def _(spark, sf):
    return events.adoption(derived.usage_events(spark, sf)).withColumn("day", F.col("day").cast("string"))


@_query("E6_unknown_codes")
def _(spark, sf):
    return audit.unknown_codes(derived.logged_sql(spark, sf), "event_id", "sql")


@_query("E6_first_statement")
def _(spark, sf):
    told = derived.answers(spark, sf)
    return told.select("event_id", audit.first_statement(F.col("answer")).alias("sql"))


# later than any event; no state is dropped, so rows equal the batch form
STREAM = {"late": "3650 days", "idle": None}


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own: state partitions are not merged, so one per core, for streams only."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def _opened(spark: SparkSession, df: DataFrame, order: str) -> DataFrame:
    """``df`` as a stream of several time slices, one micro-batch each."""
    folder, per_slice = derived.ordered_files(df, order)
    return _stream_session(spark).readStream.schema(df.schema).option(
        "maxFilesPerTrigger", per_slice).parquet(folder)


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over all its files; read the rows it appended."""
    out = scratch_dir(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _kept_by_key(spark: SparkSession, stream: DataFrame, keys: list[str], order: Sequence[str], mode: str) -> DataFrame:
    """Run a stream into a table kept by key; its rows."""
    out = scratch_dir(spark, "stream")
    stream.writeStream.outputMode(mode).foreachBatch(keyed.merge_sink(f"{out}/rows", keys, order)).option(
        "checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return keyed.read_keyed(spark, f"{out}/rows", stream)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    timed = derived.usage_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return _opened(spark, timed, "ts")


@_query("E2_dedup_stream")
def _(spark, sf):
    kept = _drained(spark, streams.dedup_consecutive_stream(_event_stream(spark, sf), **STREAM))
    return kept.select("event_id", "user_id", "institution")


@_query("E3_quota_stream")
def _(spark, sf):
    return _drained(spark, streams.quota_stream(_event_stream(spark, sf), **QUOTA, **STREAM)).drop("ts")


@_query("E3_quota_hot_user")
def _(spark, sf):
    busy = derived.usage_events(spark, sf).withColumn(
        "user_id", F.when(F.col("event_id") % 3 > 0, -1).otherwise(F.col("user_id")).cast("long"))
    return events.quota_flags(busy, limit=3, window_seconds=3600).drop("ts")


def _busy(spark: SparkSession, sf: str) -> DataFrame:
    """All events; one user has two thirds of them."""
    return derived.usage_events(spark, sf).withColumns({
        "ts": F.col("ts").cast("timestamp"),
        "user_id": F.when(F.col("event_id") % 3 > 0, -1).otherwise(F.col("user_id")).cast("long")})


def _sunk(spark: SparkSession, stream: DataFrame, sink) -> DataFrame:
    """Run a stream into a sink that writes a folder for each micro-batch; read what it wrote."""
    out = scratch_dir(spark, "stream")
    stream.writeStream.foreachBatch(sink(f"{out}/rows", f"{out}/kept")).option(
        "checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@_query("E2_dedup_hot_stream")
def _(spark, sf):
    kept = _sunk(spark, _opened(spark, _busy(spark, sf), "ts"), streams.dedup_sink)
    return kept.select("event_id", "user_id", "institution")


@_query("E3_quota_hot_stream")
def _(spark, sf):
    return _sunk(spark, _opened(spark, _busy(spark, sf), "ts"),
                 lambda out, state: streams.quota_sink(out, state, limit=3, window_seconds=3600)).drop("ts")


@_query("E4_preferences_upsert")
def _(spark, sf):
    changes = derived.preferences(spark, sf)
    old = F.col("change_id") % 2 == 0
    stored = events.latest_preferences(changes.where(old), order=derived.CHANGE_ORDER)
    kept = events.upsert_preferences(stored, changes.where(~old), derived.CHANGE_ORDER)
    return kept.withColumn("custom_peers", F.array_join("custom_peers", "|"))


@_query("E4_preferences_merged")
def _(spark, sf):
    """Two halves of the changes, the later one merged into the stored table by key."""
    changes = derived.preferences(spark, sf)
    path, keys = scratch_dir(spark, "preferences"), ["user_id", "institution"]
    old = F.col("change_id") % 2 == 0
    for half in (changes.where(old), changes.where(~old)):
        keyed.merge_keyed(spark, path, half, keys, derived.CHANGE_ORDER)
    return keyed.read_keyed(spark, path, changes).withColumn("custom_peers", F.array_join("custom_peers", "|"))


@_query("E4_preferences_stream")
def _(spark, sf):
    changes = derived.preferences(spark, sf)
    stream = _opened(spark, changes, "updated_at")
    kept = _kept_by_key(spark, stream, ["user_id", "institution"], derived.CHANGE_ORDER, "append")
    return kept.select(changes.columns).withColumn("custom_peers", F.array_join("custom_peers", "|"))


@_query("E5_usage_stream")
def _(spark, sf):
    counts = streams.usage_counts_stream(_event_stream(spark, sf), late=STREAM["late"])
    kept = _kept_by_key(spark, counts, ["window_start", "event_type"], ["batch"], "update")
    return kept.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events")


@_query("E5_users_stream")
def _(spark, sf):
    counts = streams.usage_users_stream(_event_stream(spark, sf), late=STREAM["late"])
    kept = streams.distinct_users(
        _kept_by_key(spark, counts, ["window_start", "event_type", "user_id"], ["batch"], "update"))
    return kept.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", "n_users")


# --- column helpers -----------------------------------------------------------


@_panel_query("F1_F2_dollars")
def _(p):
    return p.fields.select(
        "inst_id", "year", "field_code", text.short_dollars(F.col("total")).alias("short"),
        text.full_dollars(F.when(F.col("is_parent") == 1, F.col("federal"))).alias("full"),
    )


@_customer_query("F3_slug")
def _(c):
    return c.select("inst_id", "year", text.slug(F.concat(F.replace("name", F.lit("#"), F.lit(" ")), F.lit(" x"))).alias("slug"))


@_customer_query("F4_constant_columns")
def _(c):
    return text.constant_columns(c.where(F.col("year") == Y1), ["year", *schema.METRICS])
