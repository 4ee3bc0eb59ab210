"""Reference SQL (DuckDB) for every query that plain SQL can express.

Written from the definition of each operator over the raw tables, not from the
Spark code: all-pairs joins where Spark prunes, plain windows where Spark cuts
groups into buckets.
"""

from __future__ import annotations

from panelscope import dims

Y0, Y1 = 1996, 2001
TARGET = "000000000003"
OTHER_TARGET = "000000000052"
METRICS = ["total_rd", "federal", "state_local", "business", "nonprofit", "institutional", "other_sources"]
AGENCIES = [
    ("DOD", "Dept of Defense"), ("DOE", "Dept of Energy"), ("HHS", "HHS (incl. NIH)"),
    ("NASA", "NASA"), ("NSF", "NSF"), ("USDA", "USDA"), ("Other agencies", "Other Federal"),
]
SOURCE_OF = {"federal": "AF", "state_local": "AO", "business": "NF",
             "nonprofit": "NO", "institutional": "RF", "other_sources": "RO"}
PRIORITY_OF = {"federal": "1-URGENT", "state_local": "2-HIGH", "business": "3-MEDIUM",
               "nonprofit": "4-NOT SPECIFIED", "institutional": "5-LOW"}
TERMS = [("physics", "field", "phys_physics"), ("nih", "agency", "HHS")]


def pct(a: str, b: str, places: int = 1) -> str:
    return f"round(CAST({a} AS DOUBLE) * CAST(100 AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {places})"


def raw_pct(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) * CAST(100 AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def cagr(start: str, end: str, years: str | int) -> str:
    return (f"CASE WHEN {start} > 0 AND {end} >= 0 AND {years} > 0 THEN "
            f"round((power(CAST({end} AS DOUBLE) / CAST({start} AS DOUBLE), CAST(1 AS DOUBLE) / {years}) - 1) * 100, 1) END")


def at(year: int, value: str = "total_rd") -> str:
    return f"max(CASE WHEN year = {year} THEN {value} END)"


def tenths(a: str, b: str) -> str:
    return f"CAST(round({pct(a, b)} * 10) AS BIGINT)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def as_int(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


def _sum(test: str) -> str:
    return big(f"sum(CASE WHEN {test} THEN cents ELSE 0 END)")


# --- the panel, straight from the raw tables ----------------------------------

PLACE = """
place AS (SELECT n_nationkey, n_name AS state, r_name AS city
          FROM nation JOIN region ON n_regionkey = r_regionkey)"""

INST = f"""
ship AS (SELECT l_suppkey, l_partkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year,
                l_returnflag || l_linestatus AS src,
                CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
inst AS MATERIALIZED (SELECT lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS inst_id, min(s_name) AS name,
                min(city) AS city, min(state) AS state, year, {big('sum(cents)')} AS total_rd,
                {', '.join(f"{_sum(f"src = '{code}'")} AS {m}" for m, code in SOURCE_OF.items())}
         FROM ship JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey
         GROUP BY l_suppkey, year)"""

FIELDS = f"""
cells AS MATERIALIZED (SELECT lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS inst_id, year, p_type, p_brand,
                 {big('sum(cents)')} AS total, {_sum("src = 'AF'")} AS federal
          FROM ship JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, year, p_type, p_brand),
fields AS MATERIALIZED (
    SELECT inst_id, year, lower(p_type) || '_' || replace(p_brand, 'Brand#', 'b') AS field_code,
           lower(p_type) AS parent_field, 0 AS is_parent, p_type || ', ' || p_brand AS field_name,
           federal, total - federal AS nonfederal, total FROM cells
    UNION ALL
    SELECT inst_id, year, lower(p_type), lower(p_type), 1, p_type || ', all',
           {big('sum(federal)')}, {big('sum(total - federal)')}, {big('sum(total)')}
    FROM cells GROUP BY inst_id, year, p_type)"""

AGENCY = f"""
agency_dim(line, agency_code, agency_name) AS (VALUES {', '.join(f"({i + 1}, '{c}', '{n}')" for i, (c, n) in enumerate(AGENCIES))}),
agencies AS MATERIALIZED (SELECT i.inst_id, i.year, d.agency_code, d.agency_name, {big('coalesce(sum(s.cents), 0)')} AS amount
             FROM inst i CROSS JOIN agency_dim d
             LEFT JOIN ship s ON lpad(CAST(s.l_suppkey AS VARCHAR), 12, '0') = i.inst_id AND s.year = i.year
                             AND s.src = 'AF' AND s.l_linenumber = d.line
             GROUP BY i.inst_id, i.year, d.agency_code, d.agency_name)"""

CUSTOMERS = f"""
bought AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority,
                  CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
inst AS MATERIALIZED (SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS inst_id,
                CASE WHEN o_custkey % 3 = 0 AND year >= 1999 THEN min(c_name) || ', ' || min(c_mktsegment)
                     ELSE min(c_name) END AS name,
                min(city) AS city, min(state) AS state, year, {big('sum(cents)')} AS total_rd,
                {', '.join(f"{_sum(f"o_orderpriority = '{p}'")} AS {m}" for m, p in PRIORITY_OF.items())},
                CAST(0 AS BIGINT) AS other_sources
         FROM bought JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey
         GROUP BY o_custkey, year)"""

NEWEST = "newest AS (SELECT max(year) AS y FROM inst)"
NAMES = "names AS (SELECT inst_id, name FROM inst WHERE year = (SELECT y FROM newest))"


def supplier(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([PLACE, INST, FIELDS, AGENCY, NEWEST, NAMES, *ctes]) + " " + body


def customer(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([PLACE, CUSTOMERS, NEWEST, NAMES, *ctes]) + " " + body


# --- shared pieces ------------------------------------------------------------

FEATURES = f"""
feat AS (SELECT inst_id, name, state, {', '.join(f'coalesce({m}, 0) AS {m}' for m in METRICS)}
         FROM inst WHERE year = (SELECT y FROM newest) AND coalesce({', '.join(METRICS)}) IS NOT NULL)"""

Z = f"""
logs AS (SELECT inst_id, {', '.join(f'ln(1 + CAST({m} AS DOUBLE)) AS {m}' for m in METRICS)} FROM feat),
stat AS (SELECT {', '.join(f'avg({m}) AS a_{m}, stddev_pop({m}) AS s_{m}' for m in METRICS)} FROM logs),
z AS (SELECT inst_id, {', '.join(f'({m} - a_{m}) / CASE WHEN s_{m} > 0 THEN s_{m} ELSE 1 END AS {m}' for m in METRICS)}
      FROM logs, stat)"""


def edges(k: int, name: str = "edges") -> str:
    square = " + ".join(f"(t.{m} - p.{m}) * (t.{m} - p.{m})" for m in METRICS)
    return f"""
dist AS (SELECT t.inst_id AS target_id, p.inst_id AS peer_id, sqrt({square}) AS distance
         FROM z t JOIN z p ON t.inst_id <> p.inst_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance, peer_id) AS rank FROM dist)
          WHERE rank <= {k})"""


KNN = [FEATURES, Z, edges(10)]

RATES_AVAILABLE = f"""
ends AS (SELECT inst_id, min(year) AS first_year, max(year) AS last_year, arg_min(total_rd, year) AS s,
                arg_max(total_rd, year) AS e FROM inst WHERE year BETWEEN {Y0} AND {Y1} GROUP BY inst_id),
rates AS (SELECT inst_id, first_year, last_year, s, e, {cagr('s', 'e', '(last_year - first_year)')} AS cagr
          FROM ends WHERE last_year > first_year AND s > 0)"""

RATES_WINDOW = f"""
ends AS (SELECT inst_id, {at(Y0)} AS s, {at(Y1)} AS e FROM inst WHERE year IN ({Y0}, {Y1}) GROUP BY inst_id),
rates AS (SELECT inst_id, s, e, {cagr('s', 'e', Y1 - Y0)} AS cagr FROM ends)"""


def peer_growth(ranked: bool = True) -> str:
    """Needs edges and rates."""
    place = as_int("count(*) FILTER (WHERE p.cagr > coalesce(t.cagr, 0)) + 1") if ranked else "CAST(NULL AS INTEGER)"
    return f"""
growth AS (SELECT g.target_id, coalesce(max(t.cagr), 0) AS target_cagr,
                  coalesce(round(sum(CAST(round(p.cagr * 10) AS BIGINT)) / CAST(count(p.cagr) AS DOUBLE)) / 10, 0) AS peer_avg_cagr,
                  {place} AS growth_rank,
                  {big('count(p.cagr) + CASE WHEN max(t.cagr) IS NULL THEN 0 ELSE 1 END')} AS total_in_group
           FROM edges g LEFT JOIN rates p ON p.inst_id = g.peer_id LEFT JOIN rates t ON t.inst_id = g.target_id
           GROUP BY g.target_id)"""


PORTFOLIO = f"""
portfolio AS (SELECT f.inst_id, field_code, field_name, f.federal, nonfederal, f.total,
                     {pct('f.total', 'i.total_rd')} AS portfolio_share, {pct('f.federal', 'f.total')} AS federal_pct
              FROM fields f JOIN inst i ON f.inst_id = i.inst_id AND f.year = i.year
              WHERE f.year = {Y1} AND is_parent = 1)"""
MIX = f"""
mix AS (SELECT a.inst_id, agency_code, agency_name, amount, {pct('amount', 'federal')} AS pct_of_federal
        FROM agencies a JOIN inst i ON a.inst_id = i.inst_id AND a.year = i.year WHERE a.year = {Y1})"""
MOMENTUM = f"""
grown AS (SELECT inst_id, field_code, max(CASE WHEN year = {Y1} THEN field_name END) AS field_name,
                 {at(Y0, 'total')} AS s, {at(Y1, 'total')} AS total
          FROM fields WHERE is_parent = 1 AND year IN ({Y0}, {Y1}) GROUP BY inst_id, field_code),
momentum AS (SELECT g.inst_id, field_code, field_name, total, {pct('total', 'total_rd')} AS portfolio_share,
                    CASE WHEN total > 0 THEN {cagr('s', 'total', Y1 - Y0)} END AS cagr
             FROM grown g JOIN inst i ON g.inst_id = i.inst_id AND i.year = {Y1} WHERE total IS NOT NULL)"""
CALLOUTS = """
tf AS (SELECT * FROM portfolio QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY total DESC, field_code) = 1),
ta AS (SELECT * FROM mix QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY amount DESC, agency_code) = 1),
callouts AS (SELECT coalesce(tf.inst_id, ta.inst_id) AS inst_id, replace(field_name, ', all', '') AS top_field,
                    portfolio_share AS top_field_pct, agency_name AS top_agency, pct_of_federal AS top_agency_pct
             FROM tf FULL JOIN ta ON tf.inst_id = ta.inst_id)"""
STATE_RANKING = f"""
ends2 AS (SELECT inst_id, arg_max(state, year) AS state, arg_max(name, year) AS name, {at(Y1)} AS total_rd,
                 {at(Y0)} AS s, {at(Y1, 'federal')} AS fed FROM inst WHERE year IN ({Y0}, {Y1}) GROUP BY inst_id),
ranking AS (SELECT state, inst_id, name, total_rd,
                   {big('rank() OVER (PARTITION BY state ORDER BY total_rd DESC)')} AS state_rank,
                   {cagr('s', 'total_rd', Y1 - Y0)} AS cagr, {pct('fed', 'total_rd')} AS federal_pct,
                   {pct('total_rd', 'sum(total_rd) OVER (PARTITION BY state)')} AS market_share
            FROM ends2 WHERE total_rd > 0)"""
TREND = f"""
trend AS (SELECT inst_id, year, total_rd, {big('rank() OVER (PARTITION BY year ORDER BY total_rd DESC)')} AS national_rank
          FROM inst WHERE year BETWEEN {Y0} AND {Y1})"""
MOVEMENT = """
movement AS (SELECT inst_id, arg_max(national_rank, year) AS current_rank, arg_min(national_rank, year) AS start_rank,
                    arg_min(national_rank, year) - arg_max(national_rank, year) AS rank_change,
                    arg_max(total_rd, year) AS current_rd, arg_min(total_rd, year) AS start_rd,
                    arg_max(total_rd, year) - arg_min(total_rd, year) AS rd_change
             FROM trend GROUP BY inst_id)"""
TOP_SHARES = f"""
tops AS (SELECT inst_id, {pct('max(amount)', 'sum(amount)')} AS top_agency_pct, {big('sum(amount)')} AS total_federal,
                {big('count(DISTINCT agency_code)')} AS num_agencies
         FROM agencies WHERE year = {Y1} GROUP BY inst_id HAVING sum(amount) > 0)"""
ELIGIBLE = """
eligible AS (SELECT n.inst_id, n.name, g.n_years FROM names n JOIN (
    SELECT inst_id, CAST(count(DISTINCT year) AS BIGINT) AS n_years FROM inst, newest
    WHERE year BETWEEN y - 5 AND y GROUP BY inst_id
    HAVING count(DISTINCT year) >= 5 AND sum(total_rd) > 0) g ON n.inst_id = g.inst_id)"""
PREFERENCES = """
linekeys AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber),
orderlines AS (SELECT l_orderkey, list(s_name ORDER BY l_linenumber) AS peers
               FROM linekeys JOIN supplier ON k = s_suppkey GROUP BY l_orderkey),
changes AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, peers[1] AS institution, peers AS custom_peers,
                   o_orderdate AS updated_at, o_orderkey AS change_id
            FROM orderlines JOIN orders ON l_orderkey = o_orderkey),
prefs AS (SELECT * FROM changes
          QUALIFY row_number() OVER (PARTITION BY user_id, institution ORDER BY updated_at DESC, change_id DESC) = 1),
asked AS (SELECT user_id, n.inst_id AS target_id, custom_peers FROM prefs JOIN names n ON institution = n.name),
own AS (SELECT DISTINCT a.user_id, a.target_id, e.inst_id AS peer_id
        FROM (SELECT user_id, target_id, unnest(custom_peers) AS peer_name FROM asked) a
        JOIN eligible e ON e.name = a.peer_name WHERE e.inst_id <> a.target_id)"""


def gap(edge_table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT t.inst_id AS target_id, '{m}' AS metric, round(CAST(max(t.{m}) AS DOUBLE), 2) AS my_val,"
        f" round(CAST(sum(p.{m}) * 100 AS DOUBLE) / count(*)) / 100 AS peer_avg,"
        f" round(CAST((max(t.{m}) * count(*) - sum(p.{m})) * 100 AS DOUBLE) / count(*)) / 100 AS gap"
        f" FROM {edge_table} g JOIN feat t ON t.inst_id = g.target_id JOIN feat p ON p.inst_id = g.peer_id"
        f" GROUP BY t.inst_id" for m in METRICS)


def peer_trend(edge_table: str = "edges") -> str:
    return f"""
members AS (SELECT target_id, peer_id FROM {edge_table} UNION SELECT DISTINCT target_id, target_id FROM {edge_table}),
ptrend AS (SELECT m.target_id, i.inst_id, coalesce(n.name, i.name) AS name, i.year, i.total_rd,
                  i.inst_id = m.target_id AS is_target
           FROM members m JOIN inst i ON i.inst_id = m.peer_id LEFT JOIN names n ON n.inst_id = i.inst_id
           WHERE i.year BETWEEN {Y0} AND {Y1})"""


PARITY = f"""
start AS (SELECT inst_id, total_rd FROM inst WHERE year = {Y0}),
edges AS (SELECT target_id, peer_id, {as_int('rank')} AS rank, distance FROM (
    SELECT t.inst_id AS target_id, p.inst_id AS peer_id, CAST(abs(p.total_rd - t.total_rd) AS DOUBLE) AS distance,
           row_number() OVER (PARTITION BY t.inst_id ORDER BY abs(p.total_rd - t.total_rd), p.inst_id) AS rank
    FROM start t JOIN start p ON p.inst_id <> t.inst_id
     AND p.total_rd BETWEEN CAST(t.total_rd AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE))
                        AND CAST(t.total_rd AS DOUBLE) * (CAST(1 AS DOUBLE) + CAST(0.2 AS DOUBLE))) WHERE rank <= 8)"""


def distinctive(rows: str, code: str, amount: str) -> str:
    return f"""
shares AS (SELECT inst_id, {code}, {tenths(amount, f'sum({amount}) OVER (PARTITION BY inst_id)')} AS share FROM {rows}),
peer AS (SELECT target_id, {code}, round(sum(share) / CAST(count(share) AS DOUBLE)) / 10 AS mean
         FROM edges JOIN shares ON peer_id = inst_id GROUP BY target_id, {code})
SELECT coalesce(s.inst_id, p.target_id) AS target_id, coalesce(s.{code}, p.{code}) AS {code},
       coalesce(s.share, 0) / CAST(10 AS DOUBLE) AS your_pct, coalesce(p.mean, 0) AS peer_avg_pct,
       round(coalesce(s.share, 0) / CAST(10 AS DOUBLE) - coalesce(p.mean, 0), 1) AS difference
FROM shares s FULL JOIN peer p ON s.inst_id = p.target_id AND s.{code} = p.{code}"""


def _mismatch(check: str, metric: str, table: str, where: str, value: str) -> str:
    return f"""
    SELECT '{check}' AS check_name, inst_id, year, CAST(NULL AS VARCHAR) AS code, i.{metric} AS expected, s.found
    FROM bi i FULL JOIN (SELECT inst_id, year, {big(f'sum({value})')} AS found FROM {table} WHERE {where} GROUP BY inst_id, year) s
      USING (inst_id, year) WHERE i.{metric} IS DISTINCT FROM s.found"""


def invariants(inst: str, fields: str, agencies: str = "SELECT * FROM agencies") -> str:
    return supplier(f"""
    {_mismatch('parents_sum_to_total', 'total_rd', 'bf', 'is_parent = 1', 'total')} UNION ALL
    {_mismatch('parents_sum_to_federal', 'federal', 'bf', 'is_parent = 1', 'federal')} UNION ALL
    {_mismatch('agencies_sum_to_federal', 'federal', 'ba', 'true', 'amount')} UNION ALL
    SELECT 'parent_is_sum_of_subfields', inst_id, year, parent_field, max(total) FILTER (WHERE is_parent = 1),
           {big('sum(total) FILTER (WHERE is_parent = 0)')}
    FROM bf GROUP BY inst_id, year, parent_field
    HAVING sum(total) FILTER (WHERE is_parent = 0) IS DISTINCT FROM max(total) FILTER (WHERE is_parent = 1)
       AND sum(total) FILTER (WHERE is_parent = 0) IS NOT NULL""", f"bi AS ({inst})", f"bf AS ({fields})",
        f"ba AS ({agencies})")


BREAK = "CASE WHEN CAST(inst_id AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END"
BROKEN_INST = f"SELECT inst_id, year, total_rd + {BREAK} AS total_rd, federal + {BREAK} AS federal FROM inst"
BROKEN_FIELDS = """SELECT inst_id, year, field_code, parent_field, is_parent, federal,
    total + CASE WHEN is_parent = 0 AND CAST(inst_id AS BIGINT) % 25 = 0 THEN 1 ELSE 0 END AS total FROM fields"""

EVENTS = """
ev AS (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
us AS (SELECT *, CASE WHEN event_type = 'view' THEN 'Inst ' || CAST(k % 4 AS VARCHAR) END AS institution FROM ev)"""


def events(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([EVENTS, *ctes]) + " " + body


INST_COLUMNS = "inst_id, name, city, state, year, " + ", ".join(METRICS)
SOURCE_LABELS = {
    "01.a": ("Federal government", "federal"), "01.b": ("State and local government", "state_local"),
    "01.c": ("Business", "business"), "01.d": ("Nonprofit organizations", "nonprofit"),
    "01.e": ("Institution funds", "institutional"), "01.f": ("All other sources", "other_sources"),
    "01.g": ("Total", "total_rd"),
}
LOGGED_FIELDS = ["cs", "eng_robotics", "life_health", "biology", "soc_politics"]
LOGGED_AGENCIES = ["NSF", "NIH", "DOD"]
FIELD_CODES = dims.field_codes()


def _suggest(code: str) -> str:
    family = [c for c in FIELD_CODES if c.startswith(code.split("_")[0] + "_") or c == code.split("_")[0]]
    return ", ".join(family or FIELD_CODES)


def _source_rows() -> str:
    rows = [f"('{label}', '{col}')" for label, col in SOURCE_LABELS.values()]
    return ", ".join(rows)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    accent = "CASE WHEN CAST(inst_id AS BIGINT) % 5 = 0 THEN 'The Université ' || name ELSE 'Université ' || name END AS name"
    sql["S2_survey_years"] = supplier("SELECT DISTINCT 'survey_' || CAST(year AS VARCHAR) || '_v2.csv' AS file, year FROM inst")
    sql["T15_latest_institutions"] = supplier(f"SELECT {INST_COLUMNS} FROM inst WHERE year = (SELECT y FROM newest)")
    sql["T15_latest_fields"] = supplier("SELECT * FROM fields WHERE year = (SELECT y FROM newest)")
    sql["T16_custom_windows"] = customer("""
        SELECT user_id, y0, y1, CAST(least(s, e - 1) AS INTEGER) AS start_year, CAST(e AS INTEGER) AS end_year FROM (
            SELECT *, least(greatest(coalesce(y1, y), 1994), y) AS e, least(greatest(coalesce(y0, 1993), 1993), y - 1) AS s
            FROM (SELECT c_custkey AS user_id, CAST(CASE WHEN c_custkey % 11 > 0 THEN 1988 + c_custkey % 17 END AS INTEGER) AS y0,
                         CAST(CASE WHEN c_custkey % 13 > 0 THEN 1990 + c_custkey * 7 % 19 END AS INTEGER) AS y1 FROM customer), newest)""")
    sql["S4_institutions_table"] = supplier(f"SELECT {INST_COLUMNS} FROM inst")
    sql["S4_field_table"] = supplier("SELECT * FROM fields")
    sql["S4_agency_table"] = supplier("SELECT * FROM agencies")
    sql["S3_S5_S9_csv_round_trip"] = supplier(f"SELECT {INST_COLUMNS} FROM inst")
    sql["S6_parameterised_sql"] = supplier(
        f"SELECT inst_id, year, total_rd, federal FROM inst WHERE year BETWEEN {Y0} AND {Y1} AND total_rd > 500000000")
    sql["S7_guarded_sql"] = supplier(f"""
        SELECT i.state, i.year, {big('sum(b.top)')} AS top_amount, {big('count(*)')} AS n
        FROM inst i JOIN (SELECT inst_id, year, max(amount) AS top FROM agencies GROUP BY inst_id, year) b
          ON i.inst_id = b.inst_id AND i.year = b.year GROUP BY i.state, i.year""")
    sql["S8_features"] = supplier("SELECT * FROM feat", FEATURES)

    money = ", ".join(
        f"{m} * 1000 AS {m}" if m != "nonprofit"
        else "CASE WHEN nonprofit % 7 = 0 THEN 0 ELSE nonprofit * 1000 END AS nonprofit" for m in METRICS)
    moved = "CASE WHEN CAST(inst_id AS BIGINT) % 5 = 0 THEN 'The ' || name ELSE name END AS name"
    sql["T1_T4_T5_institutions"] = supplier(f"SELECT inst_id, {moved}, city, state, year, {money} FROM inst")
    sql["S1_microdata_institutions"] = sql["T1_T4_T5_institutions"].replace(moved, accent)
    sql["T2_source_labels"] = supplier(f"""
        SELECT row, regexp_replace(regexp_replace(lower(row), '[^\\w\\s]', '', 'g'), '\\s+', '_', 'g') AS column_name, n_cells
        FROM (SELECT row, {big('count(*)')} AS n_cells FROM (
                SELECT field_name AS row FROM fields WHERE federal > 0 UNION ALL
                SELECT field_name FROM fields WHERE nonfederal > 0 UNION ALL
                SELECT 'All' FROM agencies UNION ALL
                SELECT 'Institution funds, detail' FROM inst) GROUP BY row)
        UNION ALL
        SELECT l.row, l.col, {big('count(*)')} FROM inst CROSS JOIN (VALUES {_source_rows()}) l(row, col) GROUP BY ALL""")
    sql["T3_article_first"] = supplier(f"SELECT DISTINCT inst_id, {moved} FROM inst")
    sql["T6_discovered_schema"] = supplier(f"""
        SELECT l.no AS questionnaire_no, l.row, min(year) AS first_year, max(year) AS last_year,
               {big('count(DISTINCT year)')} AS n_years, l.col AS column_name
        FROM inst CROSS JOIN (VALUES {', '.join(f"('{no}', '{a}', '{b}')" for no, (a, b) in SOURCE_LABELS.items())}) l(no, row, col)
        GROUP BY l.no, l.row, l.col""")
    sql["T7_T8_field_expenditures"] = supplier("""
        SELECT inst_id, year, field_code, parent_field, is_parent, field_name, federal * 1000 AS federal,
               nonfederal * 1000 AS nonfederal, total * 1000 AS total FROM fields WHERE total > 0""")
    unlisted = "SELECT 'Unlisted ' || field_name AS field_name, year FROM fields WHERE is_parent = 0 AND CAST(inst_id AS BIGINT) % 5 = 0"
    sql["T9_unmapped_fields"] = supplier(f"""
        SELECT field_name, min(year) AS first_year, max(year) AS last_year, {big('count(*)')} AS n_rows FROM (
            {unlisted} AND federal > 0 UNION ALL {unlisted} AND nonfederal > 0) GROUP BY field_name""")
    sql["T10_agency_funding"] = supplier(
        "SELECT inst_id, year, agency_code, agency_name, amount * 1000 AS amount FROM agencies")
    sql["T11_load_summary"] = supplier(f"""
        SELECT {big('count(*)')} AS n_rows, min(year) AS first_year, max(year) AS last_year,
               {big('count(DISTINCT inst_id)')} AS n_entities, {big('count(DISTINCT field_code)')} AS n_codes,
               {big('count(*) FILTER (WHERE is_parent = 1)')} AS n_parent_rows,
               {big('count(*) FILTER (WHERE is_parent = 0)')} AS n_sub_rows FROM fields""")
    sql["T11_agency_summary"] = supplier(f"""
        SELECT {big('count(*)')} AS n_rows, min(year) AS first_year, max(year) AS last_year,
               {big('count(DISTINCT inst_id)')} AS n_entities, {big('count(DISTINCT agency_code)')} AS n_codes FROM agencies""")
    sql["T12_profile"] = supplier(f"""
        SELECT {big('count(*)')} AS total_rows, {big('count(DISTINCT inst_id)')} AS institutions, min(year) AS first_year,
               max(year) AS last_year, '$' || format('{{:,}}', CAST(floor(avg(total_rd)) AS BIGINT)) AS avg_total_rd,
               '$' || format('{{:,}}', max(total_rd)) AS max_total_rd FROM inst""")
    sql["T13_agency_reconciliation"] = supplier(f"""
        SELECT i.inst_id, i.year, i.federal, a.agency_total, i.federal IS NOT DISTINCT FROM a.agency_total AS matches
        FROM bi i LEFT JOIN (SELECT inst_id, year, {big('sum(amount)')} AS agency_total FROM agencies GROUP BY inst_id, year) a
          ON a.inst_id = i.inst_id AND a.year = i.year""", f"bi AS ({BROKEN_INST})")
    sql["T14_invariants"] = invariants("SELECT * FROM inst", "SELECT * FROM fields")
    sql["T14_invariants_planted"] = invariants(BROKEN_INST, BROKEN_FIELDS)
    orphans = "SELECT * FROM {t} UNION ALL SELECT * REPLACE ('9' || substr(inst_id, 2) AS inst_id) FROM {t} WHERE CAST(inst_id AS BIGINT) % 7 = 0"
    sql["T14_invariants_orphans"] = invariants(
        "SELECT * FROM inst", orphans.format(t="fields"), orphans.format(t="agencies"))
    sql["T14_duplicate_keys"] = supplier(f"""
        SELECT inst_id, year, field_code, CAST(2 AS BIGINT) AS n_rows FROM fields WHERE year = {Y1}""")
    sql["T15_latest_snapshot"] = supplier("SELECT * FROM agencies WHERE year = (SELECT max(year) FROM agencies)")
    sql["T16_time_windows"] = customer(
        "SELECT t.w AS time_window, y - t.n AS start_year, y AS end_year FROM newest, (VALUES ('5-Year', 5), ('10-Year', 10)) t(w, n)")

    sql["N1_eligible_entities"] = customer("SELECT inst_id, name, n_years FROM eligible", ELIGIBLE)
    sql["N2_year_bounds"] = customer("SELECT y AS max_year, 2010 AS min_year FROM newest")
    sql["N3_latest_names"] = customer("SELECT * FROM names")
    sql["N3_last_known_names"] = customer("SELECT inst_id, arg_max(name, year) AS name FROM inst GROUP BY inst_id")
    hit = """SELECT q.query, c.inst_id, c.name, {p} AS priority, c.total_rd FROM texts q JOIN cur c ON {on}"""
    sql["N4_resolve_entities"] = supplier(f"""
        SELECT t.query, h.inst_id, h.name, h.priority FROM (SELECT DISTINCT query FROM texts) t LEFT JOIN (
            SELECT * FROM (
                {hit.format(p=1, on='c.name = q.query')} UNION ALL
                {hit.format(p=2, on="contains(lower(c.name), lower(q.full_name))")} UNION ALL
                {hit.format(p=3, on="contains(lower(c.name), lower(q.query))")})
            QUALIFY row_number() OVER (PARTITION BY query ORDER BY priority, total_rd DESC, inst_id) = 1) h
        ON h.query = t.query""",
        "cur AS (SELECT inst_id, name, total_rd FROM inst WHERE year = (SELECT y FROM newest))",
        """questions AS (SELECT DISTINCT CASE c_custkey % 4
            WHEN 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0')
            WHEN 1 THEN 'SUPPLIER#0000000' || CAST(c_custkey % 10 AS VARCHAR)
            WHEN 2 THEN right(c_name, 3) ELSE 's' || CAST(c_custkey % 120 AS VARCHAR) END AS query FROM customer)""",
        """texts AS (SELECT query, substr(s_name, 5) AS full_name FROM questions
            LEFT JOIN supplier ON upper(query) = 'S' || CAST(s_suppkey AS VARCHAR))""")
    sql["N5_normalise_terms"] = f"""
        WITH words AS (SELECT unnest(string_split(p_name, ' ')) AS word, p_size FROM part),
        asked AS (SELECT word AS term FROM words UNION SELECT ' Physics ' FROM words WHERE p_size % 3 = 0
                  UNION SELECT 'NIH' FROM words WHERE p_size % 3 <> 0 AND p_size % 7 = 0)
        SELECT term, kind, code FROM asked
        LEFT JOIN (VALUES {', '.join(f"('{t}', '{k}', '{c}')" for t, k, c in TERMS)}) d(known, kind, code) ON lower(trim(term)) = known"""

    sql["R1_rank_trend"] = supplier("SELECT * FROM trend", TREND)
    sql["R1_rank_trend_customers"] = customer("SELECT * FROM trend", TREND)
    sql["R2_anchor_view"] = supplier("""
        SELECT s.lo AS from_rank, s.hi AS to_rank, r.n AS total_institutions, r.national_rank, r.inst_id, r.total_rd, FALSE AS is_target
        FROM shown s JOIN ranked r ON r.national_rank = s.mark WHERE NOT (s.lo = s.mark AND s.hi = s.mark)
        UNION ALL SELECT national_rank, national_rank, n, national_rank, inst_id, total_rd, TRUE FROM ranked""",
        f"""ranked AS (SELECT inst_id, total_rd, {big('rank() OVER (ORDER BY total_rd DESC)')} AS national_rank,
                   {big('count(*) OVER ()')} AS n FROM inst WHERE year = {Y1})""",
        "size AS (SELECT max(n) AS n FROM ranked)",
        "marks(mark) AS (VALUES (1), (10), (25), (50), (100), (250), (500), (750))",
        f"""lows AS (SELECT DISTINCT {big('mark + d')} AS lo FROM (SELECT mark FROM marks UNION SELECT n FROM size), range(-2, 4) t(d), size
                  WHERE mark + d BETWEEN 1 AND n)""",
        f"segments AS (SELECT lo, {big('coalesce(lead(lo) OVER (ORDER BY lo) - 1, n)')} AS hi FROM lows, size)",
        """near AS (SELECT lo, hi, mark, row_number() OVER (PARTITION BY lo, mark < lo ORDER BY abs(mark - lo)) AS i
              FROM segments JOIN marks ON abs(mark - lo) > 2)""",
        """shown AS (SELECT lo, hi, mark FROM near WHERE i <= 2 UNION SELECT lo, hi, 1 FROM segments
             UNION SELECT lo, hi, n FROM segments, size)""")
    sql["R3_rank_movement"] = customer("SELECT * FROM movement", TREND, MOVEMENT)
    sql["R4_R5_state_ranking"] = customer("SELECT * FROM ranking", STATE_RANKING)
    sql["R6_state_band"] = supplier("""
        SELECT m.state, t.target_rank, m.state_rank, m.inst_id, m.name, m.total_rd, m.cagr, m.federal_pct
        FROM (SELECT DISTINCT state, state_rank AS target_rank FROM ranking) t
        JOIN ranking m ON m.state = t.state AND m.state_rank BETWEEN t.target_rank - 3 AND t.target_rank + 3""", STATE_RANKING)
    sql["R7_state_leaders"] = customer(f"""
        SELECT state, {as_int('row_number() OVER (PARTITION BY state ORDER BY state_rank, inst_id)')} AS place, state_rank,
               inst_id, name, total_rd, cagr FROM ranking QUALIFY place <= 10""", STATE_RANKING)
    sql["R8_state_positions"] = customer(f"""
        SELECT inst_id, state, total_rd,
               {big('row_number() OVER (PARTITION BY state ORDER BY total_rd DESC, inst_id)')} AS state_position,
               {big('count(*) OVER (PARTITION BY state)')} AS state_total FROM inst WHERE year = (SELECT y FROM newest)""")
    sql["R9_Q11_metric_band"] = supplier(f"""
        SELECT m.inst_id, t.r AS target_rank, m.field_rd, m.r AS metric_rank, {big('m.n')} AS total_institutions,
               CASE WHEN m.r = t.r THEN 1 ELSE 0 END AS is_selected, names.name
        FROM (SELECT DISTINCT r FROM ranked) t JOIN ranked m ON m.r BETWEEN t.r - 8 AND t.r + 7
        JOIN names ON names.inst_id = m.inst_id""",
        f"""ranked AS (SELECT inst_id, total AS field_rd, {big('rank() OVER (ORDER BY total DESC)')} AS r, count(*) OVER () AS n
                    FROM fields WHERE year = {Y1} AND field_code = 'economy' AND total > 0)""")

    sql["C1_cagr_window"] = customer("SELECT inst_id, s AS start_value, e AS end_value, cagr FROM rates", RATES_WINDOW)
    sql["C2_cagr_available"] = customer(
        "SELECT inst_id, first_year, last_year, s AS start_value, e AS end_value, cagr FROM rates", RATES_AVAILABLE)
    sources = METRICS[1:]
    sql["C3_funding_mix"] = supplier(" UNION ALL ".join(
        f"SELECT inst_id, '{s}' AS source, {s} AS amount, {pct(s, 'total_rd')} AS share_pct FROM inst WHERE year = {Y1}"
        for s in sources))
    sql["C4_federal_share_trend"] = customer(
        f"SELECT inst_id, year, {pct('federal', 'total_rd')} AS federal_pct FROM inst WHERE year BETWEEN {Y0} AND {Y1}")
    sql["C5_national_median_share"] = customer(
        f"SELECT year, round(median({raw_pct('federal', 'total_rd')}), 1) AS median_pct FROM inst"
        f" WHERE year BETWEEN {Y0} AND {Y1} AND total_rd > 0 GROUP BY year")
    sql["C6_Q7_agency_change"] = supplier(f"""
        SELECT inst_id, agency_code, agency_name, a AS funding_start, b AS funding_end, b - a AS change,
               CASE WHEN a > 0 THEN round((CAST(b AS DOUBLE) / a - 1) * 100, 1) END AS pct_change
        FROM (SELECT inst_id, agency_code, agency_name, coalesce({at(Y0, 'amount')}, 0) AS a, coalesce({at(Y1, 'amount')}, 0) AS b
              FROM agencies WHERE year IN ({Y0}, {Y1}) GROUP BY inst_id, agency_code, agency_name)""")
    sql["C7_growth_label"] = supplier("""
        SELECT target_id, CASE WHEN target_cagr > peer_avg_cagr + 5 THEN 'faster' WHEN target_cagr < peer_avg_cagr - 5
               THEN 'slower' ELSE 'aligned' END AS label FROM growth""", *KNN, RATES_AVAILABLE, peer_growth())
    sql["C8_year_on_year"] = customer(f"""
        SELECT a.inst_id, a.year, a.total_rd AS value, b.total_rd AS previous, a.total_rd - b.total_rd AS change,
               {pct('(a.total_rd - b.total_rd)', 'b.total_rd')} AS yoy_pct
        FROM inst a LEFT JOIN inst b ON b.inst_id = a.inst_id AND b.year = a.year - 1 AND b.year >= {Y0}
        WHERE a.year BETWEEN {Y0} AND {Y1}""")
    sql["G6_agency_growth"] = supplier(f"""
        SELECT *, round((CAST(last_amount AS DOUBLE) / first_amount - 1) * 100, 0) AS change_pct FROM (
            SELECT inst_id, agency_code, agency_name, min(year) AS first_year, max(year) AS last_year,
                   arg_min(amount, year) AS first_amount, arg_max(amount, year) AS last_amount
            FROM agencies WHERE year BETWEEN {Y0} AND {Y1} GROUP BY inst_id, agency_code, agency_name)
        WHERE first_amount > 0 AND last_year > first_year""")

    sql["P1_field_portfolio"] = supplier("SELECT * FROM portfolio", PORTFOLIO)
    # a parent field is its own parent, so its total is found among the rows of one group
    sql["P2_P8_field_drilldown"] = supplier(f"""
        SELECT inst_id, parent_field, field_code, field_name,
               upper(substr(split_part(field_name, ', ', 2), 1, 1)) || lower(substr(split_part(field_name, ', ', 2), 2)) AS discipline,
               federal, nonfederal, total, {pct('federal', 'total')} AS federal_pct, {pct('total', 'parent_total')} AS share_of_parent
        FROM (SELECT *, max(CASE WHEN is_parent = 1 THEN total END) OVER (PARTITION BY inst_id, parent_field) AS parent_total
              FROM fields WHERE year = {Y1}) WHERE is_parent = 0""")
    sql["P3_field_momentum"] = supplier("SELECT * FROM momentum", MOMENTUM)
    sql["P4_momentum_quadrants"] = supplier("""
        SELECT m.inst_id, field_code, portfolio_share, cagr, mid_share, mid_cagr,
               CASE WHEN portfolio_share >= mid_share AND cagr >= mid_cagr THEN 'Core Strengths'
                    WHEN portfolio_share < mid_share AND cagr >= mid_cagr THEN 'Emerging'
                    WHEN portfolio_share >= mid_share THEN 'Established Base' ELSE 'Smaller Base' END AS quadrant,
               greatest(total, 100000) AS bubble
        FROM momentum m JOIN (SELECT inst_id, median(portfolio_share) AS mid_share, median(cagr) AS mid_cagr
                              FROM momentum WHERE cagr IS NOT NULL GROUP BY inst_id) d ON d.inst_id = m.inst_id
        WHERE cagr IS NOT NULL""", MOMENTUM)
    first = "(list({v} ORDER BY {o}))[1]"
    sql["P5_field_highlights"] = supplier(f"""
        SELECT coalesce(a.inst_id, b.inst_id) AS inst_id, fastest_field, fastest_cagr, largest_field, largest_share,
               most_federal_field, most_federal_pct
        FROM (SELECT inst_id, {first.format(v='field_code', o='cagr DESC, field_code')} AS fastest_field, max(cagr) AS fastest_cagr,
                     {first.format(v='field_code', o='total DESC, field_code')} AS largest_field,
                     {first.format(v='portfolio_share', o='total DESC, field_code')} AS largest_share
              FROM momentum WHERE cagr IS NOT NULL GROUP BY inst_id) a
        FULL JOIN (SELECT inst_id, {first.format(v='field_code', o='federal_pct DESC, field_code')} AS most_federal_field,
                          max(federal_pct) AS most_federal_pct FROM portfolio WHERE federal_pct IS NOT NULL GROUP BY inst_id) b
        ON a.inst_id = b.inst_id""", MOMENTUM, PORTFOLIO)
    fields_now = f"(SELECT * FROM fields WHERE year = {Y1} AND is_parent = 1)"
    sql["P6_field_distinctiveness"] = supplier("", *KNN, distinctive(fields_now, "field_code", "total"))
    sql["P7_callouts"] = supplier("SELECT * FROM callouts", PORTFOLIO, MIX, CALLOUTS)
    sql["P8_labels"] = supplier(f"""
        SELECT CASE field_code WHEN 'economy' THEN 'Economy' WHEN 'large' THEN 'Large Scale' WHEN 'promo' THEN 'Promotion'
               ELSE field_name END AS label, is_parent, {big('sum(total)')} AS total FROM fields GROUP BY 1, 2""")
    sql["P9_parents_with_subfields"] = supplier(f"""
        SELECT inst_id, field_code, field_name, total FROM fields p WHERE year = {Y1} AND is_parent = 1
          AND EXISTS (SELECT 1 FROM fields s WHERE s.inst_id = p.inst_id AND s.year = p.year AND s.is_parent = 0
                      AND s.parent_field = p.field_code)""")

    sql["G1_agency_mix"] = supplier("SELECT * FROM mix", MIX)
    sql["G2_agency_trend"] = supplier(f"SELECT * FROM agencies WHERE year BETWEEN {Y0} AND {Y1}")
    sql["G3_concentration"] = supplier("""
        SELECT inst_id, round(squares / CAST(100 AS DOUBLE)) / 10000 AS hhi, round((CAST(1 AS DOUBLE) - hhi) / (CAST(1 AS DOUBLE) - CAST(1 AS DOUBLE) / 7) * 100, 1) AS diversification_score,
               top_agency, top_agency_pct
        FROM (SELECT m.inst_id, CAST(sum(CAST(round(m.pct_of_federal * 10) AS BIGINT) * CAST(round(m.pct_of_federal * 10) AS BIGINT)) AS DOUBLE)
                     / CAST(1000000 AS DOUBLE) AS hhi, CAST(sum(CAST(round(m.pct_of_federal * 10) AS BIGINT) * CAST(round(m.pct_of_federal * 10) AS BIGINT)) AS DOUBLE) AS squares, max(ta.agency_name) AS top_agency, max(ta.pct_of_federal) AS top_agency_pct
              FROM mix m JOIN ta ON ta.inst_id = m.inst_id GROUP BY m.inst_id)""", PORTFOLIO, MIX, CALLOUTS)
    sql["G4_concentration_percentile"] = supplier(f"""
        SELECT t.inst_id, t.top_agency_pct,
               {as_int('round(CAST((SELECT count(*) FROM tops o WHERE o.top_agency_pct < t.top_agency_pct) AS DOUBLE) / (SELECT count(*) FROM tops) * 100)')} AS national_percentile,
               {big('(SELECT count(*) FROM tops)')} AS total_institutions FROM tops t""", TOP_SHARES)
    sql["G5_agency_distinctiveness"] = supplier(
        "", *KNN, distinctive(f"(SELECT * FROM agencies WHERE year = {Y1})", "agency_code", "amount"))

    sql["K1_K2_standardised"] = supplier(
        f"SELECT inst_id, {', '.join(f'round({m}, 6) AS z_{m}' for m in METRICS)} FROM z", FEATURES, Z)
    knn_rows = f"SELECT target_id, peer_id, {as_int('rank')} AS rank, round(distance, 6) AS distance FROM edges"
    sql["K3_knn_edges"] = supplier(knn_rows, *KNN)
    sql["K3_knn_edges_customers"] = customer(knn_rows, *KNN)
    asked = ", ".join(f"(ln(1 + CAST(coalesce({m}, 0) AS DOUBLE)) - a_{m}) / CASE WHEN s_{m} > 0 THEN s_{m} ELSE 1 END AS {m}" for m in METRICS)
    square = " + ".join(f"(t.{m} - p.{m}) * (t.{m} - p.{m})" for m in METRICS)
    sql["K3_served_peers"] = supplier(f"""
        SELECT target_id, peer_id, {as_int('rank')} AS rank, round(distance, 6) AS distance FROM (
            SELECT t.inst_id AS target_id, p.inst_id AS peer_id, sqrt({square}) AS distance,
                   row_number() OVER (PARTITION BY t.inst_id ORDER BY sqrt({square}), p.inst_id) AS rank
            FROM (SELECT inst_id, {asked} FROM inst, stat WHERE year = {Y1 - 1} AND coalesce({', '.join(METRICS)}) IS NOT NULL) t
            JOIN z p ON t.inst_id <> p.inst_id) WHERE rank <= 10""", FEATURES, Z)
    sql["K4_peer_gap"] = supplier(gap("edges"), *KNN)
    custom = [ELIGIBLE, PREFERENCES, "edges AS (SELECT DISTINCT target_id, peer_id FROM own)"]
    sql["K5_custom_peer_gap"] = supplier(gap("edges"), FEATURES, *custom)
    sql["K6_peer_trend"] = supplier("SELECT * FROM ptrend", *KNN, peer_trend())
    sql["K7_peer_growth"] = supplier("SELECT * FROM growth", *KNN, RATES_AVAILABLE, peer_growth())
    sql["K8_custom_peer_growth"] = supplier("SELECT * FROM growth", *custom, RATES_AVAILABLE, peer_growth(False))
    sql["K9_state_edges"] = supplier(f"""
        SELECT target_id, peer_id, {as_int('row_number() OVER (PARTITION BY target_id ORDER BY e.rank)')} AS rank,
               round(distance, 6) AS distance
        FROM edges e JOIN feat t ON t.inst_id = target_id JOIN feat p ON p.inst_id = peer_id AND p.state = t.state
        QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY e.rank) <= 10""", FEATURES, Z, edges(100))
    sql["K10_parity_edges"] = customer("SELECT * FROM edges", PARITY)
    sql["K10_parity_trend"] = customer(
        "SELECT target_id, inst_id, year, total_rd, is_target FROM ptrend", PARITY, peer_trend())
    sql["K11_parity_growth"] = customer(f"""
        SELECT g.target_id, max(t.cagr) AS target_growth,
               round(sum(CAST(round(p.cagr * 10) AS BIGINT)) / nullif(CAST(count(p.cagr) AS DOUBLE), 0)) / 10 AS peer_avg,
               {as_int('count(*) FILTER (WHERE p.cagr > t.cagr) + 1')} AS growth_rank, {big('count(*) + 1')} AS total_peers
        FROM edges g LEFT JOIN rates p ON p.inst_id = g.peer_id LEFT JOIN rates t ON t.inst_id = g.target_id
        GROUP BY g.target_id""", PARITY, RATES_WINDOW)
    sql["K12_peer_band"] = supplier("""
        SELECT target_id, year, round(CAST(sum(total_rd) * 100 AS DOUBLE) / count(*)) / 100 AS peer_mean, min(total_rd) AS peer_min, max(total_rd) AS peer_max
        FROM ptrend WHERE NOT is_target GROUP BY target_id, year""", *KNN, peer_trend())
    sql["K13_effective_edges"] = supplier("""
        SELECT user_id, target_id, peer_id, 'custom' AS peer_mode FROM own UNION ALL
        SELECT a.user_id, a.target_id, e.peer_id, 'benchmark' FROM asked a JOIN edges e ON e.target_id = a.target_id
        WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = a.user_id AND o.target_id = a.target_id)""",
        *KNN, ELIGIBLE, PREFERENCES)
    sql["K14_landing_signal"] = supplier("""
        SELECT inst_id, sig.signal AS signal, sig.value AS value, sig.reference AS reference,
               CASE WHEN sig.signal = 'largest_field' THEN top_field END AS field
        FROM (SELECT m.inst_id, c.top_field, CASE
            WHEN growth_rank <= 3 THEN {'signal': 'growth_leader', 'value': CAST(growth_rank AS DOUBLE), 'reference': CAST(total_in_group AS DOUBLE)}
            WHEN growth_rank > total_in_group - 3 THEN {'signal': 'growth_laggard', 'value': CAST(growth_rank AS DOUBLE), 'reference': CAST(total_in_group AS DOUBLE)}
            WHEN round(target_cagr - peer_avg_cagr, 1) >= 2 THEN {'signal': 'growth_faster', 'value': round(target_cagr - peer_avg_cagr, 1), 'reference': CAST(peer_avg_cagr AS DOUBLE)}
            WHEN round(target_cagr - peer_avg_cagr, 1) <= -2 THEN {'signal': 'growth_slower', 'value': abs(round(target_cagr - peer_avg_cagr, 1)), 'reference': CAST(peer_avg_cagr AS DOUBLE)}
            WHEN rank_change >= 10 THEN {'signal': 'rank_rose', 'value': CAST(rank_change AS DOUBLE), 'reference': CAST(current_rank AS DOUBLE)}
            WHEN rank_change <= -10 THEN {'signal': 'rank_fell', 'value': CAST(-rank_change AS DOUBLE), 'reference': CAST(current_rank AS DOUBLE)}
            WHEN top_field_pct <> 0 THEN {'signal': 'largest_field', 'value': CAST(top_field_pct AS DOUBLE), 'reference': CAST(NULL AS DOUBLE)}
            END AS sig
          FROM movement m LEFT JOIN growth g ON g.target_id = m.inst_id LEFT JOIN callouts c ON c.inst_id = m.inst_id)""",
        *KNN, RATES_AVAILABLE, peer_growth(), TREND, MOVEMENT, PORTFOLIO, MIX, CALLOUTS)

    rank_of = "CAST(rank() OVER (ORDER BY {v} DESC) AS BIGINT) AS {out}"
    sql["Q1_top_total"] = customer(f"""
        SELECT inst_id, name, total_rd, {rank_of.format(v='total_rd', out='national_rank')} FROM inst WHERE year = {Y1}
        ORDER BY total_rd DESC, inst_id LIMIT 10""")
    home = f"(SELECT state FROM inst WHERE inst_id = '{TARGET}' AND year = {Y1})"
    sql["Q2_faster_in_state"] = supplier(f"""
        SELECT r.inst_id, n.name, s AS rd_start, e AS rd_end, cagr,
               (SELECT cagr FROM rates WHERE inst_id = '{TARGET}') AS target_cagr
        FROM rates r JOIN names n ON n.inst_id = r.inst_id JOIN inst i ON i.inst_id = r.inst_id AND i.year = {Y1}
        WHERE s > 0 AND e > 0 AND i.state = {home} AND r.inst_id <> '{TARGET}'
          AND cagr > (SELECT cagr FROM rates WHERE inst_id = '{TARGET}')""", RATES_WINDOW)
    sql["Q2_faster_counts"] = customer(f"""
        SELECT inst_id, state, cagr, {big('rank() OVER (PARTITION BY state ORDER BY cagr DESC) - 1')} AS n_faster
        FROM rates JOIN (SELECT inst_id, arg_max(state, year) AS state FROM inst WHERE year IN ({Y0}, {Y1}) GROUP BY inst_id) h
        USING (inst_id) WHERE s > 0 AND e > 0""", RATES_WINDOW)
    one_field = f"fields f JOIN inst i ON i.inst_id = f.inst_id AND i.year = f.year WHERE f.year = {Y1} AND field_code = 'economy'"
    sql["Q3_top_field"] = supplier(f"""
        SELECT i.inst_id, name, total AS field_rd, {pct('total', 'total_rd')} AS pct_of_portfolio,
               {rank_of.format(v='total', out='field_rank')} FROM {one_field} ORDER BY total DESC, i.inst_id LIMIT 10""")
    sql["Q4_compare_entities"] = supplier(f"""
        SELECT inst_id, name, year, total_rd, federal FROM inst
        WHERE inst_id IN ('000000000001', '{TARGET}', '000000000007') AND year BETWEEN {Y0} AND {Y1}""")
    one_agency = f"agencies a JOIN inst i ON i.inst_id = a.inst_id AND i.year = a.year WHERE a.year = {Y1} AND agency_code = 'NSF'"
    sql["Q5_top_agency"] = supplier(f"""
        SELECT i.inst_id, name, amount, {pct('amount', 'federal')} AS pct_of_federal,
               {rank_of.format(v='amount', out='agency_rank')} FROM {one_agency} ORDER BY amount DESC, i.inst_id LIMIT 10""")
    sql["Q6_field_in_states"] = supplier(f"""
        SELECT i.inst_id, state, total AS field_rd, {pct('total', 'total_rd')} AS pct_of_portfolio,
               {big('rank() OVER (PARTITION BY state ORDER BY total DESC)')} AS state_rank, name FROM {one_field}""")
    sql["Q8_subfield_growth"] = supplier(f"""
        SELECT *, rd_end - rd_start AS absolute_change, {cagr('rd_start', 'rd_end', Y1 - Y0)} AS cagr FROM (
            SELECT inst_id, field_code, field_name, parent_field, {at(Y0, 'total')} AS rd_start, {at(Y1, 'total')} AS rd_end
            FROM fields WHERE is_parent = 0 AND year IN ({Y0}, {Y1}) GROUP BY inst_id, field_code, field_name, parent_field)
        WHERE rd_start > 0 AND rd_end > 0""")
    places = f"tops.inst_id, name, top_agency_pct, total_federal, num_agencies, {rank_of.format(v='top_agency_pct', out='concentration_rank')}"
    own = f"(SELECT top_agency_pct FROM tops WHERE inst_id = '{TARGET}')"
    sql["Q9_concentration_band"] = supplier(f"""
        SELECT {places} FROM tops LEFT JOIN names ON names.inst_id = tops.inst_id WHERE tops.inst_id = '{TARGET}' OR top_agency_pct >= {own} - 5 AND top_agency_pct <= {own} + 5""", TOP_SHARES)
    sql["Q9_concentration_ranks"] = supplier(f"SELECT {places} FROM tops LEFT JOIN names ON names.inst_id = tops.inst_id", TOP_SHARES)
    sql["Q10_state_totals"] = customer(f"""
        SELECT state, {big('sum(total_rd)')} AS total_state_rd, {big('count(DISTINCT inst_id)')} AS num_institutions,
               round(CAST(sum(total_rd) AS DOUBLE) / count(DISTINCT inst_id), 0) AS avg_per_institution
        FROM inst WHERE year = {Y1} GROUP BY state""")
    other_home = f"(SELECT state FROM inst WHERE inst_id = '{OTHER_TARGET}' AND year = {Y1})"
    mine = f"(SELECT {{c}} FROM {one_agency} AND i.inst_id = '{OTHER_TARGET}')"
    sql["Q12_more_agency_less_total"] = supplier(f"""
        SELECT i.inst_id, name, total_rd, amount, {pct('amount', 'federal')} AS pct_of_federal,
               {mine.format(c='total_rd')} AS target_total_rd, {mine.format(c='amount')} AS target_amount
        FROM {one_agency} AND i.state = {other_home} AND amount > {mine.format(c='amount')} AND total_rd < {mine.format(c='total_rd')}""")
    sql["Q13_agency_share_rank"] = supplier(f"""
        SELECT inst_id, agency_code, amount, pct_of_federal,
               {big('rank() OVER (PARTITION BY agency_code ORDER BY pct_of_federal DESC)')} AS share_rank
        FROM mix WHERE pct_of_federal IS NOT NULL""", MIX)
    sql["Q13_mix_shift"] = supplier(" UNION ALL ".join(
        f"SELECT inst_id, '{s}' AS source, {at(Y0, pct(s, 'total_rd'))} AS start_pct, {at(Y1, pct(s, 'total_rd'))} AS end_pct,"
        f" round({at(Y1, pct(s, 'total_rd'))} - {at(Y0, pct(s, 'total_rd'))}, 1) AS shift_pp"
        f" FROM inst WHERE year IN ({Y0}, {Y1}) GROUP BY inst_id" for s in sources))
    sql["Q14_guarded_growth"] = customer(
        "SELECT inst_id, s AS start_value, e AS end_value, cagr FROM rates WHERE s >= 30000000 AND e IS NOT NULL", RATES_WINDOW)
    sql["Q14_fastest"] = customer(f"""
        SELECT inst_id, s AS start_value, e AS end_value, cagr, {rank_of.format(v='cagr', out='growth_rank')} FROM rates
        WHERE s >= 1000000 AND e IS NOT NULL ORDER BY cagr DESC, inst_id LIMIT 10""", RATES_WINDOW)

    sql["E1_usage_log"] = events("""
        SELECT DISTINCT date_trunc('millisecond', ts) AS ts, 'u' || CAST(user_id AS VARCHAR) AS username,
               event_type || ' ' || CAST(k AS VARCHAR) AS question FROM us""")
    sql["E2_dedup_consecutive"] = events("""
        SELECT event_id, user_id, institution FROM us WHERE institution IS NOT NULL
        QUALIFY lag(institution) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM institution""")
    sql["E3_quota_flags"] = events("""
        SELECT r.event_id, r.user_id, w.s AS window_start_us,
               row_number() OVER (PARTITION BY r.user_id, w.s ORDER BY r.t, r.event_id) <= 2 AS accepted
        FROM req r JOIN win w ON w.user_id = r.user_id AND r.t BETWEEN w.s AND w.s + 86400000000""",
        "req AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM us)",
        """win AS (SELECT user_id, min(t) AS s FROM req GROUP BY user_id UNION ALL
             SELECT w.user_id, min(r.t) FROM win w JOIN req r ON r.user_id = w.user_id AND r.t > w.s + 86400000000 GROUP BY w.user_id)""")
    sql["E2_dedup_stream"], sql["E3_quota_stream"] = sql["E2_dedup_consecutive"], sql["E3_quota_flags"]
    sql["E3_quota_hot_user"] = sql["E3_quota_flags"].replace("86400000000", "3600000000").replace("<= 2 AS", "<= 3 AS").replace(
        "SELECT event_id, user_id, epoch_us(ts)", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN -1 ELSE user_id END AS user_id, epoch_us(ts)")
    sql["E3_quota_hot_stream"] = sql["E3_quota_hot_user"]
    sql["E2_dedup_hot_stream"] = events("""
        SELECT event_id, user_id, institution FROM hot WHERE institution IS NOT NULL
        QUALIFY lag(institution) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM institution""",
        "hot AS (SELECT event_id, ts, institution, CASE WHEN event_id % 3 > 0 THEN -1 ELSE user_id END AS user_id FROM us)")
    sql["E4_latest_preferences"] = supplier("""
        SELECT user_id, institution, array_to_string(custom_peers, '|') AS custom_peers, updated_at, change_id FROM prefs""",
        ELIGIBLE, PREFERENCES)
    sql["E5_usage_counts"] = events(f"""
        SELECT event_type, institution, {big('count(*)')} AS n_events, {big('count(DISTINCT user_id)')} AS n_users
        FROM us GROUP BY event_type, institution""")
    sql["E5_adoption"] = events(f"""
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, {big('count(*)')} AS n_events FROM us GROUP BY 1, 2""")
    sql["E5_usage_stream"] = sql["E5_adoption"]
    sql["E5_users_stream"] = events(f"""
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, {big('count(*)')} AS n_events,
               {big('count(DISTINCT user_id)')} AS n_users FROM us GROUP BY 1, 2""")
    sql["E4_preferences_merged"] = sql["E4_latest_preferences"]
    sql["E4_preferences_upsert"] = sql["E4_preferences_stream"] = sql["E4_latest_preferences"]
    sql["S1_microdata_fields"], sql["S1_microdata_agencies"] = sql["T7_T8_field_expenditures"], sql["T10_agency_funding"]
    sql["S1_refused_lines"] = supplier(f"""
        SELECT year, reason, {big('count(*)')} AS n_lines FROM (SELECT DISTINCT year FROM inst), supplier
            JOIN (VALUES (0, 'columns'), (1, 'columns'), (2, 'data: not a double'), (3, 'inst_id: missing'), (3, 'year: not an int')) r(k, reason)
              ON s_suppkey % 4 = k GROUP BY year, reason""")
    fields_list = ", ".join(f"({i}, '{c}', '{_suggest(c)}')" for i, c in enumerate(LOGGED_FIELDS) if c not in FIELD_CODES)
    all_agencies = ", ".join(sorted(a for a, _ in AGENCIES))
    sql["E6_unknown_codes"] = events(f"""
        SELECT event_id, 'field_code' AS kind, code, suggestions FROM us JOIN (VALUES {fields_list}) f(i, code, suggestions) ON k % 5 = i
        UNION ALL SELECT event_id, 'agency_code', 'NIH', '{all_agencies}' FROM us WHERE k % 3 = 1""")

    sql["E6_first_statement"] = events("""
        SELECT event_id, CASE k % 4 WHEN 0 THEN 'SELECT a FROM t WHERE k = ' || k || ';'
            WHEN 1 THEN 'select a' || chr(10) || 'FROM t WHERE k = ' || k || ';'
            WHEN 2 THEN 'WITH x AS (SELECT ' || k || ') SELECT * FROM x;' ELSE '' END AS sql FROM us""")

    sql["F1_F2_dollars"] = supplier("""
        SELECT inst_id, year, field_code, CASE
            WHEN total >= 1000000000 THEN '$' || printf('%.2f', CAST(total AS DOUBLE) / 1000000000) || 'B'
            WHEN total >= 1000000 THEN '$' || printf('%.1f', CAST(total AS DOUBLE) / 1000000) || 'M'
            ELSE '$' || format('{:,}', total) END AS short,
            CASE WHEN is_parent = 1 THEN '$' || format('{:,}', federal) ELSE '—' END AS "full" FROM fields""")
    sql["F3_slug"] = customer("""
        SELECT inst_id, year, CASE WHEN contains(name, ',') THEN replace(replace(split_part(name, ',', 1), '#', '_'), ' ', '_')
               ELSE replace(name, '#', '_') || '_x' END AS slug FROM inst""")
    sql["F4_constant_columns"] = customer(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) <= 1 AS is_constant FROM inst WHERE year = {Y1}"
        for c in ["year", *METRICS]))
    return sql
