"""Schemas of the panel tables and of the raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order matters: total first, then the six funding sources.
SOURCES = ["federal", "state_local", "business", "nonprofit", "institutional", "other_sources"]
METRICS = ["total_rd", *SOURCES]


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

MICRODATA = _struct(
    ("inst_id", _S), ("inst_name_long", _S), ("inst_city", _S), ("inst_state_code", _S),
    ("year", _I), ("questionnaire_no", _S), ("question", _S), ("row", _S), ("column", _S),
    ("data", _D),
)
INSTITUTIONS = _struct(
    ("inst_id", _S), ("name", _S), ("city", _S), ("state", _S), ("year", _I),
    *[(m, _L) for m in METRICS],
)
FIELDS = _struct(
    ("inst_id", _S), ("year", _I), ("field_code", _S), ("parent_field", _S), ("is_parent", _I),
    ("field_name", _S), ("federal", _L), ("nonfederal", _L), ("total", _L),
)
AGENCIES = _struct(
    ("inst_id", _S), ("year", _I), ("agency_code", _S), ("agency_name", _S), ("amount", _L),
)
EDGES = _struct(("target_id", _S), ("peer_id", _S), ("rank", _I), ("distance", _D))
USAGE_EVENTS = _struct(
    ("id", _S), ("user_id", _S), ("email", _S), ("full_name", _S), ("event_type", _S),
    ("institution", _S), ("question", _S), ("created_at", T.TimestampType()),
)
PREFERENCES = _struct(
    ("user_id", _S), ("institution", _S), ("custom_peers", T.ArrayType(_S)),
    ("updated_at", T.TimestampType()),
)
TAXONOMY = _struct(("field_name", _S), ("field_code", _S), ("parent_field", _S), ("is_parent", _I))

KEYS = {
    "institutions": ["inst_id", "year"],
    "field_expenditures": ["inst_id", "year", "field_code"],
    "agency_funding": ["inst_id", "year", "agency_code"],
}
