"""Parameterised and guarded SQL over the panel tables."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .panel import Panel


VIEWS = ("institutions", "field_expenditures", "agency_funding")
# what a guarded statement may call
FUNCTIONS = """
abs acos asin atan atan2 bround cbrt ceil ceiling cos cosh cot degrees exp expm1 floor greatest hypot least ln log log10
log1p log2 mod negative pi pmod pow power radians rint round sign signum sin sinh sqrt tan tanh width_bucket
any any_value approx_count_distinct avg bool_and bool_or collect_list collect_set corr count count_if covar_pop
covar_samp every first first_value kurtosis last last_value listagg max max_by mean median min min_by mode
percentile percentile_approx regr_intercept regr_r2 regr_slope skewness some std stddev stddev_pop stddev_samp
string_agg sum try_avg try_sum var_pop var_samp variance
cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
coalesce if ifnull isnan isnotnull isnull nanvl nullif nvl nvl2 try_add try_divide try_multiply try_subtract
bigint boolean cast char_length character_length concat concat_ws contains date decimal double endswith float
format_number initcap instr int left length levenshtein like locate lower lpad ltrim position printf regexp_count
regexp_extract regexp_like regexp_replace repeat replace reverse right rlike rpad rtrim smallint split split_part
startswith string substr substring tinyint trim ucase upper lcase
array array_contains array_distinct array_join array_max array_min array_sort element_at exists explode filter
forall named_struct posexplode reduce aggregate sequence size slice sort_array struct transform
add_months date_add date_diff date_sub date_trunc datediff day dayofmonth month months_between quarter to_date trunc year
""".split()
# what operators and clauses become
OPERATORS = set("""
Add Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast CheckOverflow
CreateNamedStruct CurrentRow$ Divide EqualNullSafe EqualTo Exists GetArrayItem GetStructField GreaterThan
GreaterThanOrEqual ILike If In InSet InSubquery IntegralDivide IsNotNull IsNull LambdaFunction LateralSubquery LessThan
LessThanOrEqual Like ListQuery Literal Mode Multiply NamedLambdaVariable Not Or OuterReference RLike Remainder
Explode PosExplode Ceil RoundCeil Floor RoundFloor StringLPad StringRPad Contains StartsWith EndsWith
ScalarSubquery SortOrder SpecifiedWindowFrame Subtract UnaryMinus UnaryPositive UnboundedFollowing$
UnboundedPreceding$ UnspecifiedFrame$ UpCast AggregateExpression WindowExpression WindowSpecDefinition
""".split())
CLAUSES = set("""
Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join
LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sort SubqueryAlias Union Unpivot Window WithCTE
""".split())
# the leaves of a parsed statement, besides views and names bound by WITH
PLAIN_LEAVES = {"OneRowRelation", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation"}


class NotReadOnly(ValueError):
    """The text is not a single statement that only reads the panel's views."""


def register(panel: Panel) -> None:
    """Expose the panel as the views its SQL users know."""
    panel.inst.createOrReplaceTempView("institutions")
    panel.fields.createOrReplaceTempView("field_expenditures")
    panel.agencies.createOrReplaceTempView("agency_funding")


def query(spark: SparkSession, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run SQL with named parameters (``:name``)."""
    return spark.sql(sql, args=args or {})


def guarded_query(spark: SparkSession, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run SQL that only reads the panel's views; anything else is refused before it runs.

    Only listed things pass. The statement as Spark parses it is checked first, since
    Spark executes commands and inline tables as soon as ``spark.sql`` is called; then
    what the analyser made of it, where every name is resolved, however it was written.
    """
    if not re.match(r"\s*(SELECT|WITH)\b", sql, re.IGNORECASE):
        raise NotReadOnly("only SELECT and WITH statements are allowed")
    _Parsed(spark).plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(VIEWS))
    found = query(spark, sql, args)
    _Resolved(spark).plan(found._jdf.queryExecution().analyzed())
    return found


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _each(items, visit) -> None:
    for i in range(items.size()):
        visit(items.apply(i))


def _loaded(spark: SparkSession, name: str):
    return spark._jvm.Thread.currentThread().getContextClassLoader().loadClass(f"org.apache.spark.sql.catalyst.{name}")


class _Parsed:
    """Walks a parsed statement; the names a scope may read are passed down."""

    def __init__(self, spark: SparkSession):
        self.writers = [_loaded(spark, f"plans.logical.{n}") for n in ("Command", "ParsedStatement", "InsertIntoDir")]
        self.nested = _loaded(spark, "expressions.PlanExpression")

    def plan(self, node, names: frozenset[str]) -> None:
        kind = _name(node)
        if any(writer.isInstance(node) for writer in self.writers):
            raise NotReadOnly("the statement changes data")
        if kind == "UnresolvedWith":
            bound = node.cteRelations()
            for i in range(bound.size()):
                self.plan(bound.apply(i)._2(), names)
                names = names | {bound.apply(i)._1().lower()}
        elif kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            if parts.size() != 1 or parts.apply(0).lower() not in names:
                raise NotReadOnly(f"{node.multipartIdentifier().mkString('.')} is not a view of the panel")
        elif "Identifier" in kind or not node.children().size() and kind not in PLAIN_LEAVES:
            raise NotReadOnly(f"{kind} is not allowed")
        _each(node.expressions(), lambda e: self.expression(e, names))
        _each(node.children(), lambda child: self.plan(child, names))

    def expression(self, node, names: frozenset[str]) -> None:
        kind = _name(node)
        if kind == "UnresolvedFunction":
            parts = node.nameParts()
            if parts.size() != 1 or parts.apply(0).lower() not in FUNCTIONS:
                raise NotReadOnly(f"the function {parts.mkString('.')} is not allowed")
        elif "Identifier" in kind:  # a name made up by an expression
            raise NotReadOnly(f"{kind} is not allowed")
        if self.nested.isInstance(node):
            self.plan(node.plan(), names)
        _each(node.children(), lambda child: self.expression(child, names))


class _Resolved:
    """Walks an analysed statement down to the panel's views: only listed clauses and expressions pass."""

    def __init__(self, spark: SparkSession):
        self.nested = _loaded(spark, "expressions.PlanExpression")
        self.replaced = _loaded(spark, "expressions.InheritAnalysisRules")
        registry = spark._jsparkSession.sessionState().functionRegistry()
        identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        listed = [registry.lookupFunction(identifier(name)) for name in FUNCTIONS]
        self.allowed = {f.get().getClassName() for f in listed if f.isDefined()}

    def plan(self, node) -> None:
        kind = _name(node)
        if kind == "View" and node.desc().identifier().table() in VIEWS:
            return
        if kind not in CLAUSES:
            raise NotReadOnly(f"{kind} is not allowed")
        _each(node.expressions(), self.expression)
        _each(node.children(), self.plan)

    def expression(self, node) -> None:
        if node.getClass().getName() not in self.allowed and _name(node) not in OPERATORS:
            raise NotReadOnly(f"{_name(node)} is not allowed")
        if self.nested.isInstance(node):
            self.plan(node.plan())
        # what Spark puts in place of a listed function is its own
        _each(node.parameters() if self.replaced.isInstance(node) else node.children(), self.expression)
