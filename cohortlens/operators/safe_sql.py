"""Guarded read-only SQL over registered tables, decided on the parsed plan."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# What a query may be made of. Anything else (commands, script transformation, file relations, table functions) is refused.
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "SubqueryAlias", "Distinct", "Union", "Except",
    "Intersect", "UnresolvedRelation", "UnresolvedHaving", "UnresolvedWith", "OneRowRelation", "WithWindowDefinition",
    "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "Pivot", "Unpivot", "UnresolvedOrdinal"}
# Built-in functions that are refused: they call the JVM, look at files, or make values of any size from a number.
FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
                       "sequence", "repeat", "array_repeat", "space"}
MOST_ROWS = 10_000
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


class UnsafeQuery(ValueError):
    """The query is not a single read-only SELECT over the registered tables."""


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _refuse(why: str) -> None:
    raise UnsafeQuery(why)


class _Functions:
    """What may be called: functions that Spark itself brings, as long as the session has not put another in their place."""

    def __init__(self, spark: SparkSession):
        catalyst = spark._jvm.org.apache.spark.sql.catalyst
        self._identifier = catalyst.FunctionIdentifier
        self._own = spark._jsparkSession.sessionState().functionRegistry()
        self._builtin = getattr(getattr(catalyst.analysis, "FunctionRegistry$"), "MODULE$").builtin()

    def allowed(self, name: str) -> bool:
        if name in FORBIDDEN_FUNCTIONS:
            return False
        shipped = self._builtin.lookupFunctionBuilder(self._identifier(name))
        return shipped.isDefined() and shipped.equals(self._own.lookupFunctionBuilder(self._identifier(name)))


def _check_expression(expr, known: set[str], functions: _Functions) -> None:
    kind = _kind(expr)
    if kind in _SUBQUERIES:
        _check_plan(expr.plan(), known, functions)
    if kind == "UnresolvedFunction":
        name = [str(x).lower() for x in _each(expr.nameParts())]
        if len(name) > 1 or not functions.allowed(name[0]):
            _refuse(f"function {'.'.join(name)} is not allowed")
    for child in _each(expr.children()):
        _check_expression(child, known, functions)


def _names_columns(expr) -> bool:
    return _kind(expr) == "UnresolvedAttribute" or any(_names_columns(c) for c in _each(expr.children()))


def _check_plan(plan, known: set[str], functions: _Functions) -> None:
    kind = _kind(plan)
    if kind not in QUERY_NODES:
        _refuse(f"{kind} is not allowed")
    if kind == "Join" and _kind(plan.joinType()) not in ("UsingJoin", "NaturalJoin"):
        if plan.condition().isEmpty() or not _names_columns(plan.condition().get()):
            _refuse("a join needs a condition on columns: JOIN ... ON")
    if kind == "UnresolvedRelation":
        parts = [str(x).lower() for x in _each(plan.multipartIdentifier())]
        if len(parts) > 1 or parts[0] not in known:
            _refuse(f"table {'.'.join(parts)} is not registered")
    if kind == "UnresolvedWith":
        for pair in _each(plan.cteRelations()):
            _check_plan(pair._2(), known, functions)  # a table expression sees those before it
            known = known | {str(pair._1()).lower()}
    for expr in _each(plan.expressions()):
        _check_expression(expr, known, functions)
    for child in _each(plan.children()):
        _check_plan(child, known, functions)


def _parsed(spark: SparkSession, query: str, known: set[str]):
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query.strip().rstrip(";").strip())
    except Exception as bad:  # several statements do not parse either
        raise UnsafeQuery("only a single SELECT or WITH statement is allowed") from bad
    try:
        _check_plan(plan, {k.lower() for k in known}, _Functions(spark))
    except Py4JJavaError as bad:
        raise UnsafeQuery("the query cannot be checked") from bad
    return plan


def is_safe(spark: SparkSession, query: str, *tables: str) -> bool:
    try:
        _parsed(spark, query, set(tables))
    except UnsafeQuery:
        return False
    return True


def safe_sql(spark: SparkSession, query: str, limit: int = 50, most: int = MOST_ROWS, **tables: DataFrame) -> DataFrame:
    """Run a read-only query over `tables` only; `limit` rows are returned at most, or `most` if its outermost step is a LIMIT."""
    plan = _parsed(spark, query, set(tables))
    taken = [name for name in tables if spark.catalog.tableExists(name)]
    if taken:
        raise ValueError(f"views of these names exist: {taken}")
    try:
        for name, df in tables.items():
            df.createTempView(name)
        out = spark.sql(query.strip().rstrip(";"))  # resolved here, so the views are not needed any longer
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
    while _kind(plan) == "UnresolvedWith":
        plan = plan.child()
    return out.limit(most if _kind(plan) == "GlobalLimit" else limit)
