"""Ad-hoc read-only SQL and the JSON envelope of its result."""

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from forecourt import schemas as S

# Nodes that the parsed text may consist of; anything else (commands, writes, scripts, names made by IDENTIFIER) is refused.
_READS = {
    "Aggregate", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "OneRowRelation$", "Pivot", "PipeOperator",
    "Project", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "Unpivot", "UnresolvedHaving", "UnresolvedHint",
    "UnresolvedInlineTable", "UnresolvedOrdinal", "UnresolvedPivot", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedUnpivot", "UnresolvedWith",
    "Window", "WithWindowDefinition",
}
# Built-in functions are allowed by the group that Spark lists them under, except the mixed group, which holds those that
# call into the machine or read its files; of that one and of the functions in FROM only these are allowed.
_MIXED_GROUPS = {"misc_funcs", ""}
_MIXED = {"assert_true", "monotonically_increasing_id", "spark_partition_id", "typeof", "uuid"}
_IN_FROM = {
    "explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack",
    "variant_explode", "variant_explode_outer",
}
# What the resolved plan may read from besides tables and views, and where its expressions may come from.
_NO_TABLES = {"CTERelationRef", "LocalRelation", "OneRowRelation", "OneRowRelation$", "Range"}
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
_FOREIGN = {
    "ApplyFunctionExpression", "CallMethodViaReflection", "ExternalUDF", "PythonUDAF", "PythonUDF", "PythonUDTF", "ScalaUDAF",
    "ScalaUDF", "UserDefinedGenerator",
}


class NotReadOnly(ValueError):
    """The text is no plain query, or reads what it may not."""


def _listed(sequence):
    return [sequence.apply(i) for i in range(sequence.size())]


def _nodes(plan, closed=()):
    """The nodes of a plan, of its subqueries and of the queries it names; not what lies below nodes of kinds in ``closed``."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        if node.getClass().getSimpleName() not in closed:
            for below in (node.children(), node.innerChildren(), node.subqueries()):
                waiting.extend(_listed(below))


def _expressions(node):
    waiting = _listed(node.expressions())
    while waiting:
        expression = waiting.pop()
        yield expression
        waiting.extend(_listed(expression.children()))


_allowed: dict[str, set[str]] = {}


def _allowed_functions(spark: SparkSession) -> set[str]:
    if spark.version in _allowed:
        return _allowed[spark.version]
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    names = set()
    for identifier in _listed(registry.listFunction()):
        name = identifier.funcName()
        if registry.lookupFunction(identifier).get().getGroup() not in _MIXED_GROUPS or name in _MIXED:
            names.add(name)
    return _allowed.setdefault(spark.version, names)


def _check_parsed(spark: SparkSession, text: str) -> None:
    """Refuse what must not even be resolved: resolving a file as a table reads it, resolving some functions runs them."""
    allowed = _allowed_functions(spark)
    for node in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
        kind = node.getClass().getSimpleName()
        if kind not in _READS:
            raise NotReadOnly(f"read-only access: {kind} is not allowed")
        if kind == "UnresolvedRelation":
            parts = _listed(node.multipartIdentifier())
            # One part is a named query, a view or a table; of more, the first may be a format and the second a path.
            if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
                raise NotReadOnly(f"read-only access: there is no table {'.'.join(parts)}")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(_listed(node.name())).lower()
            if name not in _IN_FROM:
                raise NotReadOnly(f"read-only access: {name} is not allowed")
        for expression in _expressions(node):
            kind = expression.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                name = ".".join(_listed(expression.nameParts())).lower()
            elif kind == "UnresolvedGenerator":
                name = expression.name().unquotedString().lower()
            elif kind == "ExpressionWithUnresolvedIdentifier":
                raise NotReadOnly("read-only access: names made by IDENTIFIER are not allowed")
            else:
                continue
            if name not in allowed:
                raise NotReadOnly(f"read-only access: {name} is not allowed")


def _name_parts(identifier) -> list[str]:
    parts = [identifier.catalog(), identifier.database()]
    return [p.get() for p in parts if p.isDefined()] + [identifier.table()]


def _read_from(node) -> list[str] | None:
    """The name of the table or view that a node without inputs reads, None for one without a name."""
    kind = node.getClass().getSimpleName()
    if kind == "View":
        return _name_parts(node.desc().identifier())
    if kind == "HiveTableRelation":
        return _name_parts(node.tableMeta().identifier())
    if kind == "LogicalRelation" and node.catalogTable().isDefined():
        return _name_parts(node.catalogTable().get().identifier())
    if kind == "DataSourceV2Relation" and node.catalog().isDefined() and node.identifier().isDefined():
        identifier = node.identifier().get()
        return [node.catalog().get().name(), *list(identifier.namespace()), identifier.name()]
    return None


def _fits(name: list[str], entry: str) -> bool:
    """Whether an entry names the table, its schema or its catalog; the catalog may be left out."""
    wanted, lower = entry.lower().split("."), [p.lower() for p in name]
    return any(lower[i : i + len(wanted)] == wanted for i in range(min(2, len(lower))) if i == 0 or len(lower) == 3)


def _check_resolved(plan, relations: list[str] | None) -> None:
    """Allow only tables and views (of ``relations``), and expressions that Spark brings along."""
    for node in _nodes(plan, closed=("View",)):
        kind = node.getClass().getSimpleName()
        if kind == "View" or (node.children().isEmpty() and kind not in _NO_TABLES):
            name = _read_from(node)
            if name is None:
                raise NotReadOnly(f"read-only access: {kind} is no table or view")
            if relations is not None and not any(_fits(name, entry) for entry in relations):
                raise NotReadOnly(f"read-only access: {'.'.join(name)} is not among the allowed tables")
        for expression in _expressions(node):
            where, _, simple = expression.getClass().getName().rpartition(".")
            if not f"{where}.".startswith(_EXPRESSIONS) or simple in _FOREIGN:
                raise NotReadOnly(f"read-only access: {simple} is not allowed")


def _resolved(spark: SparkSession, text: str, args: dict | None, relations: list[str] | None) -> DataFrame:
    query = text.strip().rstrip(";")
    _check_parsed(spark, query)
    rows = spark.sql(query, args=args)  # resolves the text; a query runs only when its rows are asked for
    _check_resolved(rows._jdf.queryExecution().analyzed(), relations)
    return rows


def check_readonly(spark: SparkSession, text: str, args: dict | None = None, relations: list[str] | None = None) -> None:
    """Raise ``NotReadOnly`` unless ``text`` is a query over tables and views with Spark's own functions, and nothing else.

    Checked twice: the parsed text may hold no commands, writes, scripts, files as tables, names made by IDENTIFIER or functions
    but those that Spark lists as computing; the resolved plan may read only tables and views, of the catalogs, schemas and names in
    ``relations`` if given (a view stands for what it reads), and call no function from outside Spark, whatever its name.
    """
    _resolved(spark, text, args, relations)


def run_readonly_sql(spark: SparkSession, text: str, cap: int | None = None, args: dict | None = None, relations: list[str] | None = None) -> DataFrame:
    """Run a query given as text; ``cap`` limits its rows, else only the text does.

    The text is checked before it runs. Values belong in ``args`` (named parameters
    such as ``:maker``), not in the text.
    """
    rows = _resolved(spark, text, args, relations)
    return rows if cap is None else rows.limit(cap)


# Nodes above a sort that leave its order as it is.
_KEEP_ORDER = {"Filter", "GlobalLimit", "LocalLimit", "Offset", "Project", "SubqueryAlias"}


def _is_sorted(df: DataFrame) -> bool:
    """Whether the query itself says in which order its rows come."""
    node = df._jdf.queryExecution().analyzed()
    while True:
        kind = node.getClass().getSimpleName()
        if kind == "Sort":
            return getattr(node, "global")()
        if kind not in _KEEP_ORDER and kind != "WithCTE":
            return False
        node = _listed(node.children())[-1]


def result_envelope(df: DataFrame, cap: int = S.MARKET_ROW_CAP, hint: str = "nothing matches; ask with a shorter text or drop a condition") -> DataFrame:
    """One row with JSON ``{found, data, row_count, total_rows, truncated}``.

    ``data`` are the first ``cap`` rows, in the query's own order if it has one, else in the order of the columns;
    ``total_rows`` counts all, and ``truncated`` tells whether some are missing from ``data``. Not found means no rows,
    or a single row whose ``num_cars_sold`` is 0; a ``message`` then tells what to relax.

    Runs the query when called, once: rows are counted on their way to the sort. Only one with an order of its own and more
    than ``cap`` rows is run again to count them, without its order. At most ``cap`` + 1 rows reach the driver.
    """
    spark = df.sparkSession
    columns = [F.col(f"`{c}`") for c in df.columns]
    counts = Observation()
    if _is_sorted(df):
        rows, ordered = df, []
    else:
        rows = df.observe(counts, F.count(F.lit(1)).alias("rows"))
        ordered = [c for c, kind in zip(columns, df.schema, strict=True) if kind.dataType.typeName() not in ("map", "variant")]
        rows = rows.orderBy(*ordered) if ordered else rows
    sold = F.col("num_cars_sold").cast("double") if "num_cars_sold" in df.columns else F.lit(None).cast("double")
    told = rows.limit(cap + 1).select(F.to_json(F.struct(*columns)), sold).collect()
    total = len(told)
    if total > cap:
        total = counts.get["rows"] if ordered else df.count()
    found = total > 0 and not (total == 1 and told[0][1] == 0)
    data = f"[{','.join(r[0] for r in told[:cap])}]"
    if found:
        rest = {"row_count": min(total, cap), "total_rows": total, "truncated": total > cap}
    else:
        rest = {"message": hint}
    result = f'{{"found":{json.dumps(found)},"data":{data},{json.dumps(rest, separators=(",", ":"))[1:]}'
    return spark.createDataFrame([(result,)], "result string")


def answer_sql(spark: SparkSession, text: str, cap: int = S.MARKET_ROW_CAP, args: dict | None = None, relations: list[str] | None = None) -> str:
    """Check, run and wrap a query; errors come back as JSON ``{error, message, hint}``."""
    try:
        return result_envelope(run_readonly_sql(spark, text, args=args, relations=relations), cap).first()["result"]
    except Exception as error:
        hint = "the text must be one query over known tables and columns"
        return json.dumps({"error": True, "message": str(error), "hint": hint}, ensure_ascii=False)
