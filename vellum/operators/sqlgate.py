"""Read-only SQL over a few named tables.

A statement is parsed, not run, and its whole tree is walked: CTE bodies, subqueries and
expressions included. Only node classes on a list may occur, only relations that are offered
or defined by the statement, and no function that runs code, reads files or has state. What
passes runs in a session of its own that holds nothing but the offered tables.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged

#: Plan nodes that read and compute.
NODES = frozenset(
    "Project Filter Aggregate Distinct Sort GlobalLimit LocalLimit Limit Offset Union Intersect Except Join SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases "
    "UnresolvedWith UnresolvedHaving Generate Window WithWindowDefinition LocalRelation OneRowRelation UnresolvedInlineTable Pivot Unpivot Expand GroupingSets "
    "LateralJoin UnresolvedTableValuedFunction UnresolvedTVFAliases Tail AsOfJoin UnionLoop UnionLoopRef".split()
)
TABLE_FUNCTIONS = frozenset({"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "json_tuple", "stack", "range", "variant_explode"})
#: Functions that run code, read what is not offered, or change between calls.
DENIED = frozenset(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user current_catalog current_database "
    "current_schema version assert_true raise_error spark_partition_id monotonically_increasing_id rand randn random uuid shuffle from_avro to_avro from_protobuf to_protobuf schema_of_avro read_files read_kafka".split()
)


class Refused(ValueError):
    pass


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def check(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Raises Refused unless the statement only reads the tables."""
    if not re.match(r"\s*(select|with)\b", sql, re.I):
        raise Refused("only SELECT / WITH queries are allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as exc:
        raise Refused(f"the statement cannot be parsed: {str(exc).splitlines()[0]}") from exc
    tables = {t.lower() for t in tables}

    def plan_of(expression):
        try:
            return expression.plan()
        except Exception:  # no subquery
            return None

    def expressions(e, names: set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = [str(p).lower() for p in _seq(e.nameParts())]
            if len(parts) > 1 or parts[0] in DENIED:
                raise Refused(f"the function {'.'.join(parts)} is not allowed")
        if kind.endswith(("Subquery", "SubqueryExpression")) or kind in ("Exists", "ListQuery", "LateralSubquery", "InSubquery"):
            inner = plan_of(e)
            if inner is not None:
                walk(inner, names)
        if kind in ("CallMethodViaReflection", "TryReflect", "ScriptInputOutputSchema"):
            raise Refused(f"{kind} is not allowed")
        for child in _seq(e.children()):
            expressions(child, names)

    def walk(node, names: set[str]) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in NODES:
            raise Refused(f"{kind} is not allowed: queries only read")
        if kind == "UnresolvedRelation":
            parts = [str(p).lower() for p in _seq(node.multipartIdentifier())]
            if len(parts) > 1 or parts[0] not in names:
                raise Refused(f"no table {'.'.join(parts)}; there are {', '.join(sorted(tables))}")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(str(p).lower() for p in _seq(node.name()))
            if name not in TABLE_FUNCTIONS:
                raise Refused(f"the table function {name} is not allowed")
        if kind == "UnresolvedWith":
            names = set(names)
            recursive = bool(node.allowRecursion())
            for cte in _seq(node.cteRelations()):
                alias = cte.productElement(0)
                own = names | {str(alias).lower()} if recursive else names
                walk(cte.productElement(1), own)
                names.add(str(alias).lower())
        for e in _seq(node.expressions().toSeq() if hasattr(node.expressions(), "toSeq") else node.expressions()):
            expressions(e, names)
        for child in _seq(node.children()):
            walk(child, names)

    walk(plan, tables)


#: Rounds after which a recursion is taken for one without end.
MOST_ROUNDS = 10_000


def query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], limit: int = 200) -> DataFrame:
    """At most `limit` rows of a read-only statement over the tables.

    A WITH RECURSIVE whose parts are joined by UNION is a set: each round runs its steps on the rows that the last one
    brought, and takes from them what was not there. It ends on cycles, too. With UNION ALL rows repeat, and
    the statement has to end by itself."""
    check(spark, sql, set(tables))
    child = spark.newSession()
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        _offer(child, name, df)
    plan = child._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if _kind(plan) == "UnresolvedWith" and plan.allowRecursion():
        bodies = [(str(c.productElement(0)), *_body(c.productElement(1))) for c in _seq(plan.cteRelations())]
        if any(_refers(body, name) and _kind(body) == "Distinct" for name, body, _ in bodies):
            for name, body, columns in bodies:
                _defined(child, name, body, columns).createOrReplaceTempView(name)
            return _rows(child, plan.child()).limit(limit)
    return child.sql(sql).limit(limit)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _rows(session: SparkSession, plan) -> DataFrame:
    return DataFrame(session.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def _body(definition) -> tuple:
    """The statement of a WITH entry and the names it gives its columns."""
    body, columns = definition.child(), None
    if _kind(body) == "UnresolvedSubqueryColumnAliases":
        columns, body = [str(x) for x in _seq(body.outputColumnNames())], body.child()
    return body, columns


def _refers(node, name: str) -> bool:
    if _kind(node) == "UnresolvedRelation":
        return [str(p).lower() for p in _seq(node.multipartIdentifier())] == [name.lower()]
    return any(_refers(x, name) for x in _seq(node.children()))


def _united(node) -> list:
    """The parts of a UNION, however nested."""
    if _kind(node) == "Distinct" and _kind(node.child()) == "Union":
        return [p for x in _seq(node.child().children()) for p in _united(x)]
    return [node]


def _defined(session: SparkSession, name: str, body, columns: list[str] | None) -> DataFrame:
    """The rows of one WITH entry."""
    if not _refers(body, name):
        out = _rows(session, body)
        return out.toDF(*columns) if columns else out
    parts = _united(body)
    first, steps = [p for p in parts if not _refers(p, name)], [p for p in parts if _refers(p, name)]
    if not first or any(_kind(p) == "Union" for p in steps):
        raise Refused(f"{name}: a recursion needs rows to begin with, and UNION throughout")
    joined = lambda plans: reduce(DataFrame.union, [_rows(session, p) for p in plans])
    start = joined(first)
    start = start.toDF(*columns) if columns else start
    kinds = start.dtypes
    seen = front = staged(start.distinct(), "recursion")
    for no in range(MOST_ROUNDS):
        front.createOrReplaceTempView(name)
        step = joined(steps).toDF(*[c for c, _ in kinds])
        step = step.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds])
        front = staged(step.distinct().subtract(seen), "recursion")
        if front.isEmpty():
            return seen
        seen = seen.union(front)
        if no % 16 == 15:  # one table instead of many small ones
            seen = staged(seen, "recursion")
    raise Refused(f"{name}: no end after {MOST_ROUNDS} rounds")


def _offer(session: SparkSession, name: str, df: DataFrame) -> None:
    """A temporary view of the session over a plan of another one."""
    _rows(session, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
