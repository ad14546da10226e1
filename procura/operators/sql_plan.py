"""What a SQL statement may do, decided on the tree of its parsed plan (G-4).

The walk visits every node and expression, wherever it stands: select lists of any width, subqueries, CTEs,
named windows, lambda bodies. Everything is allow-listed: relations by name in the scope where
they stand, plan nodes and expressions by class, functions by the group they are documented in. What is not known to
be harmless is refused."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import SparkSession

_CATALYST = "org.apache.spark.sql.catalyst."
# Plan nodes of queries that read relations and compute on their rows.
PLAN_NODES = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
    "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias", "Union", "Unpivot",
    "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith",
    "WithWindowDefinition",
}
# Expressions that the grammar itself writes, beside functions.
EXPRESSIONS = {
    "Alias", "AttributeReference", "CaseWhen", "Cast", "CreateNamedStruct", "CurrentRow$", "Exists", "GroupingSets", "Cube", "Rollup",
    "InSubquery", "LambdaFunction", "LateralSubquery", "LikeAll", "LikeAny", "ListQuery", "Literal", "MultiAlias", "NotLikeAll",
    "NotLikeAny", "OuterReference", "ScalarSubquery", "SortOrder", "SpecifiedWindowFrame", "TryEval", "UnboundedFollowing$",
    "UnboundedPreceding$", "UnspecifiedFrame$", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue",
    "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal", "UnresolvedRegex",
    "UnresolvedStar", "UnresolvedStarExceptOrReplace", "UnresolvedStarWithColumns", "UnresolvedWindowExpression",
    "UnresolvedSubqueryColumnAliases", "WindowExpression", "WindowSpecDefinition", "WindowSpecReference",
}
# Groups of built-in functions that compute a value from their arguments alone. Left out: misc_funcs (calls into
# the JVM, session, files and errors), variant, csv, xml, url and the formats that read a schema.
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs",
    "struct_funcs", "window_funcs",
}

_SAFE: dict[str, tuple[set[str], set[str]]] = {}


def _safe_functions(spark: SparkSession) -> tuple[set[str], set[str]]:
    """Names and expression classes of the allowed built-in functions, minus names that the session has redefined."""
    app = spark.sparkContext.applicationId
    if app not in _SAFE:
        registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        names, classes = set(), set()
        listed = registry.listFunction().iterator()
        while listed.hasNext():
            info = registry.lookupFunction(listed.next()).get()
            if info.getGroup() in FUNCTION_GROUPS:
                names.add(info.getName().lower())
                classes.add(info.getClassName())
        _SAFE[app] = names, classes
    return _SAFE[app]


def _session_function(spark: SparkSession, name: str) -> bool:
    """True if the session gives ``name`` another meaning than the built-in one."""
    jvm = spark._jvm
    name = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    own = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(name)
    builtin = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().lookupFunction(name)
    return own.isEmpty() or builtin.isEmpty() or own.get().getClassName() != builtin.get().getClassName()


class _Walk:
    def __init__(self, spark: SparkSession, relations: set[str]):
        self.spark, self.gateway, self.relations = spark, spark.sparkContext._gateway, relations
        self.names, self.classes = _safe_functions(spark)

    def _is(self, o, kind: str) -> bool:
        return is_instance_of(self.gateway, o, kind)

    def _elements(self, o) -> Iterator:
        """What a node, tuple, option, sequence or map holds."""
        if self._is(o, "scala.collection.Iterable") and not self._is(o, _CATALYST + "trees.TreeNode"):
            items = o.iterator()
        elif self._is(o, "scala.Product"):
            items = o.productIterator()
        else:
            return
        while items.hasNext():
            yield items.next()

    def refusals(self, o, scope: frozenset[str]) -> Iterator[str]:
        """Why the tree below ``o`` is refused, if it is; ``scope`` has the names of relations that may be read there."""
        if not isinstance(o, JavaObject) or self._is(o, "org.apache.spark.sql.types.DataType"):
            return
        if self._is(o, _CATALYST + "trees.TreeNode"):
            kind = o.getClass().getSimpleName()
            yield from self._node(o, kind)
            if kind == "UnresolvedRelation":
                name = o.multipartIdentifier().mkString(".").lower()
                if o.multipartIdentifier().size() != 1 or name not in scope or o.isStreaming() or not o.options().isEmpty():
                    yield f"relation {name}"
            if kind == "UnresolvedWith":
                # A CTE is known to the CTEs after it and to the query below WITH, nowhere else.
                for relation in self._elements(o.cteRelations()):
                    yield from self.refusals(relation._2(), scope)
                    scope = scope | {relation._1().lower()}
                yield from self.refusals(o.child(), scope)
                return
        for x in self._elements(o):
            yield from self.refusals(x, scope)

    def _node(self, o, kind: str) -> Iterator[str]:
        if self._is(o, _CATALYST + "plans.logical.LogicalPlan"):
            if kind not in PLAN_NODES:
                yield f"plan node {kind}"
        elif self._is(o, _CATALYST + "expressions.Expression"):
            if kind not in EXPRESSIONS and o.getClass().getName() not in self.classes:
                yield f"expression {kind}"
            if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
                parts = o.nameParts().mkString(".") if kind == "UnresolvedFunction" else o.name().funcName()
                if parts.lower() not in self.names or _session_function(self.spark, parts.lower()):
                    yield f"function {parts}"


def refusals(spark: SparkSession, sql: str, relations) -> list[str]:
    """What a statement holds that is not allowed: relations other than ``relations`` (bare names) and its own CTEs
    in their scope, file paths, table functions, hints and commands, functions outside ``FUNCTION_GROUPS``,
    and functions the session has registered itself. Nothing is analysed or run."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names = frozenset(r.lower() for r in relations)
    return list(dict.fromkeys(_Walk(spark, names).refusals(plan, names)))
