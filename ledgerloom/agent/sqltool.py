"""Read-only SQL over the warehouse, judged by its plan before it runs.

Nothing is searched in the text. Spark's own parser makes a plan of it (or refuses it); the plan is walked with all that
it holds: subqueries, common tables, expressions. Only kinds of nodes that read and reshape rows may occur, only functions
of the list below may be called, and a relation must be a readable table or a common table that is in scope where it is
named. A common table may not be named like a table of the warehouse. Only then the query runs, and its rows are capped.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from ledgerloom import schemas

ROW_CAP = 50
OBSERVATION = 4000

#: Kinds of plan nodes that only read and reshape rows.
NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedWith UnresolvedHaving WithWindowDefinition OneRowRelation UnresolvedRelation UnresolvedInlineTable Pivot Unpivot Generate Window".split()
)
#: Expressions that take a name from a value, or tell of the session.
_NO_EXPRESSIONS = frozenset("ExpressionWithUnresolvedIdentifier CurrentUser CurrentDatabase CurrentCatalog UnresolvedTableValuedFunction".split())
_SESSION = [["current_user"], ["session_user"], ["current_database"], ["current_schema"], ["current_catalog"]]
FUNCTIONS = frozenset(
    # aggregates and windows
    "count sum avg mean min max min_by max_by median mode stddev stddev_pop stddev_samp variance var_pop var_samp corr count_if bool_and bool_or any some every "
    "percentile percentile_approx approx_count_distinct collect_list collect_set array_agg listagg string_agg first last any_value first_value last_value nth_value "
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead grouping grouping_id "
    # operators that the parser turns into calls
    "between and or not in + - * / % || = == <=> <> != < <= > >= div mod ~ & | ^ "
    # numbers
    "abs sign round bround floor ceil ceiling sqrt exp ln log log10 power pow mod greatest least try_divide isnan nanvl "
    # texts
    "lower upper trim ltrim rtrim length char_length concat concat_ws substring substr left right replace split split_part position instr locate lpad rpad repeat reverse "
    "contains startswith endswith like ilike rlike regexp_like regexp_extract regexp_extract_all regexp_replace regexp_count initcap format_number md5 sha2 ascii "
    # choices and kinds
    "coalesce nullif ifnull nvl nvl2 if isnull isnotnull cast try_cast double int bigint string date timestamp decimal boolean "
    # days
    "year quarter month day dayofmonth dayofweek dayofyear weekofyear hour minute second date_trunc trunc date_add date_sub datediff date_diff add_months months_between "
    "last_day make_date to_date to_timestamp date_format unix_timestamp from_unixtime date_part extract current_date current_timestamp now "
    # lists and JSON
    "array size cardinality array_contains array_distinct array_join array_sort sort_array array_max array_min element_at try_element_at slice sequence explode explode_outer "
    "posexplode flatten map map_keys map_values struct named_struct transform filter exists forall aggregate get_json_object json_array_length json_object_keys from_json to_json".split()
)


class Rejected(ValueError):
    """The query may not run."""


class _Walk:
    """One pass over a plan, as the parser leaves it."""

    def __init__(self, spark: SparkSession, readable: frozenset[str], reserved: frozenset[str]):
        self.readable, self.reserved = readable, reserved
        kinds = spark.sparkContext._jvm.java.lang.Class
        loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        load = lambda name: kinds.forName(name, True, loader)
        self._tree, self._plan = (load(f"org.apache.spark.sql.catalyst.{n}") for n in ("trees.TreeNode", "plans.logical.LogicalPlan"))
        self._many, self._product = load("scala.collection.Iterable"), load("scala.Product")

    def visit(self, x, scope: frozenset[str] = frozenset()) -> None:
        """Judges whatever a plan may hold; scope has the common tables that may be named."""
        if not isinstance(x, JavaObject):
            return
        if self._tree.isInstance(x):
            self._node(x, scope)
        elif self._many.isInstance(x):
            each = x.iterator()
            while each.hasNext():
                self.visit(each.next(), scope)
        elif self._product.isInstance(x):  # tuples and options
            for k in range(x.productArity()):
                self.visit(x.productElement(k), scope)

    def _node(self, x, scope: frozenset[str]) -> None:
        kind = x.getClass().getSimpleName().rstrip("$")
        if self._plan.isInstance(x):
            if kind not in NODES:
                raise Rejected(f"only tables can be read, not {kind}")
            if kind == "UnresolvedWith":
                return self._with(x, scope)
            if kind == "UnresolvedRelation":
                return self._relation(_names(x.multipartIdentifier()), scope)
        elif kind in _NO_EXPRESSIONS:
            raise Rejected(f"{kind} is not allowed")
        elif kind == "UnresolvedAttribute" and [n.lower() for n in _names(x.nameParts())] in _SESSION:
            raise Rejected("the session is not to be read")
        elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = _names(x.nameParts()) if kind == "UnresolvedFunction" else [x.name().funcName()]
            if len(name) != 1 or name[0].lower() not in FUNCTIONS:
                raise Rejected(f"{'.'.join(name)}() is not allowed")
        for k in range(x.productArity()):
            self.visit(x.productElement(k), scope)

    def _with(self, x, scope: frozenset[str]) -> None:
        """Each common table sees those before it, and itself only where it may be recursive."""
        each = x.cteRelations().iterator()
        while each.hasNext():
            entry = each.next()
            name = entry._1().lower()
            if name in self.reserved:
                raise Rejected(f"a common table may not be named {name}")
            self.visit(entry._2(), scope | {name} if x.allowRecursion() else scope)
            scope = scope | {name}
        self.visit(x.child(), scope)

    def _relation(self, name: list[str], scope: frozenset[str]) -> None:
        if len(name) != 1 or name[0].lower() not in self.readable | scope:
            raise Rejected(f"not readable: {'.'.join(name)}")


def _names(parts) -> list[str]:
    each, out = parts.iterator(), []
    while each.hasNext():
        out.append(each.next())
    return out


def judge(spark: SparkSession, sql: str, readable: tuple[str, ...] = schemas.READABLE) -> None:
    """Rejected, with the reason, if the query may not run."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Rejected(f"not one SQL query: {str(e).strip().splitlines()[0][:200] if str(e).strip() else 'empty'}") from e
    _Walk(spark, frozenset(readable), frozenset(schemas.TABLES) | frozenset(readable)).visit(plan)


def sql_query(spark: SparkSession, sql: str, readable: tuple[str, ...] = schemas.READABLE) -> DataFrame:
    """The query's rows, at most ROW_CAP, over views of the readable tables."""
    judge(spark, sql, readable)
    return spark.sql(sql).limit(ROW_CAP)


def describe(names: tuple[str, ...] = schemas.READABLE) -> str:
    """table(column:type, ...) of each readable table."""
    return "\n".join(f"{n}({', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in schemas.TABLES[n])})" for n in names)


def cell(value, width: int = 40) -> str:
    text = "" if value is None else " ".join(str(value).split())
    return text if len(text) <= width else text[: width - 1] + "…"


def as_table(df: DataFrame) -> str:
    """Rows as text with a count; meant for capped results."""
    rows = df.collect()
    lines = [" | ".join(df.columns)] + [" | ".join(cell(v) for v in r) for r in rows]
    return "\n".join([*lines, f"({len(rows)} rows)"])


def observation(text: str, most: int = OBSERVATION) -> str:
    return text if len(text) <= most else f"{text[:most]}... [{len(text) - most} more characters]"
