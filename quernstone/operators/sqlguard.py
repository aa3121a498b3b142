"""Read-only SQL from users: checked on the parsed plan, not on the text, then run over the allowed views.

The plan is walked node by node, expressions and subqueries included. Only the node kinds, functions and relations listed pass;
whatever names a relation otherwise (table functions, IDENTIFIER, paths, parameters) is not listed and so rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Limits on text and rows, and the metadata schemas that may be read.
MAX_LENGTH, MAX_ROWS, MAX_ROWS_HARD = 2000, 100, 1000
METADATA_SCHEMAS = frozenset({"information_schema", "pg_catalog"})
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "copy", "merge", "union", "into", "returning", "with")
NODES = frozenset("Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedRelation Distinct UnresolvedHaving OneRowRelation WithWindowDefinition".split())
#: None of these reads anything but its arguments.
FUNCTIONS = frozenset(
    """abs acos any any_value approx_count_distinct array array_contains array_distinct array_join array_size ascii asin atan atan2 avg bit_and bit_or bit_xor bool_and bool_or btrim cardinality ceil ceiling
    char_length character_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if cume_dist date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth
    dayofweek dayofyear dense_rank element_at endswith every exists exp first first_value floor format_number get_json_object greatest hour if ifnull initcap instr isnan isnotnull isnull lag last last_value lcase lead
    least left length levenshtein like ln locate log log10 log2 lower lpad ltrim max max_by md5 mean median min min_by minute mod month months_between nanvl now ntile nullif nvl nvl2 percent_rank percentile
    percentile_approx pmod position pow power quarter rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regexp_substr repeat replace reverse right rlike round row_number rpad rtrim second
    sha1 sha2 sign sin size skewness slice some sort_array soundex split split_part sqrt startswith std stddev stddev_pop stddev_samp substr substring sum tan timestamp to_date to_timestamp to_char to_json to_number
    translate trim trunc try_divide ucase unix_timestamp upper var_pop var_samp variance weekofyear year current_date current_timestamp""".split()
)
#: Expressions that name a relation or a value by something else than its name.
NAMELESS = frozenset({"ExpressionWithUnresolvedIdentifier", "NamedParameter", "PosParameter", "FunctionTableSubqueryArgumentExpression", "LateralSubquery"})
PLAN_EXPRESSION = "org.apache.spark.sql.catalyst.expressions.PlanExpression"


class Rejected(ValueError):
    pass


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def inside(jvm, plan) -> Iterator[tuple[str, object]]:
    """('node' or 'expression', object) of the whole plan."""
    todo = [("node", plan)]
    while todo:
        kind, x = todo.pop()
        yield kind, x
        todo += [(kind, c) for c in items(x.children())]
        if kind == "node":
            todo += [("expression", e) for e in items(x.expressions())]
        elif jvm.py4j.reflection.TypeUtil.isInstanceOf(PLAN_EXPRESSION, x):
            todo.append(("node", x.plan()))


def relations(spark: SparkSession, sql: str) -> set[tuple[str, ...]]:
    """The parts of the names of all relations, wherever they stand; raises Rejected for anything that is not listed."""
    jvm = spark.sparkContext._jvm
    out = set()
    for kind, x in inside(jvm, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        name = x.getClass().getSimpleName().rstrip("$")
        if kind == "node":
            if name not in NODES:
                raise Rejected(f"{name} is not allowed")
            if name == "UnresolvedRelation":
                out.add(tuple(str(p).lower() for p in items(x.multipartIdentifier())))
        elif name in NAMELESS:
            raise Rejected(f"{name} is not allowed")
        elif name == "UnresolvedFunction":
            parts = [str(p).lower() for p in items(x.nameParts())]
            if len(parts) != 1 or parts[0] not in FUNCTIONS:
                raise Rejected(f"function {'.'.join(parts)} is not allowed")
    return out


def check(spark: SparkSession, sql: str, allowed: set[str], schemas: set[str] | frozenset[str] = frozenset()) -> str:
    """The statement without its end mark; raises Rejected with the reason."""
    if len(sql) > MAX_LENGTH:
        raise Rejected("the statement is too long")
    bare = sql.strip().rstrip(";").strip()
    outside = re.sub(r"'(?:[^']|'')*'", "''", bare)
    if ";" in outside:
        raise Rejected("one statement at a time")
    if not re.match(r"(?i)select\b", outside):
        raise Rejected("only SELECT")
    words = set(re.findall(r"[a-z_]+", outside.lower()))
    if bad := words & set(FORBIDDEN):
        raise Rejected(f"not allowed: {', '.join(sorted(bad))}")
    try:
        used = relations(spark, bare)
    except Rejected:
        raise
    except Exception as e:
        raise Rejected("the statement can't be parsed") from e
    for parts in used:
        *schema, table = parts
        if not (schema in ([], ["public"]) and table in allowed or len(schema) == 1 and schema[0] in schemas):
            raise Rejected(f"relation {'.'.join(parts)} is not allowed")
    return bare


def metadata_views(spark: SparkSession, allowed: set[str]) -> dict[str, str]:
    """information_schema.tables and .columns of the allowed views, as views of this session; what they stand for by name."""
    rows = [("public", t, c.name, c.dataType, i + 1) for t in sorted(allowed) if spark.catalog.tableExists(t) for i, c in enumerate(spark.catalog.listColumns(t))]
    columns = spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, data_type string, ordinal_position int")
    columns.createOrReplaceTempView("information_schema__columns")
    columns.select("table_schema", "table_name").distinct().createOrReplaceTempView("information_schema__tables")
    return {"information_schema.columns": "information_schema__columns", "information_schema.tables": "information_schema__tables"}


def rewritten(spark: SparkSession, sql: str, names: dict[tuple[str, ...], str]) -> str:
    """The statement with relations, and columns that are qualified by them, under other names. Each is replaced at the place that the parser gives for its plan node; nothing else of the text is touched."""
    jvm, spans = spark.sparkContext._jvm, {}
    for _, x in inside(jvm, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        name = x.getClass().getSimpleName()
        if name not in ("UnresolvedRelation", "UnresolvedAttribute"):
            continue
        parts = [str(p) for p in items(x.multipartIdentifier() if name == "UnresolvedRelation" else x.nameParts())]
        new = names.get(tuple(p.lower() for p in parts[:2])) if len(parts) > (name == "UnresolvedAttribute") + 1 else None
        start, stop = x.origin().startIndex(), x.origin().stopIndex()
        if new is None:
            continue
        if not (start.isDefined() and stop.isDefined()):
            raise Rejected("a relation's place is not known")
        spans[start.get(), stop.get() + 1] = ".".join(f"`{p}`" for p in (new, *parts[2:]))
    # the parser counts code points, as Python does
    for (start, stop), new in sorted(spans.items(), reverse=True):
        sql = sql[:start] + new + sql[stop:]
    return sql


def prepared(spark: SparkSession, sql: str, allowed: set[str]) -> str:
    """A checked statement that runs as it is: metadata relations are replaced by their views, `public.` goes."""
    bare = check(spark, sql, allowed, METADATA_SCHEMAS)
    if any(len(p) > 1 for p in relations(spark, bare)):
        views = metadata_views(spark, allowed)
        names = {("public", t): t for t in allowed} | {tuple(name.split(".")): view for name, view in views.items()}
        bare = rewritten(spark, bare, names)
        check(spark, bare, allowed | set(views.values()))
    return bare


def guarded_query(spark: SparkSession, sql: str, allowed: set[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """At most max_rows rows (1 to 1000) of a checked statement."""
    return spark.sql(prepared(spark, sql, allowed)).limit(min(max(max_rows, 1), MAX_ROWS_HARD))


def fetch(spark: SparkSession, sql: str, allowed: set[str], max_rows: int = MAX_ROWS) -> tuple[list, bool]:
    """(rows, whether there were more): one row more than asked is read to tell."""
    n = min(max(max_rows, 1), MAX_ROWS_HARD)
    rows = spark.sql(prepared(spark, sql, allowed)).limit(n + 1).collect()
    return rows[:n], len(rows) > n
