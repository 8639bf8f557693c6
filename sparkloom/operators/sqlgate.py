"""SELECT-only SQL over the catalog, judged by its parsed plan and never by its text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkloom.plans.catalog import Catalog

ALLOWED = frozenset("Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation OneRowRelation UnresolvedWith UnresolvedHaving Window UnresolvedHint LocalRelation UnresolvedSubqueryColumnAliases WithWindowDefinition UnresolvedInlineTable LateralJoin Generate Pivot".split())
#: Functions of the values of a row, of groups and of windows; none of them reads files, calls other code or shows the session.
FUNCTIONS = frozenset("""abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_sort array_union arrays_zip
ascii asin atan avg bit_length bool_and bool_or cbrt ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if cume_dist date_add date_diff date_format date_sub date_trunc datediff
day dayofmonth dayofweek dayofyear decode dense_rank element_at endswith every exists exp explode explode_outer filter find_in_set first first_value flatten floor forall format_number from_unixtime get greatest hash hex hour if ifnull initcap instr isnan
isnotnull isnull lag last last_day last_value lcase lead least left len length levenshtein listagg ln locate log log10 log2 lower lpad ltrim map map_contains_key map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between
named_struct nanvl negative ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod posexplode position pow power quarter rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regexp_substr repeat replace reverse
right rint rlike round row_number rpad rtrim second sequence sha2 sign signum sin size skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string_agg struct substr substring substring_index sum tan to_date
to_timestamp transform translate trim trunc try_divide ucase unhex unix_timestamp upper var_pop var_samp variance weekday weekofyear xxhash64 year zip_with""".split())


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _expression(e, tables: frozenset[str], read: set[str]) -> None:
    kind = _kind(e)
    if kind == "UnresolvedFunction" or kind == "UnresolvedGenerator":
        parts = _items(e.nameParts()) if kind == "UnresolvedFunction" else [e.name().unquotedString()]
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise ValueError(f"not allowed in a query: {'.'.join(parts)}()")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _plan(e.plan(), tables, read)
    elif "Subquery" in kind and kind != "InSubquery":
        raise ValueError(f"not allowed in a query: {kind}")
    for child in _items(e.children()):
        _expression(child, tables, read)


def _plan(node, tables: frozenset[str], read: set[str]) -> None:
    """Raises ValueError for what isn't allowed; adds the names of relations to ``read``. ``tables`` are those in scope."""
    kind = _kind(node)
    if kind not in ALLOWED:
        raise ValueError(f"not allowed in a query: {kind}")
    if kind == "UnresolvedRelation":
        parts = _items(node.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in tables:
            raise ValueError(f"no such table: {'.'.join(parts)}")
        read.add(parts[0].lower())
    if kind == "UnresolvedWith":
        for cte in _items(node.cteRelations()):  # one sees those before it, and itself where the query is recursive
            name = cte._1().lower()
            _plan(cte._2(), tables | {name} if node.allowRecursion() else tables, read)
            tables = tables | {name}
    for e in _items(node.expressions()):
        _expression(e, tables, read)
    for child in _items(node.children()):
        _plan(child, tables, read)


def run(cat: Catalog, sql: str, tables: list[str]) -> DataFrame:
    """The result of a query over some of the catalog's tables.

    Raises ValueError if its parsed plan has a node other than those of queries, reads a relation that is neither
    one of ``tables`` nor a common table expression in scope, or calls a function that isn't in ``FUNCTIONS``.
    """
    parsed = cat.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    read: set[str] = set()
    _plan(parsed, frozenset(t.lower() for t in tables), read)
    cat.register([t for t in tables if t.lower() in read])
    return cat.spark.sql(sql)
