"""Small graphs with results worked out by hand."""

import pytest

from sparkloom.operators import communities as g
from sparkloom.operators import lookup, sqlgate, traverse
from sparkloom.plans.catalog import from_tables, load
from sparkloom.plans.schema import conform, struct


def catalog(spark, calls, names=None, exported=(), **more):
    nodes = sorted({x for e in calls for x in e[:2]})
    names = names or {}
    symbols = spark.createDataFrame([(n, 1, names.get(n, f"s{n}"), f"m.s{n}", "Function", n, 0, n in exported, None, None) for n in nodes], struct("symbols"))
    edges = spark.createDataFrame([(i, a, b, "CALLS", float(c), 1, 1) for i, (a, b, c) in enumerate(calls)], struct("edges"))
    routes = spark.createDataFrame([], struct("routes"))
    files = spark.createDataFrame([(1, "a/b.py", 0, "python", 0, 0, "r")], struct("files"))
    return from_tables(spark, {"symbols": symbols, "edges": edges, "routes": routes, "files": files} | more)


def test_two_clusters(spark):
    dag = lambda ids: [(a, b, 1.0) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    label = {r.id: r.community for r in g.communities(catalog(spark, [*dag([1, 2, 3, 4]), *dag([5, 6, 7, 8]), (3, 5, 0.9)]), min_size=2).collect()}
    assert len(label) == 8 and len({label[i] for i in (1, 2, 3, 4)}) == 1 and label[1] != label[5] and len({label[i] for i in (5, 6, 7, 8)}) == 1


def test_call_chain(spark):
    cat = catalog(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1)], exported={1})
    assert [tuple(r) for r in g.processes(cat).collect()] == [(1, 4, "1>2>3>4")]
    assert [(r.step, r.symbol_id) for r in g.process_steps(g.processes(cat)).orderBy("step").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_closure_of_a_cycle(spark):
    cat = catalog(spark, [(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1), (4, 4, 1)])
    roots = spark.createDataFrame([(1,)], "root_id long")
    link = traverse.links(cat.edges)
    assert {(r.node_id, r.depth) for r in traverse.closure(roots, link, 8).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {(r.id, r.length) for r in traverse.call_cycles(cat, 6).collect()} == {(1, 3), (2, 3), (3, 3)}
    assert {(r.a, r.b) for r in traverse.cycle_pairs(cat).collect()} == {(1, 2), (1, 3), (2, 3)}
    with pytest.raises(ValueError):
        traverse.closure(roots, link, 99)


def test_closure_grows_with_depth(spark):
    link = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "root_id long")
    assert [traverse.closure(roots, link, d).count() for d in (1, 3, 4, 7, 10)] == [1, 3, 4, 7, 10]


def test_paths(spark):
    cat = catalog(spark, [(1, 2, 0.5), (2, 4, 0.5), (1, 3, 1), (3, 2, 1), (1, 4, 0.2)])
    assert [tuple(r) for r in traverse.trace_paths(cat, 1, 4).collect()] == [("1>4", 1, 0.2), ("1>2>4", 2, 0.25), ("1>3>2>4", 3, 0.5)]


@pytest.mark.parametrize(("rows", "root", "want"), [
    ([(1, "D", "B"), (2, "D", "C"), (3, "B", "A"), (4, "C", "A")], "D", "BCA"),
    ([(1, "G", "D"), (2, "G", "E"), (3, "G", "F"), (4, "D", "B"), (5, "E", "B"), (6, "E", "C"), (7, "F", "C"), (8, "B", "A"), (9, "C", "A")], "G", "DEBFCA"),
    ([(1, "A", "B"), (2, "B", "C"), (3, "C", "A")], "A", None),
])
def test_c3(spark, rows, root, want):
    h = spark.createDataFrame([(i, ord(a), ord(b)) for i, a, b in rows], "id long, child_symbol_id long, parent_symbol_id long")
    got = {r.class_id: r.order for r in g.c3(h).collect()}[ord(root)]
    assert got == (None if want is None else ",".join(str(ord(x)) for x in want))


def test_beam_keeps_whole_paths(spark):
    cat = catalog(spark, [(1, 2, 1), (2, 3, 1), (4, 3, 1)])
    got = {r.node: (r.path, r.cost, r.confidence) for r in g.beam(cat, spark.createDataFrame([(1,)], "id long"), 3, 2).collect()}
    assert got == {2: ("1>2", 1.0, 0.5), 3: ("1>2>3", 2.0, 0.333333), 4: ("1>2>3>4", 3.5, 0.222222)}
    assert g.targeted_beam(cat, 1, 4, 3, 2).count() == 1


def test_incremental_communities(spark):
    cat = catalog(spark, [(a, b, 1) for base in (0, 10, 20, 30, 40) for a in range(base, base + 4) for b in range(a + 1, base + 4)])
    label = g.communities(cat)
    again = g.update_communities(cat, label, spark.createDataFrame([(1,)], "id long"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, label.collect()))


def test_edges_batched_equal_single(spark):
    cat = catalog(spark, [(i, i + 1, 1) for i in range(600)])
    ids = cat.symbols.select("id")
    assert lookup.edges_of(cat, ids).count() == 600 and lookup.edges_of(cat, ids.where("id = 5")).count() == 2


def test_page(spark):
    df = spark.range(25).toDF("id")
    page = lookup.paginated(df, 20, 10).collect()
    assert [r.id for r in page] == [20, 21, 22, 23, 24] and not any(r.has_more for r in page)


def test_save_and_load(spark, tmp_path):
    cat = catalog(spark, [(1, 2, 1), (2, 3, 1)])
    cat.save(str(tmp_path), ["symbols", "edges"])
    back = load(spark, str(tmp_path))
    assert back.edges.count() == 2 and sorted(back.symbols.columns) == sorted(cat.symbols.columns)
    assert conform(back.edges.drop("line"), "edges").where("line IS NULL").count() == 2


def test_sql_gate(spark):
    cat = catalog(spark, [(1, 2, 1), (2, 3, 1)])
    tables = ["symbols", "edges", "files"]
    assert sqlgate.run(cat, "SELECT s.name, count(*) AS n FROM edges e JOIN symbols s ON s.id = e.src_id GROUP BY s.name HAVING count(*) > 0 ORDER BY n LIMIT 5", tables).count() == 2
    assert sqlgate.run(cat, "WITH x AS (SELECT id FROM symbols) SELECT * FROM x", tables).count() == 3
    for bad in ("DROP TABLE symbols", "INSERT INTO symbols VALUES (1)", "SET a = b", "SELECT * FROM secrets", "SELECT * FROM parquet.`/etc`", "CREATE TABLE t AS SELECT 1"):
        with pytest.raises(ValueError):
            sqlgate.run(cat, bad, tables)


def test_sql_gate_cannot_be_passed(spark):
    cat = catalog(spark, [(1, 2, 1), (2, 3, 1)])
    tables = ["symbols", "edges", "files"]
    here = "/root/testdata/sf0.001/orders.parquet"
    for bad in (
        f"/* parquet AS ( */ SELECT count(*) FROM parquet.`{here}`", f"WITH parquet AS (SELECT 1) SELECT * FROM parquet.`{here}`", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT try_reflect('a', 'b')", "SELECT current_user()", "SELECT * FROM symbols WHERE id IN (SELECT id FROM secrets)",
        "SELECT (SELECT max(x) FROM secrets) FROM symbols", "SELECT * FROM symbols s, LATERAL (SELECT * FROM secrets)", "SELECT * FROM (WITH c AS (SELECT 1 AS x) SELECT * FROM c) JOIN c ON true",
        "SELECT * FROM range(10)", "SELECT input_file_name() FROM symbols", "SELECT * FROM symbols LATERAL VIEW stack(1, 2) t AS y", "SELECT * FROM spark_catalog.default.symbols", "SHOW TABLES", "SELECT sum(reflect('a', 'b')) OVER () FROM symbols",
    ):
        with pytest.raises(ValueError):
            sqlgate.run(cat, bad, tables)
    good = "WITH a AS (SELECT id FROM symbols), b AS (SELECT * FROM a WHERE id IN (SELECT src_id FROM edges)) SELECT b.id, row_number() OVER (ORDER BY b.id) AS n FROM b WHERE EXISTS (SELECT 1 FROM edges e WHERE e.src_id = b.id)"
    assert sqlgate.run(cat, good, tables).count() == 2
    assert sqlgate.run(cat, "SELECT id, x FROM Symbols LATERAL VIEW explode(array(1, 2)) t AS x", tables).count() == 6
