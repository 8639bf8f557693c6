from pyspark.sql import functions as F

from sparkloom.operators import knowledge as k
from sparkloom.operators import scopes as s


def test_chain_receivers_and_types(spark):
    # file 1 > class A 2 > method 3; class B 4 (parent of A) in file 1
    scopes = spark.createDataFrame([(1, None, None, "Module"), (2, 1, 100, "Class"), (3, 2, 110, "Function"), (4, 1, 200, "Class")], "id long, parent_id long, owner_symbol_id long, kind string")
    symbols = spark.createDataFrame([(100, "A", 1, None), (200, "B", 1, None), (110, "run", 2, None), (210, "save", 4, None), (211, "run", 4, None), (300, "helper", 1, None)], "id long, name string, scope_id long, owner_symbol_id long")
    symbols = s.reconcile_owners(symbols, scopes)
    assert {r.id: r.owner_symbol_id for r in symbols.collect()} == {100: None, 200: None, 110: 100, 210: 200, 211: 200, 300: None}
    heritage = spark.createDataFrame([(1, 100, 200)], "id long, child_symbol_id long, parent_symbol_id long")
    members = s.owned_members(heritage, symbols)
    assert {(r.class_id, r.name): r.symbol_id for r in members.collect()} == {(100, "run"): 110, (100, "save"): 210, (200, "save"): 210, (200, "run"): 211}
    classes = symbols.where("name IN ('A', 'B')").select("name", F.col("id").alias("class_id"))
    types = s.type_environment(spark.createDataFrame([(1, "x", "B?")], "scope_id long, name string, type string"), spark.createDataFrame([(3, 7, "A")], "scope_id long, line long, type string"), spark.createDataFrame([(3, "y", 8, "?"), (3, "z", 20, "y")], "scope_id long, name string, line long, source string"))
    assert {(r.scope_id, r.name): r.type for r in types.collect()} == {(1, "x"): "B", (3, "y"): "A", (3, "z"): "A"}
    calls = spark.createDataFrame([(1, 3, "self", "save"), (2, 3, "super", "run"), (3, 3, "x", "run"), (4, 1, "B", "save"), (5, 3, "y", "run"), (6, 1, "q", "run")], "id long, scope_id long, receiver string, name string")
    got = {r.id: (r.symbol_id, r.confidence, r.how) for r in s.receiver_calls(calls, scopes, types, members, classes, heritage).collect()}
    assert got == {1: (210, 1.0, "self"), 2: (211, 0.85, "super"), 3: (211, 0.85, "type"), 4: (210, 1.0, "class"), 5: (110, 0.85, "type")}
    free = s.free_calls(spark.createDataFrame([(1, 3, "run"), (2, 3, "helper"), (3, 1, "none")], "id long, scope_id long, name string"), scopes, symbols.select("scope_id", "name", F.col("id").alias("symbol_id")), symbols)
    assert {r.id: r.symbol_id for r in free.collect()} == {1: 110, 2: 300}


def test_compound_and_overloads(spark):
    calls = spark.createDataFrame([(1, "a.b.c"), (2, "a"), (3, "a.z")], "id long, receiver string")
    fields = spark.createDataFrame([("A", "b", "B"), ("B", "c", "C")], "type string, name string, field_type string")
    assert {(r.id, r.type) for r in s.compound_receivers(calls, fields, spark.createDataFrame([("a", "A")], "name string, type string")).collect()} == {(1, "C"), (2, "A")}
    c = spark.createDataFrame([(1, 10, 2, 2), (1, 11, 3, 2), (2, 12, 1, 5), (3, 13, None, 1)], "id long, symbol_id long, arity int, arguments int")
    assert {tuple(r) for r in s.narrow_overloads(c).collect()} == {(1, 10), (2, 12), (3, 13)}
    e = spark.createDataFrame([(1, 2, "CALLS", 0.5), (1, 2, "CALLS", 0.9), (1, 1, "CALLS", 1.0), (None, 2, "CALLS", 1.0)], "src long, dst long, kind string, confidence double")
    assert [tuple(r) for r in s.reference_edges(e).collect()] == [(1, 2, "CALLS", 0.9)]


def test_tree_paths(spark):
    link = k.folders(spark.createDataFrame([("r/a/x.py",), ("r/a/y.py",), ("r/b/c/z.py",)], "path string"))
    assert k.shortest_path(link, "r/a/x.py", "r/b/c/z.py").first() == ("r/a/x.py > r/a > r > r/b > r/b/c > r/b/c/z.py", 5)
    assert k.shortest_path(link, "r", "r").first().hops == 0 and k.shortest_path(link, "r", "nowhere").count() == 0


def test_layers(spark, sf):
    from sparkloom.plans.catalog import from_test_tables

    rel = k.relationships(from_test_tables(spark, sf))
    assert sum(k.layer(rel, n).count() for n in k.LAYERS) == rel.count()
    node = rel.first().src
    assert k.incident(rel, node).count() + k.without_node(rel, node).count() == rel.count()
