import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.operators import evidence as e
from sparkloom.operators import resolve, search
from sparkloom.plans.catalog import from_tables
from sparkloom.plans.schema import conform, struct


def test_patterns(spark):
    kinds = ["ImportEdge", "SymbolDeclaration", "FunctionCall"]
    rows = [(f, k, i) for f, n in (("a.rs", 3), ("b.rs", 3), ("c.rs", 2)) for i, k in enumerate(kinds[:n])]
    df = spark.createDataFrame([(f"{f}{i}", f, k, i, i) for f, k, i in rows], "id string, file string, kind string, timestamp_ms long, event_id long")
    got = {(r.a, r.b): (r.frequency, r.dispersion) for r in e.mine_patterns(from_tables(spark, {"evidence": df}), 2).collect()}
    assert got == {("ImportEdge", "SymbolDeclaration"): (3, 1.0), ("ImportEdge", "FunctionCall"): (2, 0.666667), ("SymbolDeclaration", "FunctionCall"): (2, 0.666667)}


def test_boundary(spark):
    files = spark.createDataFrame([(1, "ui/a.py"), (2, "services/b.py"), (3, "repositories/c.py")], "id long, path string")
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 1, 3)], "id long, src_id long, dst_id long").withColumn("edge_kind", F.lit("CALLS"))
    cat = from_tables(spark, {"files": files, "symbols": files.select("id", F.col("id").alias("file_id")), "edges": edges})
    layers = [("presentation", ["ui/"]), ("domain", ["services/"]), ("data", ["repositories/"])]
    rules = [("pres-domain", "presentation", "domain", True), ("domain-data", "domain", "data", True), ("pres-no-data", "presentation", "data", False), ("data-no-pres", "data", "presentation", False)]
    assert [(r.rule, r.from_file, r.to_file) for r in e.boundary_violations(cat, layers, rules).collect()] == [("pres-no-data", "ui/a.py", "repositories/c.py")]


def test_entropy(spark):
    rows = [("", 1.0), ("aaaa", 0.0), ("ab", 1.0), ("aab", -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))]
    df = spark.createDataFrame(rows, "t string, want double").select("want", scores.character_entropy(F.col("t")).alias("got"))
    assert all(abs(r.want - r.got) < 1e-9 for r in df.collect())


def test_calibration_bounds(spark):
    df = spark.createDataFrame([(True, True, 1.0, 0.0), (True, False, 1.0, 0.0), (False, True, 1.0, 0.0), (True, True, 5.0, 0.0), (False, True, 5.0, 0.0), (True, True, 1.0, 1.0)], "b boolean, r boolean, s double, e double")
    got = [round(r[0], 6) for r in df.select(scores.calibrated(F.col("b"), F.col("r"), F.col("s"), F.col("e"))).collect()]
    assert got == [0.9, 0.585, 0.4, 1.0, 0.6, 0.765]


def test_resolution_confidence(spark):
    df = spark.createDataFrame([(True, False, 0, None, True, True), (True, True, 3, None, None, True), (False, False, 0, 0, False, True), (True, False, 0, None, None, False), (False, False, 2, None, False, True)], "local boolean, imp boolean, depth int, mro int, arity boolean, linked boolean")
    got = [round(r[0], 6) for r in df.select(resolve.confidence({"local": F.col("local"), "import": F.col("imp")}, F.col("depth"), F.col("mro"), F.col("arity"), F.col("linked"))).collect()]
    assert got == [0.65, 0.94, 0.35, 0.275, 0.0]


def test_nullable_types(spark):
    df = spark.createDataFrame([("Foo?",), ("Foo | null",), ("Optional[Foo]",), ("Option<Foo>",), ("Foo",)], "t string")
    assert {r[0] for r in df.select(resolve.strip_nullable(F.col("t"))).collect()} == {"Foo"}


def test_scope_walk(spark):
    scopes = spark.createDataFrame([(1, None, 100), (2, 1, None), (3, 2, 300), (4, 3, None)], "id long, parent_id long, owner_symbol_id long")
    calls = spark.createDataFrame([(10, 2), (11, 4), (12, 3)], "id long, caller_scope_id long")
    assert {(r.id, r.caller_symbol_id) for r in resolve.owning_symbol(calls, scopes).collect()} == {(10, 100), (11, 300), (12, 300)}


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("a", 1, 50), ("a", 2, 60), ("a", 3, 45), ("b", 1, 500), ("b", 2, 1)], "g string, o int, c int")
    got = {(r.g, r.place, r.cost) for r in search.within_budget(df, "g", [F.col("o")], "c", 100).collect()}
    assert got == {("a", 0, 50), ("a", 2, 45), ("b", 0, 500)}


def test_synonyms_and_boundaries(spark):
    df = spark.createDataFrame([("login_user",), ("user_auth",), ("auth",), ("batch",), ("authorize",), ("doLogin",)], "name string")
    got = {r.name: r.s for r in df.select("name", search.relevance(F.col("name"), "auth").alias("s")).collect()}
    assert got == {"login_user": 0.5, "user_auth": 0.4, "auth": 1.0, "batch": 0.0, "authorize": 0.7, "doLogin": 0.5}


def test_search_ranks_the_exact_name_first(spark):
    rows = [(1, 1, "login", "src.auth.login", "Function", 1, 0, True, None, None), (2, 1, "logout", "src.auth.logout", "Function", 2, 0, True, None, None), (3, 1, "validate_token", "src.auth.validate_token", "Function", 3, 0, False, None, None)]
    cat = from_tables(spark, {"symbols": spark.createDataFrame(rows, struct("symbols"))})
    assert search.search(cat, "login").orderBy(F.desc("score")).first().name == "login"
    assert search.search(cat, "auth").count() == 3


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 2.0], [2.0, 4.0], 1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 1.0], 0.0)], "a array<float>, b array<float>, want double")
    assert all(abs(r.want - r.got) < 1e-6 for r in df.select("want", search.cosine(F.col("a"), F.col("b")).alias("got")).collect())


def test_merge_is_idempotent(spark, sf):
    from sparkloom.plans.catalog import from_test_tables

    ev = from_test_tables(spark, sf).evidence
    once = e.normalise_and_merge(ev, ["kind", "file", "normalized"])
    assert once.count() == e.normalise_and_merge(once, ["kind", "file", "normalized"]).count()
    assert conform(ev, "evidence").columns == struct("evidence").fieldNames()


@pytest.mark.parametrize(("score", "tier"), [(0, "LOW"), (5, "LOW"), (6, "MEDIUM"), (16, "HIGH"), (41, "CRITICAL")])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(scores.impact_tier(F.lit(score))).first()[0] == tier


def test_snippet_and_slug(spark):
    df = spark.createDataFrame([("a\nb\nc\nd", "Hello, World & Co")], "t string, h string")
    assert df.select(search.snippet(F.col("t"), F.lit(2), 1)).first()[0] == "  1: a\n> 2: b\n  3: c"
    assert df.select(scores.slug(F.col("h"))).first()[0] == "hello-world-co"
    assert df.select(scores.permissions(F.lit(0o754))).first()[0] == "rwxr-xr--"
