"""Scope resolution: bindings up the scope chain, receivers, overloads, and types across files.

Everything is a join over ``resolve.scope_ancestors`` and one aggregation that keeps the best candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.resolve import scope_ancestors, strip_nullable
from sparkloom.operators.traverse import closure

SUPER, IMPLICIT = ("super", "base", "super()"), ("self", "this")


def lookup_binding(uses: DataFrame, scopes: DataFrame, bindings: DataFrame) -> DataFrame:
    """uses (id, scope_id, name) to the binding (scope_id, name, symbol_id) nearest up the scope chain: id, symbol_id, depth."""
    up = scope_ancestors(scopes)
    j = uses.join(up, "scope_id").join(bindings.select(F.col("scope_id").alias("ancestor_id"), "name", "symbol_id"), ["ancestor_id", "name"])
    return j.groupBy("id").agg(F.min(F.struct("depth", "symbol_id")).alias("m")).select("id", F.col("m.symbol_id").alias("symbol_id"), F.col("m.depth").alias("depth"))


def enclosing_class(uses: DataFrame, scopes: DataFrame) -> DataFrame:
    """uses (id, scope_id) to the symbol that owns the nearest scope of kind Class: id, class_id."""
    classes = scopes.where("kind = 'Class' AND owner_symbol_id IS NOT NULL").select(F.col("id").alias("ancestor_id"), F.col("owner_symbol_id").alias("class_id"))
    j = uses.join(scope_ancestors(scopes), "scope_id").join(classes, "ancestor_id")
    return j.groupBy("id").agg(F.min_by("class_id", "depth").alias("class_id"))


def reconcile_owners(symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """symbols with owner_symbol_id filled in for members whose scope is a class's own."""
    owner = scopes.where("kind = 'Class'").select(F.col("id").alias("scope_id"), F.col("owner_symbol_id").alias("o"))
    return symbols.join(owner, "scope_id", "left").withColumn("owner_symbol_id", F.coalesce("owner_symbol_id", F.when(F.col("o") != F.col("id"), F.col("o")))).select(*symbols.columns)


def owned_members(heritage: DataFrame, symbols: DataFrame, depth: int = 5) -> DataFrame:
    """class_id, name, symbol_id: members of each class, its own before its ancestors' by distance."""
    up = heritage.where("parent_symbol_id IS NOT NULL").select(F.col("child_symbol_id").alias("src"), F.col("parent_symbol_id").alias("dst")).distinct()
    members = symbols.where("owner_symbol_id IS NOT NULL").select(F.col("owner_symbol_id").alias("node_id"), "name", F.col("id").alias("symbol_id"))
    classes = members.select(F.col("node_id").alias("root_id")).union(up.select("src")).distinct()
    reach = closure(classes, up, depth).union(classes.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).cast("long").alias("depth")))
    j = reach.join(members, "node_id")
    return j.groupBy(F.col("root_id").alias("class_id"), "name").agg(F.min(F.struct("depth", "symbol_id")).alias("m")).select("class_id", "name", F.col("m.symbol_id").alias("symbol_id"), F.col("m.depth").alias("depth"))


def type_environment(annotations: DataFrame, constructors: DataFrame, assignments: DataFrame) -> DataFrame:
    """scope_id, name, type: a variable's type by annotation, else by a constructor call on its line or the one before, else from the variable it is assigned.

    annotations (scope_id, name, type), constructors (scope_id, line, type), assignments (scope_id, name, line, source).
    """
    a = annotations.select("scope_id", "name", F.lit(0).alias("tier"), strip_nullable(F.col("type")).alias("type"))
    c = assignments.select("scope_id", "name", F.explode(F.array(F.col("line"), F.col("line") - 1)).alias("at"), "line").join(constructors.select("scope_id", F.col("line").alias("at"), "type"), ["scope_id", "at"])
    known = a.union(c.select("scope_id", "name", (F.col("line") - F.col("at") + 1).cast("int").alias("tier"), "type"))
    best = known.groupBy("scope_id", "name").agg(F.min(F.struct("tier", "type")).alias("m")).select("scope_id", "name", F.col("m.tier").alias("tier"), F.col("m.type").alias("type"))
    copied = assignments.join(best.select("scope_id", F.col("name").alias("source"), "type"), ["scope_id", "source"]).select("scope_id", "name", F.lit(3).alias("tier"), "type")
    return best.union(copied).groupBy("scope_id", "name").agg(F.min(F.struct("tier", "type")).alias("m")).select("scope_id", "name", F.col("m.type").alias("type"))


def receiver_calls(calls: DataFrame, scopes: DataFrame, types: DataFrame, members: DataFrame, classes: DataFrame, heritage: DataFrame) -> DataFrame:
    """Calls with a receiver (id, scope_id, receiver, name) to members: id, symbol_id, confidence, how.

    In order: super (a parent's member, .85), self (a member of the class around, 1.0), the name of a class (1.0), a typed
    variable (.85). classes: (name, class_id); types: ``type_environment``; members: ``owned_members``.
    """
    m = members.select("class_id", "name", "symbol_id")
    own = enclosing_class(calls.select("id", "scope_id"), scopes)
    inside = calls.join(own, "id")
    parent = heritage.where("parent_symbol_id IS NOT NULL").groupBy(F.col("child_symbol_id").alias("class_id")).agg(F.min_by("parent_symbol_id", "id").alias("parent_id"))
    sup = inside.where(F.col("receiver").isin(*SUPER)).join(parent, "class_id").select("id", "name", F.col("parent_id").alias("class_id"), F.lit(0).alias("tier"), F.lit(0.85).alias("confidence"), F.lit("super").alias("how"))
    this = inside.where(F.col("receiver").isin(*IMPLICIT)).select("id", "name", "class_id", F.lit(1).alias("tier"), F.lit(1.0).alias("confidence"), F.lit("self").alias("how"))
    named = calls.join(classes.select(F.col("name").alias("receiver"), "class_id"), "receiver").select("id", "name", "class_id", F.lit(2).alias("tier"), F.lit(1.0).alias("confidence"), F.lit("class").alias("how"))
    t = calls.join(scope_ancestors(scopes), "scope_id").join(types.select(F.col("scope_id").alias("ancestor_id"), F.col("name").alias("receiver"), "type"), ["ancestor_id", "receiver"])
    t = t.groupBy("id", "name").agg(F.min_by("type", "depth").alias("type")).join(classes.select(F.col("name").alias("type"), "class_id"), "type").select("id", "name", "class_id", F.lit(3).alias("tier"), F.lit(0.85).alias("confidence"), F.lit("type").alias("how"))
    j = sup.union(this).union(named).union(t).join(m, ["class_id", "name"])
    return j.groupBy("id").agg(F.min(F.struct("tier", "symbol_id", "confidence", "how")).alias("m")).select("id", "m.symbol_id", "m.confidence", "m.how")


def free_calls(calls: DataFrame, scopes: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls without a receiver: up the scope chain, else the least definition outside a class; confidence .85."""
    near = lookup_binding(calls, scopes, bindings).select("id", F.lit(0).alias("tier"), "symbol_id")
    top = symbols.where("owner_symbol_id IS NULL").groupBy("name").agg(F.min("id").alias("symbol_id"))
    far = calls.join(top, "name").select("id", F.lit(1).alias("tier"), "symbol_id")
    return near.union(far).groupBy("id").agg(F.min(F.struct("tier", "symbol_id")).alias("m")).select("id", F.col("m.symbol_id").alias("symbol_id"), F.lit(0.85).alias("confidence"))


def compound_receivers(calls: DataFrame, fields: DataFrame, roots: DataFrame, segments: int = 4) -> DataFrame:
    """a.b.c receivers (id, receiver) to the type at their end: roots (name, type) start, fields (type, name, field_type) go on."""
    level = calls.select("id", F.split("receiver", r"\.").alias("s")).join(roots.toDF("root", "type"), F.col("s")[0] == F.col("root")).select("id", "s", "type")
    done = level.where(F.size("s") == 1)
    f = fields.toDF("type", "field", "next")
    for i in range(1, segments):
        level = level.where(F.size("s") > i).join(f, "type").where(F.col("s")[i] == F.col("field")).select("id", "s", F.col("next").alias("type"))
        done = done.union(level.where(F.size("s") == i + 1))
    return done.select("id", "type")


def narrow_overloads(candidates: DataFrame) -> DataFrame:
    """candidates (id, symbol_id, arity, arguments): those whose arity fits or is unknown, all of them where none fits."""
    fits = candidates.where(F.col("arity").isNull() | F.col("arguments").isNull() | (F.col("arity") == F.col("arguments")))
    return fits.unionByName(candidates.join(fits.select("id").distinct(), "id", "left_anti")).select("id", "symbol_id")


def reference_edges(references: DataFrame) -> DataFrame:
    """references (src, dst, kind, confidence) once each, no self loops, with the best confidence."""
    return references.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))
