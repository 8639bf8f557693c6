from pyspark.sql import functions as F

from sparkloom.operators import lookup, traverse
from sparkloom.plans.build import build


def test_a_small_project(spark, tmp_path):
    (tmp_path / "shop" / "store").mkdir(parents=True)
    (tmp_path / "shop" / "api.py").write_text("from shop.store.db import save, load\n\n@app.route('/items')\ndef items():\n    check()\n    return save(load())\n\ndef check():\n    pass\n")
    (tmp_path / "shop" / "store" / "db.py").write_text("class Base:\n    def close(self):\n        pass\n\nclass Db(Base):\n    def run(self):\n        self.close()\n\ndef save(x):\n    return Db().run()\n\ndef load():\n    return 1\n")
    (tmp_path / "shop" / "ui.ts").write_text("import { draw } from './view';\nexport function show() {\n  draw();\n}\n")
    (tmp_path / "shop" / "view.ts").write_text("export function draw() {\n}\nclass A extends B {}\nclass B {}\n")
    cat = build(spark, str(tmp_path), "r")
    names = {r.id: r.name for r in cat.symbols.collect()}
    assert sorted(names.values()) == sorted(["items", "check", "Base", "close", "Db", "run", "save", "load", "show", "draw", "A", "B"])
    edges = {(names[r.src_id], names[r.dst_id], r.edge_kind) for r in cat.edges.collect()}
    assert edges == {("items", "check", "CALLS"), ("items", "save", "CALLS"), ("items", "load", "CALLS"), ("run", "close", "CALLS"), ("save", "Db", "CALLS"), ("save", "run", "CALLS"), ("show", "draw", "CALLS"), ("Db", "Base", "EXTENDS"), ("A", "B", "EXTENDS")}
    assert {(r.imported_name, r.confidence) for r in cat.imports.collect()} == {("save", 0.95), ("load", 0.95), ("draw", 0.95)}
    assert {r.name for r in traverse.callers(cat, "run", 3).collect()} == {"save", "items"}
    assert [(r.method, r.path, r.handler) for r in lookup.routes(cat).collect()] == [("GET", "/items", "items")]
    assert {r.name: names.get(r.owner_symbol_id) for r in cat.symbols.where(F.col("name").isin("run", "save")).collect()} == {"run": "Db", "save": None}
    assert lookup.repos(cat).first().files == 4
