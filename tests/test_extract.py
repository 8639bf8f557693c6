import os
import subprocess

from pyspark.sql import functions as F

from sparkloom.operators import extract as x
from sparkloom.sources import files, git, reports


def source(spark, **rows):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in rows.items()], "path string, content string")


def test_orm(spark):
    df = source(spark, a_dot_ts="const u = await prisma.user.findMany()\nsupabase.from('users').select('*')\nprisma.$transaction([])")
    assert {(r.line, r.orm, r.model, r.operation) for r in x.orm_queries(df).collect()} == {(1, "prisma", "user", "findMany"), (2, "supabase", "users", "select")}


def test_markdown(spark):
    df = source(spark, a_dot_md="# One two #\ntext [x](b.md#here) ![i](p.png) [y](https://e.org)\n####### no\n### Três!\n[z](#end)")
    assert {(r.line, r.level, r.heading, r.slug) for r in x.markdown_headings(df).collect()} == {(1, 1, "One two", "one-two"), (4, 3, "Três!", "três")}
    assert {(r.target, r.anchor) for r in x.markdown_links(df).collect()} == {("b.md", "here"), ("", "end")}


def test_cobol(spark):
    pad = "000100 "
    df = source(spark, a_dot_cbl="\n".join([f"{pad}IDENTIFICATION DIVISION.", f"{pad}MAIN-PARA.", f"{pad}    CALL 'SUB1'.", f"{pad}    PERFORM MAIN-PARA.", f"{pad}    COPY BOOK.", "000200*    CALL 'NO'."]))
    assert tuple(x.cobol_counts(df).first())[1:] == (1, 0, 1, 1, 1, 1)
    jcl = source(spark, a_dot_jcl="//J1 JOB (1)\n//* note\n//S1 EXEC PGM=A\n//D DD DSN=X\n// DD DSN=Y")
    assert tuple(x.jcl_counts(jcl).first())[1:] == (1, 1, 2)


def test_routes(spark):
    df = spark.createDataFrame([
        ("app/api/users/[id]/route.ts", ""), ("pages/api/users.ts", ""), ("a.js", "router.get('/x', f)"), ("b.py", "@app.route('/y', methods=['POST'])\n@bp.get('/z')"),
        ("c.rs", '.route("/w", get(h))\n#[post("/v")]'), ("d.rb", "  get '/u', to: 'a#b'"),
    ], "path string, content string")
    assert {(r.method, r.path, r.framework) for r in x.routes(df).collect()} == {
        ("ANY", "/api/users/[id]", "nextjs"), ("ANY", "/api/users", "nextjs"), ("GET", "/x", "express"), ("POST", "/y", "flask"), ("GET", "/z", "flask"), ("GET", "/w", "axum"), ("POST", "/v", "actix"), ("GET", "/u", "rails")}


def test_definitions_of_languages(spark):
    rows = {"a.ts": "export class A {}\ninterface B {}\nfunction c() {}", "a.rs": "pub fn f() {}\nstruct S;", "a.go": "func (r *T) M() {}\ntype U struct {", "a.java": "public class J {\n  public int run() {", "a.kt": "fun k() {}", "a.swift": "func s() {}",
            "a.rb": "class R\n  def m?\n", "a.php": "function p() {}", "a.sh": "go() {\n", "a.c": "int main(void) {\n", "a.cpp": "class X {\n", "a.cs": "class Y {", "a.dart": "class Z {", "a.yaml": "key: 1", "a.json": '  "k": 1', "a.txt": "class No"}
    got = {(r.path, r.name) for r in x.definitions(spark.createDataFrame(list(rows.items()), "path string, content string")).collect()}
    want = {("a.ts", "A"), ("a.ts", "B"), ("a.ts", "c"), ("a.rs", "f"), ("a.rs", "S"), ("a.go", "M"), ("a.go", "U"), ("a.java", "J"), ("a.java", "run"), ("a.kt", "k"), ("a.swift", "s"), ("a.rb", "R"), ("a.rb", "m?"), ("a.php", "p"), ("a.sh", "go"), ("a.c", "main"), ("a.cpp", "X"), ("a.cs", "Y"), ("a.dart", "Z"), ("a.yaml", "key"), ("a.json", "k")}
    assert got == want


def test_python_tree(spark):
    df = spark.createDataFrame([("a.py", "class A(B):\n    def m(self):\n        def inner(): pass\n\nasync def f(): pass\n"), ("bad.py", "def ("), ("n.py", None)], "path string, content string")
    assert {(r.kind, r.qualified_name, r.line, tuple(r.parents)) for r in x.python_definitions(df).collect()} == {("Class", "A", 1, ("B",)), ("Method", "A.m", 2, ()), ("Function", "A.m.inner", 3, ()), ("Function", "f", 5, ())}


def test_tree_and_changes(spark, tmp_path):
    root = tmp_path / "r"
    (root / "src" / "deep").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src" / "a.py").write_text("x = 1\n")
    (root / "src" / "deep" / "b.rs").write_text("fn f() {}\n")
    (root / "src" / "bad.py").write_bytes(b"\xff\xfe\xff")
    (root / "src" / "note.txt").write_text("n")
    (root / ".hid").write_text("h")
    (root / "run.sh").write_text("go() {\n")
    os.chmod(root / "run.sh", 0o755)
    os.symlink("run.sh", root / "link")
    nodes = files.scan(spark, str(root), "r1")
    got = {r.path: r for r in nodes.collect()}
    assert set(got) == {"src", ".hid", "run.sh", "link", "src/a.py", "src/bad.py", "src/note.txt", "src/deep", "src/deep/b.rs"}
    assert got["run.sh"].is_exec and got["link"].is_symlink and got[".hid"].is_hidden and got["src"].is_dir and got["src/a.py"].size == 6
    assert {(r.u, r.v) for r in files.tree_edges(nodes).collect()} >= {("src", "src/a.py"), ("src/deep", "src/deep/b.rs")}
    assert files.scan(spark, str(root), most=3).count() == 3 and files.scan(spark, str(root), maxdepth=1).count() == 4
    assert files.scan_group(spark, {"x": str(root), "y": str(root)}).count() == 18
    before = files.sources(spark, str(root))
    assert {r.path for r in before.collect()} == {"src/a.py", "src/deep/b.rs", "run.sh"}
    old = spark.createDataFrame(before.select("path", "hash").collect(), "path string, hash long")
    (root / "src" / "a.py").write_text("x = 2\n")
    (root / "src" / "c.go").write_text("package c\n")
    os.remove(root / "run.sh")
    status = {r.path: r.status for r in files.changes(old, files.sources(spark, str(root))).collect()}
    assert status == {"src/a.py": "updated", "src/c.go": "added", "run.sh": "removed", "src/deep/b.rs": "unchanged"}


def test_removal_cascades(spark):
    t = {
        "files": spark.createDataFrame([(1,), (2,)], "id long"), "symbols": spark.createDataFrame([(10, 1), (20, 2)], "id long, file_id long"),
        "edges": spark.createDataFrame([(1, 10, 20, 1), (2, 20, 10, 2), (3, 20, 20, 2)], "id long, src_id long, dst_id long, file_id long"),
    }
    out = files.remove_files(t, spark.createDataFrame([(1,)], "f long"))
    assert [r.id for r in out["edges"].collect()] == [3] and out["files"].count() == out["symbols"].count() == 1


def test_git(spark, tmp_path):
    def run(*a, when="2024-01-01T00:00:00Z"):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True, env=os.environ | {"GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when})

    run("init")
    (tmp_path / "a.txt").write_text("1\n2\n")
    run("add", ".")
    run("commit", "-m", "first")
    (tmp_path / "a.txt").write_text("1\n3\n4\n")
    run("commit", "-am", "second", when="2024-02-01T00:00:00Z")
    commits, changed = git.history(spark, str(tmp_path))
    assert [(r.author_name, r.message) for r in commits.orderBy("timestamp").collect()] == [("Ann", "first"), ("Ann", "second")]
    assert {(r.lines_added, r.lines_removed, r.is_creation) for r in changed.collect()} == {(2, 0, True), (2, 1, False)}
    lines = git.blame(spark, str(tmp_path), "a.txt").orderBy("line_number").collect()
    assert len(lines) == 3 and lines[0].commit_hash != lines[1].commit_hash == lines[2].commit_hash


def test_reports(spark, tmp_path):
    p = tmp_path / "rules.json"
    p.write_text('{"layers": [{"name": "ui", "paths": ["ui/"]}], "rules": [{"name": "r", "from": "ui", "to": "db", "allowed": false}]}')
    assert reports.boundary_rules(spark, str(p)) == ([("ui", ["ui/"])], [("r", "ui", "db", False)])
    e = spark.createDataFrame([("a", 'b"c', "CALLS")], "src string, dst string, label string")
    assert [r.value for r in reports.dot(e).collect()] == ["digraph g {", '  "a" -> "b\\"c" [label="CALLS"];', "}"]
    f = spark.createDataFrame([("dead", "unused", "a.py", 3)], "rule string, message string, path string, line long")
    assert '"ruleId":"dead"' in reports.sarif(f).first().value
    assert reports.json_lines(f).first().value == '{"line":3,"message":"unused","path":"a.py","rule":"dead"}'
    assert x.tool_like(f.select(F.lit("run_command").alias("name"))).first().n == 1
