"""Extractors: lines of source text to table rows. All of it is Spark SQL expressions but for Python's own syntax tree."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scores import slug

EXTENSIONS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "hh": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "sh": "bash", "bash": "bash", "dart": "dart", "json": "json", "yaml": "yaml", "yml": "yaml",
}
#: language -> (kind, pattern with the name as its group); approximations line by line
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "typescript": [("Class", r"\bclass\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Function", r"\bfunction\s*\*?\s*(\w+)"), ("Function", r"\b(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("Enum", r"\benum\s+(\w+)"), ("Type", r"\btype\s+(\w+)\s*=")],
    "rust": [("Function", r"\bfn\s+(\w+)"), ("Struct", r"\bstruct\s+(\w+)"), ("Enum", r"\benum\s+(\w+)"), ("Trait", r"\btrait\s+(\w+)")], "go": [("Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("Struct", r"^type\s+(\w+)\s+struct"), ("Interface", r"^type\s+(\w+)\s+interface")],
    "java": [("Class", r"\bclass\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Method", r"^\s+(?:public|private|protected)[\w\s<>\[\],]*\s(\w+)\s*\(")], "csharp": [("Class", r"\bclass\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Method", r"^\s+(?:public|private|protected|internal)[\w\s<>\[\],]*\s(\w+)\s*\(")],
    "kotlin": [("Class", r"\bclass\s+(\w+)"), ("Function", r"\bfun\s+(\w+)")], "swift": [("Class", r"\bclass\s+(\w+)"), ("Struct", r"\bstruct\s+(\w+)"), ("Function", r"\bfunc\s+(\w+)")], "dart": [("Class", r"\bclass\s+(\w+)"), ("Function", r"^\s*(?:[\w<>?]+\s+)(\w+)\s*\([^)]*\)\s*(?:async\s*)?\{")],
    "php": [("Class", r"\bclass\s+(\w+)"), ("Function", r"\bfunction\s+(\w+)")], "ruby": [("Class", r"^\s*class\s+(\w+)"), ("Module", r"^\s*module\s+(\w+)"), ("Method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")], "bash": [("Function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{")],
    "c": [("Struct", r"\bstruct\s+(\w+)\s*\{"), ("Function", r"^[\w\s*]+?\b(\w+)\s*\([^;]*\)\s*\{")], "cpp": [("Class", r"\bclass\s+(\w+)"), ("Struct", r"\bstruct\s+(\w+)\s*\{"), ("Function", r"^[\w\s*:<>&]+?\b(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{")],
    "json": [("Key", r'^\s*"([^"]+)"\s*:')], "yaml": [("Key", r"^\s*([\w.-]+)\s*:")],
}
DEFINITIONS["javascript"] = DEFINITIONS["tsx"] = DEFINITIONS["typescript"]
VISIBILITY = r"^\s*(?:export\b|pub\b|public\b|open\b)"


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, v: k == F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))), 0), F.lit("unknown"))


def lines(files: DataFrame) -> DataFrame:
    """files (path, content) to path, language, line (from 1), text."""
    return files.select("path", language_of(F.col("path")).alias("language"), F.posexplode(F.split("content", "\n")).alias("i", "text")).select("path", "language", (F.col("i") + 1).cast("long").alias("line"), "text")


def definitions(files: DataFrame) -> DataFrame:
    """path, line, kind, name, is_exported for the languages in ``DEFINITIONS``; once for each (path, line, name)."""
    rows = lines(files)
    out = None
    for language, patterns in DEFINITIONS.items():
        found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("name"), F.lit(i).alias("ord")) for i, (k, p) in enumerate(patterns)))
        out = F.when(F.col("language") == language, found) if out is None else out.when(F.col("language") == language, found)
    hits = rows.select("path", "line", "text", F.explode(out).alias("d")).where("d.name <> ''")
    g = hits.groupBy("path", "line", F.col("d.name").alias("name")).agg(F.min(F.struct("d.ord", "d.kind")).alias("m"), F.bool_or(F.col("text").rlike(VISIBILITY)).alias("is_exported"))
    return g.select("path", "line", F.col("m.kind").alias("kind"), "name", "is_exported")


def python_definitions(files: DataFrame) -> DataFrame:
    """path, kind, name, qualified_name, line, parents of Python files by the syntax tree; a file that doesn't parse has none."""

    def walk(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                stack = [(tree, "")]
                while stack:
                    node, prefix = stack.pop()
                    for child in ast.iter_child_nodes(node):
                        if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                            name = f"{prefix}{child.name}"
                            kind = "Class" if isinstance(child, ast.ClassDef) else "Method" if isinstance(node, ast.ClassDef) else "Function"
                            parents = [ast.unparse(b) for b in getattr(child, "bases", [])]
                            rows.append((path, kind, child.name, name, child.lineno, parents))
                            stack.append((child, f"{name}."))
                        else:
                            stack.append((child, prefix))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "qualified_name", "line", "parents"])

    py = files.where(F.lower("path").endswith(".py")).select("path", "content")
    return py.mapInPandas(walk, "path string, kind string, name string, qualified_name string, line long, parents array<string>")


def routes(files: DataFrame) -> DataFrame:
    """method, path, file_path, framework, line: routes by the file's place and by the calls and decorators of several frameworks."""
    p = F.col("path")
    app = F.regexp_extract(p, r"(?:^|/)app/(.*?)/?route\.(?:ts|js)x?$", 1)
    pages = F.regexp_extract(p, r"(?:^|/)pages/(api/.*?)(?:/index)?\.(?:ts|js)x?$", 1)
    by_path = files.select(F.lit("ANY").alias("method"), F.when(p.rlike(r"(?:^|/)app/.*route\.(ts|js)x?$"), F.concat(F.lit("/"), app)).when(pages != "", F.concat(F.lit("/"), pages)).alias("route"), p.alias("file_path"), F.lit("nextjs").alias("framework"), F.lit(1).cast("long").alias("line")).where("route IS NOT NULL")
    rows = lines(files)
    t = F.col("text")
    by_line = rows.select("path", "line", "text", F.explode(F.array(
        _route("express", t, r"""\b(?:app|router)\.(get|post|put|delete|patch|head|options|all)\s*\(\s*['"`]([^'"`]+)['"`]""", F.col("language").isin("javascript", "typescript", "tsx")),
        _route("flask", t, r"""@\w+\.(route|get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", F.col("language") == "python"),
        _route("axum", t, r"""\.(route)\s*\(\s*"([^"]+)\"""", F.col("language") == "rust"), _route("actix", t, r"""#\[(get|post|put|delete|patch)\s*\(\s*"([^"]+)\"""", F.col("language") == "rust"),
        _route("rails", t, r"""^\s*(get|post|put|patch|delete)\s+['"]([^'"]+)['"]""", F.col("language") == "ruby"))).alias("r")).where("r.route <> ''")
    inner = F.upper(F.regexp_extract("text", r"(?i)\b(get|post|put|delete|patch)\s*\(|methods\s*=\s*\[\s*['\"](\w+)", 0))
    method = F.when(F.col("r.method") == "route", F.coalesce(F.when(F.col("r.framework") == "axum", F.nullif(F.regexp_extract(inner, r"(GET|POST|PUT|DELETE|PATCH)", 1), F.lit(""))), F.when(F.col("r.framework") == "flask", F.nullif(F.upper(F.regexp_extract("text", r"methods\s*=\s*\[\s*['\"](\w+)", 1)), F.lit(""))), F.when(F.col("r.framework") == "flask", "GET").otherwise("ANY"))).when(F.col("r.method") == "all", "ANY").otherwise(F.upper("r.method"))
    return by_path.select("method", F.col("route").alias("path"), "file_path", "framework", "line").unionByName(by_line.select(method.alias("method"), F.col("r.route").alias("path"), F.col("path").alias("file_path"), F.col("r.framework").alias("framework"), "line"))


def _route(framework: str, text: Column, pattern: str, when: Column) -> Column:
    hit = lambda i: F.when(when, F.regexp_extract(text, pattern, i)).otherwise("")
    return F.struct(F.lit(framework).alias("framework"), hit(1).alias("method"), hit(2).alias("route"))


def orm_queries(files: DataFrame) -> DataFrame:
    """path, line, orm, model, operation of prisma.model.operation( and supabase.from('table').operation(."""
    rows = lines(files)
    t = "text"
    prisma = F.struct(F.lit("prisma").alias("orm"), F.regexp_extract(t, r"\bprisma\.(?!\$)(\w+)\.(\w+)\s*\(", 1).alias("model"), F.regexp_extract(t, r"\bprisma\.(?!\$)(\w+)\.(\w+)\s*\(", 2).alias("operation"))
    supabase = F.struct(F.lit("supabase").alias("orm"), F.regexp_extract(t, r"\bsupabase\.from\(\s*['\"](\w+)['\"]\s*\)\.(\w+)", 1).alias("model"), F.regexp_extract(t, r"\bsupabase\.from\(\s*['\"](\w+)['\"]\s*\)\.(\w+)", 2).alias("operation"))
    return rows.select("path", "line", F.explode(F.array(prisma, supabase)).alias("q")).where("q.model <> ''").select("path", "line", "q.*")


def markdown_headings(files: DataFrame) -> DataFrame:
    """path, line, level, text, slug of ATX headings."""
    h = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
    rows = lines(files).where(F.col("text").rlike(h))
    text = F.regexp_extract("text", h, 2)
    return rows.select("path", "line", F.length(F.regexp_extract("text", h, 1)).cast("long").alias("level"), text.alias("heading"), slug(text).alias("slug"))


def markdown_links(files: DataFrame) -> DataFrame:
    """path, line, target, anchor of relative links."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)))
    rows = lines(files).select("path", "line", found.alias("url")).where(~F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|^//"))
    return rows.select("path", "line", F.regexp_extract("url", r"^([^#]*)", 1).alias("target"), F.regexp_extract("url", r"#(.*)$", 1).alias("anchor"))


def cobol_counts(files: DataFrame) -> DataFrame:
    """path and counts of divisions, sections, paragraphs, CALL, PERFORM and COPY in columns 8 to 72; comments (* or / in column 7) don't count."""
    rows = lines(files).where(~F.substring("text", 7, 1).isin("*", "/")).select("path", F.upper(F.substring("text", 8, 65)).alias("t"))
    count = lambda p: F.count_if(F.col("t").rlike(p))
    return rows.groupBy("path").agg(count(r"\bDIVISION\s*\.").alias("divisions"), count(r"\bSECTION\s*\.").alias("sections"), count(r"^[A-Z0-9][A-Z0-9-]*\s*\.\s*$").alias("paragraphs"), count(r"\bCALL\s+").alias("calls"), count(r"\bPERFORM\s+").alias("performs"), count(r"\bCOPY\s+").alias("copies"))


def jcl_counts(files: DataFrame) -> DataFrame:
    rows = lines(files).where(F.col("text").startswith("//") & ~F.col("text").startswith("//*"))
    return rows.groupBy("path").agg(*(F.count_if(F.col("text").rlike(rf"^//\S*\s+{k}\b")).alias(n) for k, n in (("JOB", "jobs"), ("EXEC", "steps"), ("DD", "datasets"))))


def tool_like(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.lower("name").rlike("tool|command|handler|action")).agg(F.count("*").alias("n"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href of every link of a page, as often as it occurs."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))).alias("href"))


#: language -> patterns of an import: the source, then the names (a list joined by commas) if there are any
IMPORTS: dict[str, list[tuple[str, int, int]]] = {
    "python": [(r"^\s*from\s+(\S+)\s+import\s+\(?([\w\s,*]+)", 1, 2), (r"^\s*import\s+([\w.]+)", 1, 0)],
    "typescript": [(r"^\s*import\s+(?:type\s+)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)", 2, 1), (r"^\s*import\s+(?:\*\s+as\s+)?(\w+)[^'\"]*from\s*['\"]([^'\"]+)", 2, 1), (r"require\(\s*['\"]([^'\"]+)", 1, 0)],
    "rust": [(r"^\s*(?:pub\s+)?use\s+([\w:]+?)::\{?([\w\s,]+)\}?\s*;", 1, 2)], "go": [(r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", 1, 0)], "java": [(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", 1, 0)], "kotlin": [(r"^\s*import\s+([\w.]+)", 1, 0)],
    "csharp": [(r"^\s*using\s+([\w.]+)\s*;", 1, 0)], "c": [(r"^\s*#\s*include\s*\"([^\"]+)", 1, 0)], "cpp": [(r"^\s*#\s*include\s*\"([^\"]+)", 1, 0)], "ruby": [(r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)", 1, 0)],
    "php": [(r"^\s*use\s+([\w\\\\]+)\s*;", 1, 0)], "swift": [(r"^\s*import\s+(\w+)", 1, 0)], "dart": [(r"^\s*import\s+['\"](?:package:\w+/)?([^'\"]+?)(?:\.dart)?['\"]", 1, 0)],
}
IMPORTS["javascript"] = IMPORTS["tsx"] = IMPORTS["typescript"]
NO_CALLS = "if for while switch catch return def fn func fun function class struct sizeof match elif with assert except new await in and or not super lambda yield del raise throw".split()


def imports(files: DataFrame) -> DataFrame:
    """path, language, line, source, imported_name: a row for each name; the last part of the source where none is listed."""
    cases = None
    for language, patterns in IMPORTS.items():
        found = F.array(*(F.struct(F.regexp_extract("text", p, a).alias("source"), (F.regexp_extract("text", p, b) if b else F.lit("")).alias("names"), F.lit(i).alias("ord")) for i, (p, a, b) in enumerate(patterns)))
        cases = F.when(F.col("language") == language, found) if cases is None else cases.when(F.col("language") == language, found)
    hits = lines(files).select("path", "language", "line", F.get(F.filter(cases, lambda x: x["source"] != ""), 0).alias("x")).where("x IS NOT NULL")
    last = F.regexp_extract("x.source", r"([^./:\\\\]+)/?$", 1)
    names = F.when(F.trim("x.names") == "", F.array(last)).otherwise(F.transform(F.split("x.names", ","), lambda n: F.trim(F.regexp_replace(n, r"\s+as\s+\w+|\s+$", ""))))
    return hits.select("path", "language", "line", F.col("x.source").alias("source"), F.explode(names).alias("imported_name")).where("imported_name <> ''")


def calls(files: DataFrame) -> DataFrame:
    """path, line, receiver, callee_name, col of everything that looks like a call, but for keywords and the names that a line defines."""
    defined_here = "".join(rf"(?<!\b{w} )" for w in ("def", "fn", "fun", "func", "function", "class"))
    pattern = rf"(?:\b(\w+)(?:\.|::|->))?{defined_here}\b([A-Za-z_]\w*)\s*\("
    rows = lines(files).where(F.col("language").isin("python", *DEFINITIONS) & ~F.col("language").isin("json", "yaml")).where(~F.col("text").rlike(r"^\s*(?:#|//|\*|--)"))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("receiver"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("name"))
    hits = rows.select("path", "line", "text", F.posexplode(pairs).alias("n", "x")).select("path", "line", "text", "n", F.nullif("x.receiver", F.lit("")).alias("receiver"), F.col("x.name").alias("callee_name"))
    hits = hits.where(~F.col("callee_name").isin(NO_CALLS))
    defined = definitions(files).select("path", "line", F.col("name").alias("callee_name"))
    kept = hits.join(defined, ["path", "line", "callee_name"], "left_anti")
    return kept.select("path", "line", "receiver", "callee_name", F.instr("text", F.concat("callee_name", F.lit("("))).cast("long").alias("col"))


def parents(files: DataFrame) -> DataFrame:
    """path, line, name, parent, heritage_kind of classes with a parent, line by line."""
    ext = r"\b(?:class|struct|interface|trait)\s+(\w+)(?:<[^>]*>)?\s*(?:extends\s+|:\s*(?:public\s+)?|<\s*|\(\s*)([A-Z]\w*)"
    impl = r"\bclass\s+(\w+).*?\bimplements\s+(\w+)"
    rust = r"^\s*impl(?:<[^>]*>)?\s+(\w+)(?:<[^>]*>)?\s+for\s+(\w+)"
    x = F.explode(F.array(
        F.struct(F.regexp_extract("text", ext, 1).alias("name"), F.regexp_extract("text", ext, 2).alias("parent"), F.lit("extends").alias("heritage_kind")),
        F.struct(F.regexp_extract("text", impl, 1).alias("name"), F.regexp_extract("text", impl, 2).alias("parent"), F.lit("implements").alias("heritage_kind")),
        F.struct(F.regexp_extract("text", rust, 2).alias("name"), F.regexp_extract("text", rust, 1).alias("parent"), F.lit("implements").alias("heritage_kind")))).alias("x")
    return lines(files).select("path", "line", x).where("x.name <> '' AND x.parent <> ''").select("path", "line", "x.*")
