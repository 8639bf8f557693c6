"""Text search, vectors and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scores import word_boundary
from sparkloom.operators.traverse import call_links, closure
from sparkloom.plans.catalog import Catalog

K1, B = 1.2, 0.75
SYNONYMS = [["auth", "login", "signin", "session", "token"], ["db", "database", "query", "sql", "store"], ["http", "request", "fetch", "api", "route"], ["test", "spec", "mock"], ["config", "settings", "env"], ["error", "exception", "fail"], ["log", "trace", "logger"], ["cache", "buffer", "memo"], ["crypto", "hash", "encrypt"], ["file", "path", "fs"], ["thread", "spawn", "async"]]


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def terms_of(query: str) -> list[str]:
    """The distinct words of a query, in order, as prefixes."""
    words = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return list(dict.fromkeys(words))


def index(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """The inverted index: key, term, tf, and the document's length dl."""
    words = docs.select(F.col(key), tokens(text).alias("w"))
    return words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: Column, query: str, prefix: bool = False) -> DataFrame:
    """key, score of the documents with any term of the query; with prefix, words that begin with a term count as it.

    Postings are filtered while documents are split, so nothing but matches is shuffled.
    """
    terms = terms_of(query)
    words = docs.select(F.col(key), tokens(text).alias("w")).select(key, "w", F.size("w").alias("dl"))
    stats = words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    match = lambda t: (lambda w: w.startswith(t)) if prefix else (lambda w: w == t)
    tf = words.select(key, "dl", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.size(F.filter("w", match(t))).alias("tf")) for t in terms))).alias("x")).select(key, "dl", "x.term", "x.tf").where("tf > 0")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    j = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row a term, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return j.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def symbol_text() -> Column:
    return F.concat_ws(" ", "name", "qualified_name", "kind")


def search(cat: Catalog, query: str, limit: int = 10) -> DataFrame:
    """BM25 over symbols; the best ``limit`` are then boosted: 2 for the exact name, 1.2 for a part of it, 1.5 if exported."""
    top = bm25(cat.symbols, "id", symbol_text(), query, prefix=True).orderBy(F.desc("score"), "id").limit(limit)
    low, q = F.lower("name"), query.lower()
    boost = F.when(low == q, 2.0).when(low.contains(q), 1.2).otherwise(1.0) * F.when(F.col("is_exported"), 1.5).otherwise(1.0)
    return top.join(cat.symbols.select("id", "name", "is_exported"), "id").select("id", "name", F.round(F.col("score") * boost, 6).alias("score"))


def hybrid_search(cat: Catalog, query: str, limit: int = 10, hops: int = 3) -> DataFrame:
    """search, each score times 1 + .3 * (other hits reached within some calls / the most that any hit reaches)."""
    hits = search(cat, query, limit)
    near = closure(hits.select(F.col("id").alias("root_id")), call_links(cat), hops).join(hits.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy(F.col("root_id").alias("id")).agg(F.count("*").alias("reach"))
    j = hits.join(near, "id", "left").select("id", "name", "score", F.coalesce("reach", F.lit(0)).alias("reach"))
    most = F.greatest(F.max("reach").over(Window.partitionBy()), F.lit(1))
    return j.select("id", "name", F.round(F.col("score") * (1 + 0.3 * F.col("reach") / most), 6).alias("score"))


def evidence_search(cat: Catalog, query: str, limit: int = 20) -> DataFrame:
    return bm25(cat.evidence, "id", F.concat_ws(" ", "kind", "normalized", "file", "target_ref"), query).orderBy(F.desc("score"), "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def nearest(vectors: DataFrame, query_id: int, limit: int = 10) -> DataFrame:
    """The vectors nearest to one of them by cosine: one pass, a row a partition is sent on for the top."""
    q = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    s = vectors.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 5).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "vec_id").limit(limit)


def fuse(left: DataFrame, right: DataFrame, key: str, k: int = 60, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Reciprocal rank fusion of two lists (key, rank from 0)."""
    j = left.select(key, F.col("rank").alias("r1")).join(right.select(key, F.col("rank").alias("r2")), key, "full_outer")
    part = lambda r, w: F.coalesce(w / (k + F.col(r) + 1), F.lit(0.0))
    return j.select(key, F.round(part("r1", weights[0]) + part("r2", weights[1]), 9).alias("score"))


def ranked(df: DataFrame, key: str, score: str) -> DataFrame:
    """key and its rank from 0, of a short list."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1).select(key, "rank")


def process_search(cat: Catalog, steps: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Processes by the number of steps whose symbol matches any term, then by length."""
    names = cat.symbols.select(F.col("id").alias("symbol_id"), F.lower("name").alias("name"))
    hit = None
    for t in terms_of(query):
        hit = F.col("name").contains(t) if hit is None else hit | F.col("name").contains(t)
    g = steps.join(names, "symbol_id").groupBy("process_id").agg(F.count_if(hit).alias("hits"), F.count("*").alias("steps"))
    return g.where("hits > 0").orderBy(F.desc("hits"), F.desc("steps"), "process_id").limit(limit)


def relevance(name: Column, term: str) -> Column:
    """1 for the name itself, .7 for its start, .5 for a synonym at a word boundary, .4 for a part of it, else 0."""
    low, t = F.lower(name), term.lower()
    words = sorted({w for g in SYNONYMS if t in g for w in g} - {t})
    other = name.rlike("|".join(map(word_boundary, words))) if words else F.lit(False)
    return F.when(low == t, 1.0).when(low.startswith(t), 0.7).when(other, 0.5).when(low.contains(t), 0.4).otherwise(0.0)


def text_relevance(cat: Catalog, term: str, limit: int = 50) -> DataFrame:
    return cat.symbols.select("id", "name", relevance(F.col("name"), term).alias("relevance")).where("relevance > 0").orderBy(F.desc("relevance"), "id").limit(limit)


def within_budget(paths: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """In order, each path is kept if what is kept so far and it fit the budget; others are skipped. The first always stays.

    Not a running sum, so the fold runs over the ordered array of each group.
    """
    g = paths.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(cost).cast("long").alias("cost")))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("CAST(array() AS array<int>)").alias("kept"))
    folded = F.aggregate(
        F.transform("p", lambda x, i: F.struct(x["cost"].alias("cost"), i.alias("i"))), start,
        lambda s, x: F.when((s["used"] + x["cost"] <= budget) | (x["i"] == 0), F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["kept"], F.array(x["i"])).alias("kept"))).otherwise(s))
    return g.select(group, "p", folded.alias("f")).select(group, F.posexplode("p").alias("i", "x"), "f").where(F.array_contains("f.kept", F.col("i"))).select(group, F.col("i").cast("long").alias("place"), F.col("x.cost").alias("cost"))


def bundle(paths: DataFrame, budget: int = 4000) -> DataFrame:
    """Evidence bundle of beam paths: the best path to each node, cut to the token budget; per seed the number of paths, tokens and mean confidence."""
    cost = F.length("path") + 80 * (F.size(F.split("path", ">"))) + 40
    best = paths.withColumn("rn", F.row_number().over(Window.partitionBy("seed", "node").orderBy(F.desc("confidence"), "path"))).where("rn = 1").withColumn("tokens", cost)
    kept = within_budget(best, "seed", [(-F.col("confidence")).alias("a"), F.col("path").alias("b")], "tokens", budget)
    n = kept.groupBy("seed").agg(F.count("*").alias("paths"), F.sum("cost").alias("tokens"))
    return n.join(best.groupBy("seed").agg(F.round(F.avg("confidence"), 6).alias("confidence")), "seed")


def median_leaf(cat: Catalog, start: int) -> DataFrame:
    """The middle one, in order, of the nodes with at most one edge, without start."""
    d = cat.edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).where((F.col("degree") <= 1) & (F.col("id") != start)).select("id")
    n = F.count("*").over(Window.partitionBy())
    return d.withColumn("n", n).withColumn("rn", F.row_number().over(Window.orderBy("id"))).where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("id")


def snippet(text: Column, line: Column, around: int = 3) -> Column:
    """Lines (1-based) around one, with a mark at it."""
    rows = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    near = F.filter(rows, lambda r: F.abs(r["n"] - line) <= around)
    return F.array_join(F.transform(near, lambda r: F.concat(F.when(r["n"] == line, "> ").otherwise("  "), r["n"].cast("string"), F.lit(": "), r["t"])), "\n")
