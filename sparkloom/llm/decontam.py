"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark text is folded to lower-case words; its patterns are all runs of ``n`` words, or
the whole text where it has fewer: questions and answers of any length are searched. The automaton
over all patterns scans each folded document once; hits map back to code-point offsets in the
original text. ``decontaminate`` drops a document for a hit of at least ``REMOVED_WORDS`` words: a
shorter item, such as the answer "yes", is reported, but says nothing about a document by itself.

Nulls, empty texts and texts without a word on either side match nothing; a document with a null id
is not reported and stays. Repeated document rows report each hit once per document; several items
with the same wording are all reported. Very long texts are scanned whole. Empty tables on either
side give no rows. Only ids and texts are read, so other columns, whatever their names, change
nothing and pass through ``decontaminate``.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrowtext import Words, chunks, codepoints
from sparkloom.llm.common import texts, without

N_WORDS, REMOVED_WORDS = 13, 5
#: Characters of patterns in one automaton; a larger benchmark is scanned with several.
AUTOMATON_CHARS = 32 << 20
_AUTOMATA: dict[int, ahocorasick.Automaton] = {}


def folded_words(text: str | None) -> list[str]:
    codes, starts = codepoints(pa.array([text], pa.string()))
    w = Words(codes, starts)
    return ["".join(map(chr, w.folded[a:b])) for a, b in zip(w.start, w.end)]


def patterns(items: list[tuple[int, str | None]], n: int = N_WORDS) -> list[tuple[str, int, list[int]]]:
    """(pattern, number of words, items), in the order of the pattern."""
    found: dict[str, set[int]] = {}
    for item, text in items:
        words = folded_words(text)
        if item is None or not words:
            continue
        for i in range(max(1, len(words) - n + 1)):
            found.setdefault(f" {' '.join(words[i : i + n])} ", set()).add(item)
    return [(p, p.count(" ") - 1, sorted(ids)) for p, ids in sorted(found.items())]


def scanner(shard: list[tuple[str, int, list[int]]]):
    key = hash(tuple(p for p, *_ in shard))

    def automaton():
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            a = ahocorasick.Automaton()
            for p, n, ids in shard:
                a.add_word(p, (n, ids))
            a.make_automaton()
            _AUTOMATA[key] = a
        return _AUTOMATA[key]

    def scan(batches):
        if not shard:
            return
        find = automaton()
        for chunk in chunks(batches):
            codes, starts = codepoints(chunk.column("text"))
            w = Words(codes, starts)
            rows = w.row()
            if not len(rows):
                continue
            # " w1 w2 \n w3 ...": a space before each word and, at the end of a row, a space and a line feed
            size = w.end - w.start
            last = np.zeros(len(size), np.int64)
            last[np.flatnonzero(np.diff(rows, append=-1))] = 2
            to = np.cumsum(1 + size + last) - size - last
            out = np.full(int(to[-1] + size[-1] + 2), 32, np.uint32)
            out[to[last > 0] + size[last > 0] + 1] = 10
            at = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out[at] = w.folded[w.folded > 0]
            hits = [(e, n, i) for e, (n, ids) in find.iter(out.tobytes().decode("utf-32-le")) for i in ids]
            if not hits:
                continue
            end, n, item = (np.array(x, dtype=np.int64) for x in zip(*hits))
            stop = np.searchsorted(to, end)  # the words that begin before the pattern's last space
            row = rows[stop - 1]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").take(pa.array(row)), pa.array(item), pa.array(w.start[stop - n] - starts[row]), pa.array(w.end[stop - 1] - starts[row]), pa.array(n)],
                names=["doc_id", "item_id", "start", "end", "words"],
            )

    return scan


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """doc_id, item_id, start, end, n_windows, words: the stretch of the original text from the first to the last hit, and the words of a hit.

    The benchmark (a fixed test set, not the corpus) is read by the driver; past
    ``AUTOMATON_CHARS`` of patterns the documents are scanned once per shard.
    """
    items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()]
    shards: list[list] = [[]]
    room = AUTOMATON_CHARS
    for p in patterns(items, n):
        if len(p[0]) > room and shards[-1]:
            shards.append([])
            room = AUTOMATON_CHARS
        shards[-1].append(p)
        room -= len(p[0])
    docs = texts(docs).where(F.col("doc_id").isNotNull())
    found = None
    for shard in shards:
        hits = docs.mapInArrow(scanner(shard), "doc_id long, item_id long, start long, end long, words long")
        found = hits if found is None else found.union(hits)
    found = found.distinct()
    return found.groupBy("doc_id", "item_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_windows"), F.max("words").alias("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a pattern of ``REMOVED_WORDS`` words or more; rows with a null id stay."""
    return without(docs, contaminated(docs, benchmark).where(F.col("words") >= REMOVED_WORDS))


ORACLE = """
WITH tok AS (
  SELECT doc_id, t.p AS p, t.w AS w FROM (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}]+|[^\\p{L}\\p{N}\\p{M}]+'), lambda x, i: {'p': i, 'w': x})) AS t
    FROM documents WHERE doc_id IS NOT NULL)
), pos AS (
  SELECT doc_id, p, lower(w) AS w, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY p) AS stop, length(w) AS len FROM tok
), word AS (
  SELECT doc_id, w, stop - len AS start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM pos WHERE regexp_matches(w, '^[\\p{L}\\p{N}\\p{M}]')
), iw AS (
  SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}]+'), lambda x: lower(x)) AS ws FROM benchmark
), ig AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 12], ' ') AS gram, least(len(ws), 13) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM iw WHERE len(ws) >= 1)
), run AS (
  SELECT doc_id, start, list(w) OVER g AS ws, list(stop) OVER g AS stops
  FROM word WINDOW g AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), gram AS (
  SELECT doc_id, start, stops[n] AS stop, array_to_string(ws[1:n], ' ') AS gram, n FROM run JOIN (SELECT DISTINCT n FROM ig) s ON n <= len(ws)
)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS "end", count(*) AS n_windows, max(n) AS words
FROM gram JOIN ig USING (gram, n) WHERE item_id IS NOT NULL GROUP BY doc_id, item_id
"""
