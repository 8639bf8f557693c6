"""Line dedup by a segment-partition edit join.

A line is a stretch of text between line feeds, without the spaces, tabs and carriage returns
around it. A line that isn't empty repeats if a line at an earlier place (doc_id, then line number)
is equal to it, or, where both have at least ``NEAR_CHARS`` characters, within ``EDITS`` edits of it.

Equal lines meet by hash, whatever their length. For the others each distinct line is cut into EDITS + 1 even segments, of which two lines within EDITS edits share
one at nearly the same place. The segments are index entries under (length, which segment, content);
a line probes the entries of its own and of the lengths up to EDITS shorter with the few substrings
that the position windows leave. Entries carry the parity of 32 character classes, of which an edit
flips at most two, so most false candidates fall before their texts are fetched. The rest are
verified by a banded bit-parallel automaton: a word of 2 * EDITS + 1 bits for each number of
errors, many pairs at a time. The search is exact, but for collisions of 64-bit hashes.

Null ids and null or empty texts have no lines. Rows that repeat a doc_id are taken as one document,
so of equal lines with the same number there is one. Very long lines and texts are read whole. Where
several earlier lines are near, the earliest is named. An empty table gives an empty result. Only
doc_id and text are read, so other columns, whatever their names, change nothing and pass through
``drop_repeated_lines``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import packed
from sparkloom.llm.arrowtext import BASE_INV, U64, chunks, codepoints, mix, powers, prefix_hash, signed, span_hash
from sparkloom.llm.common import checkpoint, exact, fresh, parts_for, stored, texts

EDITS = 2
#: Least characters of lines that are compared by edits: three quarters of such a line stay as they are.
NEAR_CHARS = 4 * EDITS
ENTRY = np.dtype([("key", "<u8"), ("line", "<u8"), ("sig", "<u4")])
#: Pairs compared at once in a segment group, and characters in a batch of verification.
TILE, CELLS = 1 << 20, 1 << 22
#: Lines to drop that are sent to every executor (some 20 MB); more are joined by a shuffle.
BROADCAST_LINES = 1_000_000


class Lines:
    """Lines of a chunk: row, number in the row, start and end in code points, and hash; short ones left out unless ``least`` is 0."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, least: int):
        feed = np.flatnonzero(codes == 10)
        begin = np.concatenate([starts[:-1], feed + 1])
        row = np.concatenate([np.arange(len(starts) - 1), np.searchsorted(starts, feed, side="right") - 1])
        order = np.lexsort((begin, row))
        begin, row = begin[order], row[order]
        last = np.append(row[1:] != row[:-1], True)[: len(row)]
        end = np.append(begin[1:] - 1, 0)[: len(row)]
        end[last] = starts[1:][row[last]]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        solid = np.flatnonzero((codes != 32) & (codes != 10) & (codes != 9) & (codes != 13))
        edge = np.append(solid, len(codes))
        self.whole_start, self.whole_end = begin, end
        start = np.minimum(edge[np.searchsorted(solid, begin)], end)
        stop = np.maximum(np.concatenate([[-1], solid])[np.searchsorted(solid, end)] + 1, start)
        use = stop - start >= least
        self.row, self.number, self.start, self.end = row[use], number[use], start[use], stop[use]


def _parity(codes: np.ndarray, lines: Lines) -> np.ndarray:
    bit = np.uint32(1) << ((codes * np.uint32(2654435761)) >> np.uint32(27))
    running = np.zeros(len(codes) + 1, np.uint32)
    np.bitwise_xor.accumulate(bit, out=running[1:])
    return running[lines.end] ^ running[lines.start]


def _segment(size: np.ndarray, i: int, edits: int):
    """Start and length of segment i of lines of these sizes; the longer segments come last."""
    base, more = size // (edits + 1), size % (edits + 1)
    short = edits + 1 - more
    return i * base + np.maximum(0, i - short), base + (i >= short)


def _seeds(codes, starts, least: int, edits: int):
    """Lines with their hashes, and the entries: index entries have an odd key, probes an even one."""
    lines = Lines(codes, starts, least)
    prefix, inverse = prefix_hash(codes), powers(len(codes) + 1, BASE_INV)
    lines.hash = mix(span_hash(prefix, lines.start, lines.end, inverse) + (lines.end - lines.start).astype(U64))
    _, once = np.unique(lines.hash, return_index=True)
    start, size, name = lines.start[once], (lines.end - lines.start)[once], lines.hash[once]
    sig = _parity(codes, lines)[once]
    out = []
    for shorter in range(edits + 1):
        other = size - shorter
        for i in range(edits + 1):
            at, n = _segment(other, i, edits)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                fits = np.flatnonzero((other >= least) & (at + shift >= 0) & (at + shift + n <= size))
                a = start[fits] + at[fits] + shift
                e = np.empty(len(fits), ENTRY)
                key = mix(span_hash(prefix, a, a + n[fits], inverse) ^ mix(other[fits].astype(U64), i))
                own = shorter == 0 and shift == 0
                e["key"] = key | U64(1) if own else key & ~U64(1)
                e["line"], e["sig"] = name[fits], sig[fits]
                out.append(e)
    return lines, np.concatenate(out)


def _entries(parts: int, least: int, edits: int):
    def emit(batches):
        to = packed.Packer(parts, once="line")
        for chunk in chunks(batches):
            _, entries = _seeds(*codepoints(chunk.column("text")), least, edits)
            yield from to.add(entries)
        yield from to.flush()

    return emit


def _places(least: int):
    def emit(batches):
        for chunk in chunks(batches):
            codes, starts = codepoints(chunk.column("text"))
            lines = Lines(codes, starts, least)
            name = mix(span_hash(prefix_hash(codes), lines.start, lines.end, powers(len(codes) + 1, BASE_INV)) + (lines.end - lines.start).astype(U64))
            yield pa.RecordBatch.from_arrays([signed(name), chunk.column("doc_id").take(pa.array(lines.row)), pa.array(lines.number)], names=["line", "doc_id", "line_no"])

    return emit


def _line_texts(least: int):
    def emit(batches):
        for chunk in chunks(batches):
            codes, starts = codepoints(chunk.column("text"))
            lines = Lines(codes, starts, least)
            name = mix(span_hash(prefix_hash(codes), lines.start, lines.end, powers(len(codes) + 1, BASE_INV)) + (lines.end - lines.start).astype(U64))
            _, once = np.unique(name, return_index=True)
            text = codes.tobytes().decode("utf-32-le", "replace")
            yield pa.RecordBatch.from_arrays([signed(name[once]), pa.array([text[a:b] for a, b in zip(lines.start[once], lines.end[once])], pa.string())], names=["line", "text"])

    return emit


def _candidates(edits: int):
    def match(table: pa.Table) -> pa.Table:
        e = packed.records(table, ENTRY)
        group, line = e["key"] >> U64(1), e["line"]
        e = e[np.lexsort((e["key"] & U64(1) ^ U64(1), line, group))]  # an index entry before a probe of the same line
        group, line, indexed, sig = e["key"] >> U64(1), e["line"].copy(), (e["key"] & U64(1)).astype(bool), e["sig"].copy()
        new = np.ones(len(e), bool)
        new[1:] = (group[1:] != group[:-1]) | (line[1:] != line[:-1])
        group, line, indexed, sig = group[new], line[new], indexed[new], sig[new]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        size = np.diff(np.append(first, len(group)))
        left = np.flatnonzero(indexed)
        of = np.searchsorted(first, left, side="right") - 1
        left, of = left[size[of] > 1], of[size[of] > 1]
        ends = np.cumsum(size[of])
        found, at = [], 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, side="right")))
            n = size[of[at:to]]
            a = np.repeat(left[at:to], n)
            b = np.repeat(first[of[at:to]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            keep = (a != b) & (np.bitwise_count(sig[a] ^ sig[b]) <= 2 * edits)
            pair = np.sort(np.stack([line[a[keep]], line[b[keep]]], axis=1), axis=1)
            found.append(np.unique(pair, axis=0))
            at = to
        pair = np.concatenate(found) if found else np.zeros((0, 2), U64)
        return pa.table({"a": signed(pair[:, 0]), "b": signed(pair[:, 1])})

    return match


def edit_distances(left: list[str], right: list[str], edits: int = EDITS) -> np.ndarray:
    """Levenshtein distances of the pairs, or edits + 1 where they are greater.

    State e of a pair holds a bit for each pattern place within ``edits`` of the text place that is
    reached with e errors; all pairs of a batch step through their texts together.
    """
    out = np.full(len(left), edits + 1, np.int32)
    size = np.array([max(len(a), len(b)) for a, b in zip(left, right)], dtype=np.int64)
    near = np.flatnonzero([abs(len(a) - len(b)) <= edits for a, b in zip(left, right)]) if len(left) else np.zeros(0, int)
    near = near[np.argsort(size[near], kind="stable")]
    width = 2 * edits + 1
    weight, full = (1 << np.arange(width)).astype(np.int32), np.int32((1 << width) - 1)
    at = 0
    while at < len(near):
        to = at + 1
        while to < len(near) and (to - at + 1) * (size[near[to]] + 2 * width) <= CELLS:
            to += 1
        which = near[at:to]
        at = to
        longest = int(size[which[-1]])
        p = np.full((len(which), longest + 2 * width), 0xFFFFFFFF, np.uint32)  # pattern place i is at column i + edits
        t = np.full((len(which), longest + 1), 0xFFFFFFFE, np.uint32)
        m, n = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        for k, i in enumerate(which):
            x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (left[i], right[i]))
            p[k, edits : edits + len(x)], t[k, : len(y)], m[k], n[k] = x, y, len(x), len(y)
        state = [np.full(len(which), sum(1 << (edits + j) for j in range(e + 1)) & int(full), np.int32) for e in range(edits + 1)]
        goal = m - n + edits
        step = 0
        while len(which):
            done = n == step
            if done.any():
                for e in reversed(range(edits + 1)):
                    hit = done & (state[e] >> goal & 1).astype(bool)
                    out[which[hit]] = e
            alive = ~done & (state[edits] != 0)
            if not alive.all() and (not alive.any() or done.any() or alive.sum() * 2 < len(which)):
                which, p, t, m, n, goal = which[alive], p[alive], t[alive], m[alive], n[alive], goal[alive]
                state = [s[alive] for s in state]
                if not len(which):
                    break
            match = (p[:, step : step + width] == t[:, step : step + 1]) @ weight
            new = [state[0] & match]
            for e in range(1, edits + 1):
                new.append(((state[e] & match) | state[e - 1] | (state[e - 1] >> 1) | (new[e - 1] << 1)) & full)
            state = new
            step += 1
    return out


def _verify(edits: int):
    def verify(batches):
        for batch in batches:
            d = edit_distances(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), edits)
            keep = pa.array(d <= edits)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(d[d <= edits])], names=["a", "b", "edits"])

    return verify


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = 1, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, line_no, of_doc_id, of_line_no, edits: each line that repeats, and the earliest line that it repeats.

    Lines under ``least`` characters are left out; those under ``near_chars`` repeat equal lines only.
    """
    near_chars = max(near_chars, least, edits + 1)  # no segment may be empty
    docs = texts(docs).where(F.col("doc_id").isNotNull())
    parts = parts_for(docs, 1.0)
    pairs = stored(docs.mapInArrow(_entries(parts, near_chars, edits), packed.SCHEMA).groupBy("part").applyInArrow(_candidates(edits), "a long, b long").distinct(), "line-pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "line-names")
    line_text = stored(docs.mapInArrow(_line_texts(near_chars), "line long, text string").join(wanted, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text")), "line-texts")
    both = pairs.join(line_text.select(F.col("line").alias("a"), F.col("text").alias("text_a")), "a").join(line_text.select(F.col("line").alias("b"), F.col("text").alias("text_b")), "b")
    near = both.mapInArrow(_verify(edits), "a long, b long, edits int")

    places = checkpoint(docs.mapInArrow(_places(least), "line long, doc_id long, line_no long").distinct())
    first = places.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    of = near.join(first.select(F.col("line").alias("a"), F.col("first").alias("first_a")), "a").join(first.select(F.col("line").alias("b"), F.col("first").alias("first_b")), "b")
    later = of.select(
        F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("line"),
        F.struct(F.least("first_a", "first_b").alias("first"), "edits").alias("near"),
    )
    later = later.groupBy("line").agg(F.min("near").alias("near"))
    judged = places.join(first, "line").join(later, "line", "left").withColumn("place", F.struct("doc_id", "line_no"))
    own = F.when(F.col("place") > F.col("first"), F.struct("first", F.lit(0).alias("edits")))
    return judged.withColumn("of", F.least("near", own)).where("of IS NOT NULL").select("doc_id", "line_no", F.col("of.first.doc_id").alias("of_doc_id"), F.col("of.first.line_no").alias("of_line_no"), F.col("of.edits").alias("edits"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that repeat; documents of which nothing but white space is left go too.

    A column n_chars, where there is one, follows the new text. Other documents stay as they are.
    """
    text, lines, new = "text", fresh(docs, "dropped_lines"), fresh(docs, "new_text")
    gone = stored(repeated_lines(docs, **options).groupBy("doc_id").agg(F.collect_set(F.col("line_no").cast("int")).alias(lines)), "dropped-lines")
    if (gone.agg(F.sum(F.size(lines))).first()[0] or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    out = docs.join(gone, "doc_id", "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n")
    out = out.withColumn(new, F.when(F.col(lines).isNull(), F.col(text)).otherwise(kept)).where(F.col(lines).isNull() | F.col(new).rlike(r"\S"))
    columns = [F.col(new).alias(c) if c == text else F.when(F.col(lines).isNull(), F.col(c)).otherwise(F.char_length(new)).cast(t).alias(c) if c == "n_chars" else exact(c) for c, t in docs.dtypes]
    return out.select(columns)


ORACLE = """
WITH split AS (
  SELECT DISTINCT doc_id, t.i AS line_no, trim(t.l, ' ' || chr(9) || chr(13)) AS l
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i - 1, 'l': x})) AS t FROM documents WHERE doc_id IS NOT NULL)
), line AS (SELECT * FROM split WHERE length(l) >= 1),
one AS (SELECT l, length(l) AS n, min((doc_id, line_no)) AS first FROM line GROUP BY l),
near AS (
  SELECT b.l AS l, min((a.first, levenshtein(a.l, b.l))) AS of
  FROM one a JOIN (SELECT *, unnest(range(n - 2, n + 3)) AS m FROM one) b ON a.n = b.m AND a.first < b.first AND least(a.n, b.n) >= 8
  WHERE (contains(b.l, left(a.l, a.n // 3)) OR contains(b.l, substr(a.l, a.n // 3 + 1, a.n // 3)) OR contains(b.l, substr(a.l, 2 * (a.n // 3) + 1)))
    AND levenshtein(a.l, b.l) <= 2
  GROUP BY b.l
), judged AS (
  SELECT doc_id, line_no, CASE WHEN (doc_id, line_no) > first THEN (first, CAST(0 AS BIGINT)) END AS own, near.of AS of
  FROM line JOIN one USING (l) LEFT JOIN near USING (l)
), best AS (
  SELECT doc_id, line_no, CASE WHEN own IS NULL THEN of WHEN of IS NULL THEN own WHEN of < own THEN of ELSE own END AS x FROM judged
)
SELECT doc_id, line_no, x[1][1] AS of_doc_id, x[1][2] AS of_line_no, CAST(x[2] AS INTEGER) AS edits FROM best WHERE x IS NOT NULL
"""
