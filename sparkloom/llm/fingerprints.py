"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for a run of code points c, the arrays H[i] = sum of (c[j] + 1) * B**j for j < i
modulo two primes of 31 bits. They give the hash of any span, so any two spans are compared in
constant time, and the longest common extension of two places is found by binary search.

``fingerprints`` gives each document the hash of its whole text, the least doc_id with the same one,
and, from either end, the earliest document that shares most with it and how far. The spans of 1, 4,
16, 64, ... characters at the ends are hashed; of the longest one that an earlier document shares, the
earliest document with it is the leader (``tail_leader_id`` for the last characters), and the common
extension (``lcp``, ``lcs``) is located exactly. An earlier document that shares four times as much or
more would have been found at the next span, so only that many characters of either text are moved:
for most documents a few dozen. A document that shares no first (last) character with an earlier one
leads itself and extends over all its text.

Earlier means by doc_id, null first, then by a hash of the text. A null text has null results and is
nobody's leader; an empty one is an ordinary text without a first character. Rows that repeat a
doc_id are documents of their own, unless their texts are equal too: then all of them get the same
result. Very long texts are hashed whole. An empty table gives an empty result. Only doc_id and text
are read, so other columns, whatever their names, change nothing.

Spans are counted, with the least document for each, before anything meets: groups of any size are
one row. Groups of more than ``HOT`` documents are spread over salted parts, each with the leader.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrowtext import U64, chunks, codepoints
from sparkloom.llm.common import stored, texts

PRIMES, BASES = (2147483647, 2147483629), (1000003579, 1500450271)
#: Documents of a salted part; characters of either end that are kept beside the fingerprints.
HOT, KEPT = 5000, 64
#: Documents whose asks (some 150 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_ASKS = 250_000
_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int, n: int, base: int | None = None) -> np.ndarray:
    """B**0 .. B**(n-1) modulo prime k, for its own base or another one."""
    base = base or BASES[k]
    p, have = U64(PRIMES[k]), _POWERS.get(base, np.ones(1, U64))
    while len(have) < n:
        have = np.concatenate([have, have * (have[-1] * U64(base) % p) % p])
    if len(have) <= 1 << 22:
        _POWERS[base] = have
    return have[:n]


class Prefixes:
    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.powers = [_powers(k, self.n + 1) for k in range(2)]
        self.sums = []
        for k in range(2):
            h = np.zeros(self.n + 1, U64)
            np.cumsum((codes.astype(U64) + U64(1)) * self.powers[k][:-1] % U64(PRIMES[k]), out=h[1:])  # below 2**63 for 2**32 characters
            self.sums.append(h % U64(PRIMES[k]))

    def span(self, k: int, start, end):
        """Hash k of the span, times B**start."""
        return (self.sums[k][end] + U64(PRIMES[k]) - self.sums[k][start]) % U64(PRIMES[k])

    def equal(self, start, other: Prefixes, other_start, n) -> np.ndarray:
        """Whether spans of n code points are equal (up to a collision of both hashes)."""
        out = True
        for k in range(2):
            p = U64(PRIMES[k])
            out &= self.span(k, start, start + n) * other.powers[k][other_start] % p == other.span(k, other_start, other_start + n) * self.powers[k][start] % p
        return out

    def extension(self, start: np.ndarray, end: np.ndarray, other: Prefixes, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
        """Longest common extensions of the places to the right, within the ends."""
        low, high = np.zeros(len(start), np.int64), np.minimum(end - start, other_end - other_start)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(start, other, other_start, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def fingerprint(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62 bits: the hashes of whole spans, brought to start 0 by the inverse power."""
        out = np.zeros(len(start), np.int64)
        for k in range(2):
            inverse = _powers(k, self.n + 1, pow(BASES[k], -1, PRIMES[k]))[start]
            out = out << 31 | (self.span(k, start, end) * inverse % U64(PRIMES[k])).astype(np.int64)
        return out


def _ends(batches):
    """Fingerprints of whole texts, and of the first and last 1, 4, 16, ... characters."""
    for chunk in chunks(batches):
        codes, starts = codepoints(chunk.column("text"))
        p = Prefixes(codes)
        start, end = starts[:-1], starts[1:]
        size = end - start
        levels = (np.frexp(np.maximum(size, 1).astype(np.float64))[1] + 1) // 2 * (size > 0)
        row = np.repeat(np.arange(len(size)), levels)
        span = np.int64(1) << 2 * (np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels))
        offsets = pa.array(np.concatenate([[0], np.cumsum(levels)]).astype(np.int32))
        heads, tails = p.fingerprint(start[row], start[row] + span), p.fingerprint(end[row] - span, end[row])
        null = chunk.column("text").is_null().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [chunk.column("doc_id"), chunk.column("tie"), pa.array(p.fingerprint(start, end), mask=null), pa.array(size, mask=null), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (heads, tails)), chunk.column("head"), chunk.column("tail")],
            names=["doc_id", "tie", "fingerprint", "n_chars", "heads", "tails", "head", "tail"],
        )


def _compare(batches):
    """Rows in order of (part, salt), the leader first: extensions of the others with it, from the start."""
    held = None  # group and code points of the leader of the group at the end of the chunk before
    for chunk in chunks(batches):
        codes, starts = codepoints(chunk.column("text"))
        p = Prefixes(codes)
        start, end = starts[:-1], starts[1:]
        part, salt = chunk.column("part").to_numpy(), chunk.column("salt").to_numpy()
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (salt[1:] != salt[:-1])
        carried = held is not None and held[0] == (part[0], salt[0])
        first = np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))
        common = p.extension(start, end, p, start[first], end[first])
        if carried:
            of = np.flatnonzero(first == 0)
            other = Prefixes(held[1])
            zero = np.zeros(len(of), np.int64)
            common[of] = p.extension(start[of], end[of], other, zero, zero + other.n)
        if not (carried and first[-1] == 0):
            held = (part[-1], salt[-1]), codes[start[first[-1]] : end[first[-1]]].copy()
        out = pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("doc_id", "tie", "side")), pa.array(common)], names=["doc_id", "tie", "side", "common"])
        yield out.filter(pa.array(~chunk.column("leads").to_numpy(zero_copy_only=False)))


def fingerprints(docs: DataFrame, hot: int = HOT, kept: int = KEPT) -> DataFrame:
    """doc_id, fingerprint, n_chars, same_as, leader_id, lcp, tail_leader_id, lcs: a row for each row of docs."""
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    tail = lambda n: F.reverse(F.substring("text", -n, n)) if isinstance(n, int) else F.reverse(F.expr(f"right(text, {n})"))
    base = rows.withColumn("head", F.substring("text", 1, kept)).withColumn("tail", tail(kept))
    base = stored(base.mapInArrow(_ends, "doc_id long, tie long, fingerprint long, n_chars long, heads array<long>, tails array<long>, head string, tail string"), "fingerprints")
    spans = None
    for side, c in enumerate(("heads", "tails")):
        one = base.select("doc_id", "tie", F.lit(side).alias("side"), F.posexplode(c).alias("level", "key"))
        spans = one if spans is None else spans.union(one)
    me = F.struct("doc_id", "tie")
    shared = spans.groupBy("side", "level", "key").agg(F.min(me).alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    best = spans.join(shared, ["side", "level", "key"]).where(~F.col("leader").eqNullSafe(me)).groupBy("doc_id", "tie", "side").agg(F.max(F.struct("level", "leader")).alias("m"))
    best = stored(best.select("doc_id", "tie", "side", F.expr("CAST(shiftleft(4L, 2 * m.level) AS INT)").alias("take"), F.col("m.leader.doc_id").alias("leader_id"), F.col("m.leader.tie").alias("leader_tie")), "leaders")

    # who has to send how much of its text where: documents to their leader's part, leaders to all salts of it
    part = F.xxhash64("side", "leader_id", "leader_tie").alias("part")
    groups = best.groupBy("side", "leader_id", "leader_tie").agg(F.max("take").alias("take"), F.ceil(F.count("*") / hot).cast("int").alias("salts"))
    salts = stored(groups.where("salts > 1").select("side", "leader_id", "leader_tie", "salts"), "hot-leaders")
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    marked = best.join(salts, same(best, salts, "side", "leader_id", "leader_tie"), "left").select(*(best[c] for c in best.columns), F.coalesce("salts", F.lit(1)).alias("salts"))
    asked = marked.select("doc_id", "tie", "side", part, F.pmod(F.xxhash64("doc_id", "tie"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("leads"), "take").union(
        groups.select(F.col("leader_id").alias("doc_id"), F.col("leader_tie").alias("tie"), "side", part, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("leads"), "take"))
    lists = stored(asked.groupBy("doc_id", "tie").agg(F.max("take").alias("most"), F.collect_list(F.struct("side", "part", "salt", "leads", "take")).alias("asks")), "asks")

    def sent(source: DataFrame, asks: DataFrame, head, tail_) -> DataFrame:
        found = source.join(asks, same(source, asks, "doc_id", "tie")).select(source["doc_id"], source["tie"], *(source[c] for c in source.columns if c not in ("doc_id", "tie")), F.explode("asks").alias("ask"))
        return found.select("doc_id", "tie", "ask.*", F.when(F.col("ask.side") == 0, head).otherwise(tail_).alias("text"))

    short, long = lists.where(F.col("most") <= kept), lists.where(F.col("most") > kept)
    if long.count() <= BROADCAST_ASKS:
        long = F.broadcast(long)
    ends = sent(base.select("doc_id", "tie", "head", "tail").dropDuplicates(["doc_id", "tie"]), short, F.col("head"), F.col("tail"))
    whole = sent(rows, long, F.expr("left(text, ask.take)"), tail("ask.take"))
    both = ends.union(whole).select("part", "salt", "leads", "doc_id", "tie", "side", "text")
    common = both.repartition("part", "salt").sortWithinPartitions("part", "salt", F.desc("leads")).mapInArrow(_compare, "doc_id long, tie long, side int, common long")
    common = common.groupBy("doc_id", "tie").agg(*(F.max(F.when(F.col("side") == i, F.col("common"))).alias(c) for i, c in enumerate(("lcp", "lcs"))))
    leaders = best.groupBy("doc_id", "tie").agg(*(F.max(F.when(F.col("side") == i, F.struct("leader_id"))).alias(c) for i, c in enumerate(("h", "t"))))
    twins = base.where("fingerprint IS NOT NULL").groupBy("fingerprint", "n_chars").agg(F.min("doc_id").alias("same_as"))
    out = base.select("doc_id", "tie", "fingerprint", "n_chars").join(twins, ["fingerprint", "n_chars"], "left")
    for more in (leaders, common):
        out = out.join(more, same(out, more, "doc_id", "tie"), "left").drop(more["doc_id"], more["tie"])
    own = lambda c, mine: F.when(F.col("fingerprint").isNotNull(), F.when(F.col(c).isNull(), F.col(mine)))
    leader = lambda c: F.when(F.col(c).isNotNull(), F.col(f"{c}.leader_id")).otherwise(own(c, "doc_id"))
    return out.select(
        "doc_id", "fingerprint", "n_chars", "same_as", leader("h").alias("leader_id"), F.coalesce("lcp", own("h", "n_chars")).alias("lcp"),
        leader("t").alias("tail_leader_id"), F.coalesce("lcs", own("t", "n_chars")).alias("lcs"),
    )


def _hash_sql(k: int) -> str:
    return f"coalesce(list_reduce(list_reverse(list_transform(string_split(text, ''), lambda c: CAST(unicode(c) + 1 AS BIGINT))), lambda a, c: (a * {BASES[k]} + c) % {PRIMES[k]}), 0)"


def _side_sql(name: str, shown: str) -> str:
    """The leader of each document, and the common extension with it, where {shown} is the text from the side's end."""
    return f"""{name}_s AS (SELECT doc_id, k, left(t, CAST(4 ** k AS BIGINT)) AS span FROM (SELECT doc_id, {shown} AS t, unnest(range(0, 13)) AS k FROM d) WHERE length(t) >= 4 ** k),
{name}_l AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY k, span) AS led FROM {name}_s),
{name} AS (SELECT doc_id, max_by(led, k) AS led FROM {name}_l WHERE led <> doc_id GROUP BY doc_id)"""


def _common_sql(a: str, b: str) -> str:
    return f"CAST(coalesce(list_position(list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), lambda x: coalesce(x[1] = x[2], false)), false), least(length({a}), length({b})) + 1) - 1 AS BIGINT)"


ORACLE = f"""
WITH d AS (SELECT doc_id, text, CASE WHEN text = '' THEN 0 ELSE {_hash_sql(0)} END * 2147483648 + CASE WHEN text = '' THEN 0 ELSE {_hash_sql(1)} END AS fingerprint, length(text) AS n_chars, min(doc_id) OVER (PARTITION BY text) AS same_as FROM documents WHERE text IS NOT NULL),
{_side_sql("h", "text")}, {_side_sql("t", "reverse(text)")}
SELECT d.doc_id, CAST(d.fingerprint AS BIGINT) AS fingerprint, d.n_chars, d.same_as, coalesce(h.led, d.doc_id) AS leader_id,
  CASE WHEN h.led IS NULL THEN d.n_chars ELSE {_common_sql("d.text", "x.text")} END AS lcp, coalesce(t.led, d.doc_id) AS tail_leader_id,
  CASE WHEN t.led IS NULL THEN d.n_chars ELSE {_common_sql("reverse(d.text)", "reverse(y.text)")} END AS lcs
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN d x ON x.doc_id = h.led LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN d y ON y.doc_id = t.led
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM documents WHERE text IS NULL
"""
