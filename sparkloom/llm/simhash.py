"""Near-duplicate documents: 256-bit SimHash, bands, bit-sliced distances; every pair within the radius.

A document's signature is the majority of the hashed bits of its distinct folded words; a bit that
exactly half of them set is 0. Documents with equal signatures are a class, its least doc_id stands
for it. The classes are cut into blocks by a hash of their doc_id, and each pair of blocks is one
task, so the whole job is done at every size. Groups are the connected components; the least doc_id
stays.

No pair is lost: the 256 bits are cut into ``BANDS`` bands, each bit in one, and each band is given a
number of differing bits, so that these numbers plus one add up to the radius plus one. Two
signatures that differ in more than its number in every band therefore differ in more bits than the
radius. A band's buckets are looked up at every value within its number (at radius 42: 2, and 3 in
one band), and what is found is compared over all bits; a pair is counted in the first band that
finds it. Where blocks are small, or so many signatures meet in the bands that comparing all is
cheaper, all pairs of the two blocks are compared by bit planes held vertically: 64 signatures to a
machine word, distances of a query to all 64 counted at once by carry-save adders, lanes dropped as
soon as they are past the radius. Both ways give the same pairs. Links are counted there, and of each
pair of blocks only the edges of a star are passed on for each local component, which loses no
connection and keeps copies from being expanded into pairs.

Null ids and null or empty texts and others without a word are in no group; rows that repeat a doc_id
are one document (with a link between their texts if they differ, but are near). Very long texts are
read whole, chunk by chunk; an empty table gives an empty result. Only doc_id and text are read, so
other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrowtext import U64, Words, chunks, codepoints, mix
from sparkloom.llm.common import checkpoint, texts, without
from sparkloom.llm.components import connected_components

BITS, RADIUS, BANDS = 256, 42, 14
#: Signatures of a block at most, and of a block that isn't cut further to make more tasks.
BLOCK, SMALL_BLOCK = 1 << 18, 1 << 12
#: Nanoseconds of a value that a band is looked up at, more for each row, of comparing what is found, and of a pair where all are compared: they decide
#: which way is taken, never what is found.
FLIP, LOOK_UP, COMPARE, ALL_PAIRS = 100_000, 10, 45, 30
#: A byte's bits, each in a byte of its own.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").view(np.uint64)[:, 0]
SIG = [f"s{i}" for i in range(BITS // 64)]


def signatures(batches):
    for chunk in chunks(batches):
        w = Words(*codepoints(chunk.column("text")))
        if not len(w.hash):
            continue
        rows = w.row()
        order = np.lexsort((w.hash, rows))
        h, r = w.hash[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new], r[new]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        n = np.diff(np.append(first, len(r)))
        # eight counters of a byte each to a machine word, so rows are summed in runs of at most 255
        within = np.arange(len(r)) - np.repeat(first, n)
        run = np.flatnonzero(within % 255 == 0)
        at = np.searchsorted(run, first)
        out = []
        for k in range(len(SIG)):
            lanes = np.add.reduceat(SPREAD[mix(h, k + 7).view(np.uint8).reshape(-1, 8)], run, axis=0)
            ones = np.add.reduceat(lanes.view(np.uint8), at, axis=0, dtype=np.int32)
            out.append(np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id").take(pa.array(r[first])), *map(pa.array, out)], names=["doc_id", *SIG])


def unpack(sig: np.ndarray) -> np.ndarray:
    """(n, 4) words to (n, 256) bits."""
    return np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), -1), axis=1, bitorder="little")


def layout(radius: int) -> list:
    """Of each band: the positions of its bits, the most of them that may differ, and all values of such differences."""
    order, out = np.random.default_rng(8).permutation(BITS), []
    for k in range(BANDS):
        where, most = order[k::BANDS], (radius + 1) // BANDS - 1 + (k < (radius + 1) % BANDS)
        out.append((where, most, np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(len(where)), n)], np.int64)))
    return out


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def close_pairs(sig: np.ndarray, start: np.ndarray, radius: int = RADIUS, most: int = 1 << 14, stop: np.ndarray | None = None):
    """Pairs (i, j), start[i] <= j < stop[i], of rows with at most ``radius`` differing bits, in portions.

    sig: (n, 4) int64; start[i]: the first row that i is compared with; stop[i]: the row after the last, i if not given.
    Rows are cut into blocks of 64 lanes.
    """
    n = len(sig)
    if n < 2:
        return
    blocks = -(-n // 64)
    bits = np.zeros((blocks * 64, BITS), np.uint8)
    bits[:n] = unpack(sig)
    planes = np.ascontiguousarray(np.packbits(bits.reshape(blocks, 64, BITS), axis=1, bitorder="little").transpose(2, 0, 1)).view(U64)[:, :, 0]
    flip = np.ascontiguousarray(bits.T)
    row = np.arange(n)
    stop = row if stop is None else stop
    first, count = start // 64, np.where(start < stop, (stop - 1) // 64 - start // 64 + 1, 0)
    ends = np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        c = count[at:to]
        total = int(c.sum())
        q = np.repeat(row[at:to], c)
        k = np.repeat(first[at:to], c) + np.arange(total) - np.repeat(np.cumsum(c) - c, c)
        at = to
        if not total:
            continue
        low = np.clip(start[q] - 64 * k, 0, 64)
        high = np.clip(stop[q] - 64 * k, 0, 64)
        full = ~U64(0)
        lanes = np.where(high == 64, full, (U64(1) << np.minimum(high, 63).astype(U64)) - U64(1)) & np.where(low == 64, U64(0), full << np.minimum(low, 63).astype(U64))
        alive = lanes
        zero = np.zeros(total, U64)
        ones, twos, fours, high_planes = zero, zero, zero, [zero] * 6  # 8, 16, .. 256
        for b in range(0, BITS, 8):
            d = [planes[b + i][k] ^ (U64(0) - flip[b + i][q].astype(U64)) for i in range(8)]
            ones, two_a = _csa(ones, d[0], d[1])
            ones, two_b = _csa(ones, d[2], d[3])
            twos, four_a = _csa(twos, two_a, two_b)
            ones, two_a = _csa(ones, d[4], d[5])
            ones, two_b = _csa(ones, d[6], d[7])
            twos, four_b = _csa(twos, two_a, two_b)
            fours, carry = _csa(fours, four_a, four_b)
            for level in range(6):
                high_planes[level], carry = high_planes[level] ^ carry, high_planes[level] & carry
            if b % 16 == 8 and b + 8 > radius or b == BITS - 8:
                over, equal = np.zeros(len(q), U64), np.full(len(q), full)
                for level, plane in reversed(list(enumerate([ones, twos, fours, *high_planes]))):
                    if radius >> level & 1:
                        equal = equal & plane
                    else:
                        over |= equal & plane
                        equal = equal & ~plane
                alive = lanes & ~over
                keep = alive != 0
                if not keep.any():
                    break
                if not keep.all():
                    q, k, lanes, alive, ones, twos, fours = (x[keep] for x in (q, k, lanes, alive, ones, twos, fours))
                    high_planes = [x[keep] for x in high_planes]
        else:
            hit, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[hit], 64 * k[hit] + lane


def local_roots(n: int, pairs) -> np.ndarray:
    """The least row connected with each row."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while not (root[root] == root).all():
                root = root[root]
    return root


def gathered(pairs, most: int = 1 << 18):
    """The same pairs in portions of about ``most``."""
    held, n = [], 0
    for i, j in pairs:
        held.append((i, j))
        n += len(i)
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _values(words: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The bits at these positions as one number."""
    out = np.zeros(len(words), np.int64)
    for k, at in enumerate(where):
        out |= (words[:, at // 64] >> U64(at % 64) & U64(1)).astype(np.int64) << k
    return out


def _banded(sig: np.ndarray, cut: int, radius: int, plan: list, most: int = 1 << 17):
    """What pairs_between gives, by way of the bands."""
    masks = np.zeros((BANDS, BITS), np.uint8)
    for k, (where, _, _) in enumerate(plan):
        masks[k, where] = 1
    masks = np.packbits(masks, axis=1, bitorder="little").view(U64)
    words = sig.view(U64)

    def found(where, flips):
        """Pairs whose values of the band differ by one of the flips, without most of those past the radius."""
        value = _values(words, where)
        here, there = np.argsort(value[cut:], kind="stable") + cut, np.argsort(value[: cut or None], kind="stable")
        first = np.append(0, np.cumsum(np.bincount(value[there], minlength=1 << len(where))))
        some = first[1:] > first[:-1]
        probe = value[here]
        a, b = (np.ascontiguousarray(words[x, :2].T) for x in (here, there))
        for flip in flips:
            at = probe ^ flip
            hit = np.flatnonzero(some.take(at, mode="clip"))
            at = at[hit]
            low = first[at]
            n = first[at + 1] - low
            ends = np.cumsum(n)
            done = 0
            while done < len(hit):
                to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, side="right")))
                c = n[done:to]
                q = np.repeat(hit[done:to], c)
                p = np.arange(len(q)) + np.repeat(low[done:to] - (np.cumsum(c) - c), c)
                done = to
                # half of the bits are past the radius for almost all
                keep = np.flatnonzero(np.bitwise_count(a[0][q] ^ b[0][p]) + np.bitwise_count(a[1][q] ^ b[1][p]) <= radius)
                yield here[q[keep]], there[p[keep]]

    for k, (where, _, flips) in enumerate(plan):
        for i, j in gathered(found(where, flips)):
            x = words[i] ^ words[j]
            near = np.bitwise_count(x).sum(axis=1, dtype=np.int32) <= radius
            if not cut:
                near &= j < i
            i, j, x = i[near], j[near], x[near]
            new = np.ones(len(i), bool)
            for mask, (_, earlier, _) in zip(masks[:k], plan):
                new &= np.bitwise_count(x & mask).sum(axis=1, dtype=np.int32) > earlier
            yield i[new], j[new]


def _all(sig: np.ndarray, cut: int, radius: int, tile: int = 1 << 14):
    """What pairs_between gives, by comparing all rows, a tile with a tile."""
    for x in range(cut, len(sig), tile):
        for y in range(0, cut or x + 1, tile):
            ours, theirs = sig[x : x + tile], sig[y : min(y + tile, cut or len(sig))]
            if not cut and x == y:
                pairs, m = close_pairs(ours, np.zeros(len(ours), np.int64), radius), 0
            else:
                m, both = len(theirs), np.concatenate([theirs, ours])
                pairs = close_pairs(both, np.zeros(len(both), np.int64), radius, stop=np.where(np.arange(len(both)) < m, 0, m))
            for i, j in pairs:
                yield i - m + x, j + y


def pairs_between(sig: np.ndarray, cut: int, radius: int = RADIUS):
    """Pairs (i, j), j < cut <= i, of rows with at most ``radius`` differing bits, each once, in portions; with cut 0 those of all rows, j < i."""
    n, other, plan = len(sig) - cut, cut or len(sig), layout(radius)
    every, banded = ALL_PAIRS * n * other, (FLIP + LOOK_UP * n) * sum(len(flips) for _, _, flips in plan)
    if banded < every:
        # and what the bands find, by some of the rows
        words, found = sig.view(U64), 0
        some = words[cut :: max(1, n // 256)]
        for where, _, flips in plan:
            size = np.bincount(_values(words[:other], where), minlength=1 << len(where))
            found += int(size[_values(some, where)[:, None] ^ flips].sum())
        banded += COMPARE * n * found / len(some)
    yield from _banded(sig, cut, radius, plan) if banded < every else _all(sig, cut, radius)


def comparer(radius: int):
    """Rows (task, side, doc_id, signature) of whole tasks to the edges of stars (src, dst), and links (src, links) by task.

    A task's rows are of one block (side 0), or of two (sides 1 and 2) that are compared with each other.
    """

    def edges(side, doc, sig):
        cut = int((side == 1).sum())
        if len(doc) < 2 or cut == len(doc) or not cut and side[0]:
            return None
        order = np.argsort(side, kind="stable")
        doc, sig = doc[order], np.ascontiguousarray(sig[order])
        links = np.zeros(len(doc), np.int64)

        def counted(pairs):
            for i, j in pairs:
                for rows in (i, j):
                    links[:] += np.bincount(rows, minlength=len(doc))
                yield i, j

        root = local_roots(len(doc), counted(gathered(pairs_between(sig, cut, radius))))
        linked, some = np.flatnonzero(root != np.arange(len(doc))), np.flatnonzero(links)
        if not len(linked):
            return None
        pair = np.sort(np.stack([doc[linked], doc[root[linked]]], axis=1), axis=1)
        n, m = len(pair), len(some)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([pair[:, 0], doc[some]])), pa.array(np.concatenate([pair[:, 1], doc[some]]), mask=np.arange(n + m) >= n), pa.array(np.concatenate([np.zeros(n, np.int64), links[some]]))],
            names=["src", "dst", "links"],
        )

    def compare(batches):
        held: list = []
        for batch in batches:
            held.append([batch.column(c).to_numpy().copy() for c in ("task", "side", "doc_id", *SIG)])
        if not held:
            return
        task, side, doc, *sig = map(np.concatenate, zip(*held))
        sig = np.stack(sig, axis=1)
        for t in np.unique(task):
            rows = task == t
            out = edges(side[rows], doc[rows], sig[rows])
            if out is not None:
                yield out

    return compare


def blocks_for(n: int, tasks: int) -> int:
    """Blocks of n signatures: bounded, and enough for so many pairs of blocks unless they are small."""
    return max(math.ceil(n / BLOCK), min(math.ceil(math.sqrt(2 * tasks)), math.ceil(n / SMALL_BLOCK)), 1)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, group_id, kept, class_id, links: the documents of all groups of two and more.

    group_id and class_id are the least doc_ids of the group and of the documents with the same signature;
    links is the number of other classes within the radius of this one.
    """
    fields = "doc_id long, " + ", ".join(f"{c} long" for c in SIG)
    sigs = checkpoint(texts(docs).where(F.col("doc_id").isNotNull()).mapInArrow(signatures, fields))
    whole = sigs.groupBy(*SIG).agg(F.min("doc_id").alias("rep"))
    exact = sigs.join(whole, SIG).where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    blocks = blocks_for(sigs.count(), 3 * docs.sparkSession.sparkContext.defaultParallelism)
    # the two blocks of a task are the lower one, side 1, and the higher one, side 2; a block alone is side 0
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task, side = (high * (high + 1) / 2).cast("int") + low, F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    sent = whole.select(F.col("rep").alias("doc_id"), *SIG, F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(task.alias("task"), side.alias("side"), "doc_id", *SIG).repartitionById(blocks * (blocks + 1) // 2, "task")
    near = checkpoint(sent.mapInArrow(comparer(radius), "src long, dst long, links long"))
    exact = checkpoint(exact)
    found = connected_components(exact.union(near.where("dst IS NOT NULL").select("src", "dst"))).withColumnRenamed("node", "doc_id")
    links = near.where("dst IS NULL").groupBy(F.col("src").alias("class_id")).agg(F.sum("links").alias("links"))
    classes = found.join(exact.groupBy(F.col("src").alias("doc_id")).agg(F.min("dst").alias("class_id")), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return classes.join(links, "class_id", "left").select("doc_id", F.col("component").alias("group_id"), (F.col("doc_id") == F.col("component")).alias("kept"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group."""
    gone = near_duplicates(docs, **options).where("NOT kept").select("doc_id")
    return without(docs, gone)
