"""Substring dedup by collinear chaining.

Texts are sequences of folded words. Seeds are closed syncmers: runs of ``K`` words whose least word
hash is at their first or last place. The choice depends on nothing but the run, and any exact
repeat of 2 * K - 1 words holds a seed. All seeds meet by hash, and each occurrence is matched with
the earliest document that has the seed: the r-th place there with the r-th place here, and beyond
its last place with its first again, so that every copy keeps to a diagonal. A document
is so compared with the earliest holder of each of its seeds, and the number of matches never
exceeds that of seeds, however many documents share a passage.

The matches of two documents are merged along diagonals and chained: a chain's score is its seeded
words less ``GAP`` for each word that it skips on either side; the best predecessor is found by a
Fenwick tree over places in the other document. Chains are taken by score, each match once. Then
each chain is aligned on the words of both texts: equal words on the diagonals, the longest common
subsequence (bit-parallel) between them, and an extension at both ends while it pays. A chain is a
passage if it has ``MIN_WORDS`` words on both sides and ``IDENTITY`` of them are aligned; one that
falls short is cut where it skips most words, and its parts are tested in the same way.

Null ids and null, empty or shorter texts have no passage; repeats within a document don't count.
Rows that repeat a doc_id are taken as one document. The search is approximate only in fuzzy
passages where no run of K words is left whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import packed
from sparkloom.llm.arrowtext import BASE_INV, U64, Words, chunks, codepoints, mix, powers, prefix_hash, span_hash
from sparkloom.llm.common import parts_for, stored, texts

K, MIN_WORDS, IDENTITY, GAP, MERGE, MARGIN = 8, 40, 0.8, 0.25, 16, 48
SEED = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<i4")])
MATCH = np.dtype([("key", "<u8"), ("doc", "<i8"), ("of", "<i8"), ("at", "<i4"), ("of_at", "<i4")])
#: Chains of one document whose words are cut by one row.
REQUESTS = 5000
CHAIN = "doc_id long, of_doc_id long, at array<int>, of_at array<int>, n array<int>"


def seed_places(words: Words, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, row and place (word of the row) of every seed of a chunk."""
    h = words.hash
    none = np.zeros(0, np.int64)
    if len(h) < k:
        return none.astype(U64), none, none
    least = np.lib.stride_tricks.sliding_window_view(h, k).min(axis=1)
    row = words.row()
    at = np.flatnonzero(((h[: len(least)] == least) | (h[k - 1 :] == least)) & (row[: len(least)] == row[k - 1 :]))
    key = span_hash(prefix_hash(h), at, at + k, powers(len(h) + 1, BASE_INV))
    return mix(key, 1), row[at], at - words.first[row[at]]


def _seeds(parts: int):
    def emit(batches):
        to = packed.Packer(parts)
        for chunk in chunks(batches):
            key, row, at = seed_places(Words(*codepoints(chunk.column("text"))))
            out = np.empty(len(key), SEED)
            out["key"], out["at"] = key, at
            out["doc"] = chunk.column("doc_id").to_numpy()[row]
            yield from to.add(out)
        yield from to.flush()

    return emit


def match_seeds(seeds: np.ndarray) -> np.ndarray:
    """Each occurrence matched with the earliest document of its seed."""
    s = seeds[np.lexsort((seeds["at"], seeds["doc"], seeds["key"]))]
    key, doc, at = s["key"], s["doc"], s["at"]
    new = np.ones(len(s), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    key, doc, at = key[new], doc[new], at[new]
    if not len(key):
        return np.empty(0, MATCH)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    nth = np.arange(len(key)) - start[run]
    head = run[first][group]  # the run of the earliest document
    have = np.diff(np.append(start, len(key)))[head]
    use = np.flatnonzero(run != head)
    out = np.empty(len(use), MATCH)
    other = start[head[use]] + nth[use] % have[use]
    out["doc"], out["of"], out["at"], out["of_at"] = doc[use], doc[other], at[use], at[other]
    out["key"] = mix(out["doc"].view(U64), 2)
    return out


def _matches(parts: int):
    def match(table: pa.Table) -> pa.Table:
        to = packed.Packer(parts)
        out = [*to.add(match_seeds(packed.records(table, SEED))), *to.flush()]
        return pa.Table.from_batches(out, pa.schema([("part", pa.int32()), ("payload", pa.binary())]))

    return match


def diagonal_runs(m: np.ndarray, k: int = K):
    """(doc, of, at, of_at, words, seeded words), in order of (doc, of, at): seeds merged along diagonals."""
    diagonal = m["of_at"].astype(np.int64) - m["at"]
    order = np.lexsort((m["at"], diagonal, m["of"], m["doc"]))
    doc, of, at, diagonal = m["doc"][order], m["of"][order], m["at"][order].astype(np.int64), diagonal[order]
    cut = np.ones(len(at), bool)
    step = at[1:] - at[:-1]
    cut[1:] = (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]) | (diagonal[1:] != diagonal[:-1]) | (step > k + MERGE)
    gain = np.full(len(at), k)
    gain[1:] = np.where(cut[1:], k, np.minimum(step, k))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at)) - 1
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    runs = doc[first], of[first], at[first], at[first] + diagonal[first], at[last] + k - at[first], np.add.reduceat(gain, first)
    order = np.lexsort((runs[3], runs[2], runs[1], runs[0]))
    return tuple(x[order] for x in runs)


def chains(at: list[int], of_at: list[int], n: list[int], weight: list[int], gap: float = GAP) -> list[list[int]]:
    """Chains of the runs of one pair of documents, in order of at; each run is in one chain."""
    size = len(at)
    places = sorted({p for o, m in zip(of_at, n) for p in (o, o + m)})
    rank = {p: i + 1 for i, p in enumerate(places)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(places) + 1)
    score, before = [0.0] * size, [-1] * size
    by_end = sorted(range(size), key=lambda i: at[i] + n[i])
    done = 0
    for j in range(size):
        while done < size and at[by_end[done]] + n[by_end[done]] <= at[j]:  # ends before j begins, so its score is known
            i = by_end[done]
            entry = (score[i] + gap * (at[i] + n[i] + of_at[i] + n[i]), i)
            p = rank[of_at[i] + n[i]]
            while p < len(tree):
                tree[p] = max(tree[p], entry)
                p += p & -p
            done += 1
        best, p = (-1e18, -1), rank[of_at[j]]
        while p:
            best = max(best, tree[p])
            p -= p & -p
        gain = best[0] - gap * (at[j] + of_at[j])
        score[j], before[j] = (weight[j] + gain, best[1]) if gain > 0 else (float(weight[j]), -1)
    out, taken = [], [False] * size
    for j in sorted(range(size), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not taken[j]:
            taken[j] = True
            chain.append(j)
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _chain(table: pa.Table) -> pa.Table:
    doc, of, at, of_at, n, weight = diagonal_runs(packed.records(table, MATCH))
    new = np.append(True, (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]))[: len(doc)]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(doc)))
    order, lengths, heads = [first[size == 1]], [np.ones((size == 1).sum(), np.int64)], [first[size == 1]]
    for a, s in zip(first[size > 1], size[size > 1]):
        part = slice(a, a + s)
        for c in chains(at[part].tolist(), of_at[part].tolist(), n[part].tolist(), weight[part].tolist()):
            order.append(np.array(c) + a)
            lengths.append(np.array([len(c)]))
            heads.append(np.array([a]))
    order, lengths, heads = (np.concatenate(x) for x in (order, lengths, heads))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in (at, of_at, n)]
    return pa.table([pa.array(doc[heads]), pa.array(of[heads]), *lists], names=["doc_id", "of_doc_id", "at", "of_at", "n"])


def _cut(batches):
    """Rows (text, requests) to the words of each requested span, as hashes, and where the slice begins."""
    for chunk in chunks(batches):
        w = Words(*codepoints(chunk.column("text")))
        ask = chunk.column("requests")
        flat = ask.flatten()
        row = np.repeat(np.arange(len(ask)), np.diff(ask.offsets.to_numpy()))
        begin, end = (flat.field(f).to_numpy().astype(np.int64) for f in ("begin", "end"))
        total = np.diff(w.first)[row]
        begin, end = np.clip(begin, 0, total), np.clip(end, 0, total)
        size = end - begin
        at = np.repeat(w.first[:-1][row] + begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        word = (w.hash[at] >> U64(32)).astype(np.uint32).view(np.int32)
        step = 4096  # slices of a batch
        offsets = np.concatenate([[0], np.cumsum(size)])
        for a in range(0, len(row), step):
            b = min(len(row), a + step)
            lists = pa.ListArray.from_arrays(pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32)), pa.array(word[offsets[a] : offsets[b]]))
            yield pa.RecordBatch.from_arrays([flat.field("chain").slice(a, b - a), flat.field("side").slice(a, b - a), pa.array(begin[a:b]), lists], names=["chain", "side", "begin", "words"])


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not len(a) or not len(b):
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _further(same: np.ndarray) -> int:
    """How far an extension over these comparisons pays: 1 for an equal word, -2 for another."""
    if not len(same):
        return 0
    s = np.cumsum(np.where(same, 1, -2))
    best = int(s.argmax())
    return best + 1 if s[best] > 0 else 0


def align(a: np.ndarray, a_begin: int, b: np.ndarray, b_begin: int, at, of_at, n) -> tuple[int, int, int, int, int]:
    """Start and end on both sides, and aligned words, of a chain on two slices of words."""
    at, of_at, n = np.asarray(at) - a_begin, np.asarray(of_at) - b_begin, np.asarray(n)
    hits = 0
    for i in range(len(at)):
        hits += int((a[at[i] : at[i] + n[i]] == b[of_at[i] : of_at[i] + n[i]]).sum())
        if i:
            hits += common_words(a[at[i - 1] + n[i - 1] : at[i]], b[of_at[i - 1] + n[i - 1] : of_at[i]])
    start, of_start, end, of_end = int(at[0]), int(of_at[0]), int(at[-1] + n[-1]), int(of_at[-1] + n[-1])
    left = min(start, of_start)
    same = a[start - left : start][::-1] == b[of_start - left : of_start][::-1]
    more = _further(same)
    hits += int(same[:more].sum())
    right = min(len(a) - end, len(b) - of_end)
    same = a[end : end + right] == b[of_end : of_end + right]
    further = _further(same)
    hits += int(same[:further].sum())
    return start - more + a_begin, end + further + a_begin, of_start - more + b_begin, of_end + further + b_begin, hits


def passes(found: tuple[int, int, int, int, int]) -> bool:
    s, e, t, f, hits = found
    return min(e - s, f - t) >= MIN_WORDS and hits >= IDENTITY * max(e - s, f - t)


def passages_of(a: np.ndarray, a_begin: int, b: np.ndarray, b_begin: int, at, of_at, n) -> list[tuple[int, int, int, int, int]]:
    """The passages of a chain, as ``align`` has them: the whole, or else those of its parts.

    Parts consist of stretches of equal words. Each is extended by at most ``MARGIN`` words, as a chain is;
    a part that lies within a longer passage isn't another one.
    """
    whole = align(a, a_begin, b, b_begin, at, of_at, n)
    if passes(whole):
        return [whole]
    at, of_at, n = (np.asarray(x).astype(np.int64) for x in (at, of_at, n))
    start, of_start, size = [], [], []
    for x, y, m in zip(at - a_begin, of_at - b_begin, n):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], a[x : x + m] == b[y : y + m], [0]])))
        start.append(x + edge[::2])
        of_start.append(y + edge[::2])
        size.append(edge[1::2] - edge[::2])
    start, of_start, size = (np.concatenate(x) for x in (start, of_start, size))
    end, of_end = start + size, of_start + size
    skipped = start[1:] - end[:-1], of_start[1:] - of_end[:-1]
    common = np.array([common_words(a[end[i] : start[i + 1]], b[of_end[i] : of_start[i + 1]]) for i in range(len(start) - 1)], np.int64)
    cost = skipped[0] + skipped[1] - 2 * common
    hits = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(common)])
    found, todo = [], [(0, len(start))]
    while todo:
        i, j = todo.pop()
        if i == j:
            continue
        s, t, e, f = int(start[i]), int(of_start[i]), int(end[j - 1]), int(of_end[j - 1])
        left, right = min(s, t, MARGIN), min(len(a) - e, len(b) - f, MARGIN)
        before, after = a[s - left : s][::-1] == b[t - left : t][::-1], a[e : e + right] == b[f : f + right]
        more, further = _further(before), _further(after)
        aligned = int(hits[0][j] - hits[0][i] + hits[1][j - 1] - hits[1][i] + before[:more].sum() + after[:further].sum())
        part = s - more + a_begin, e + further + a_begin, t - more + b_begin, f + further + b_begin, aligned
        if passes(part):
            found.append((part, (s + a_begin, e + a_begin, t + b_begin, f + b_begin)))
        elif j - i > 1:
            cut = i + 1 + int(cost[i : j - 1].argmax())
            todo += [(cut, j), (i, cut)]
    out: list[tuple[int, int, int, int, int]] = []
    for part, (s, e, t, f) in sorted(found, key=lambda x: (x[0][0] - x[0][1], x[0])):
        if not any(p[0] <= s and e <= p[1] and p[2] <= t and f <= p[3] for p in out):
            out.append(part)
    return sorted(out)


def _align(batches):
    for batch in batches:
        out = []
        get = {c: batch.column(c) for c in batch.schema.names}
        lists = {c: (get[c].flatten().to_numpy(zero_copy_only=False), get[c].offsets.to_numpy() - get[c].offsets[0].as_py()) for c in ("at", "of_at", "n", "words", "of_words")}
        begin, of_begin = get["begin"].to_numpy(), get["of_begin"].to_numpy()
        for i in range(batch.num_rows):
            at, of_at, n, a, b = (v[o[i] : o[i + 1]] for v, o in (lists[c] for c in ("at", "of_at", "n", "words", "of_words")))
            if at[-1] + n[-1] - begin[i] > len(a) or of_at[-1] + n[-1] - of_begin[i] > len(b):
                continue  # cut from another row with the same doc_id
            for s, e, t, f, hits in passages_of(a, int(begin[i]), b, int(of_begin[i]), at, of_at, n):
                out.append((i, s, e, t, f, hits / max(e - s, f - t)))
        if out:
            i, s, e, t, f, identity = zip(*out)
            rows = pa.array(i)
            yield pa.RecordBatch.from_arrays([get["doc_id"].take(rows), *(pa.array(x, pa.int64()) for x in (s, e)), get["of_doc_id"].take(rows), *(pa.array(x, pa.int64()) for x in (t, f)), pa.array(identity)], names=["doc_id", "first_word", "end_word", "of_doc_id", "of_first_word", "of_end_word", "identity"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, first_word, end_word, of_doc_id, of_first_word, of_end_word, identity: passages that repeat one of an earlier document."""
    docs = texts(docs).where(F.col("doc_id").isNotNull())
    parts = parts_for(docs, 1.0)
    matches = docs.mapInArrow(_seeds(parts), packed.SCHEMA).groupBy("part").applyInArrow(_matches(parts), packed.SCHEMA)
    found = matches.groupBy("part").applyInArrow(_chain, CHAIN)
    found = stored(found.withColumn("chain", F.xxhash64("doc_id", "of_doc_id", "at", "of_at")), "chains")
    span = lambda c: (F.element_at(c, 1) - MARGIN, F.element_at(c, -1) + F.element_at("n", -1) + MARGIN)
    sides = found.select(F.explode(F.array(*(F.struct(F.col(d).alias("doc_id"), F.col("chain"), F.lit(i).alias("side"), span(c)[0].alias("begin"), span(c)[1].alias("end")) for i, (d, c) in enumerate((("doc_id", "at"), ("of_doc_id", "of_at")))))).alias("x")).select("x.*")
    asked = sides.groupBy("doc_id").count().select("doc_id", F.ceil(F.col("count") / REQUESTS).alias("lots"))
    requests = sides.join(asked, "doc_id").groupBy("doc_id", F.pmod("chain", "lots").alias("lot")).agg(F.collect_list(F.struct("chain", "side", "begin", "end")).alias("requests"))
    slices = docs.join(requests, "doc_id").select("text", "requests").mapInArrow(_cut, "chain long, side int, begin long, words array<int>")
    both = slices.groupBy("chain").agg(*(F.max(F.when(F.col("side") == i, F.struct("begin", "words"))).alias(n) for i, n in enumerate(("a", "b"))))
    both = found.join(both, "chain").select("doc_id", "of_doc_id", "at", "of_at", "n", F.col("a.begin").alias("begin"), F.col("a.words").alias("words"), F.col("b.begin").alias("of_begin"), F.col("b.words").alias("of_words"))
    return both.mapInArrow(_align, "doc_id long, first_word long, end_word long, of_doc_id long, of_first_word long, of_end_word long, identity double")
