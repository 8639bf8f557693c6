"""Best-fit packing of documents into training sequences after Martello and Toth's reduction.

A document takes its tokens and one separator. What is longer than a sequence is cut into full
sequences and a rest. The instance is the histogram of piece sizes, at most ``capacity`` numbers
whatever the size of the corpus, and the driver solves it by classes of equal pieces:

* reduction: for a piece j, largest first, a set of one to three pieces is fixed in a bin of its own
  for good if it dominates every other bin that could hold j: j alone if nothing else fits; j and
  the largest piece i that fits, if no two others fit besides j, or j and i fill the bin, or i is at
  least as large as the best two; j and the best two, if the larger of them is i and no two pieces
  between them in order fit instead;
* the rest goes largest first to the fullest bin that has room (best fit).

A step fixes as many equal bins as the classes hold, so the plan is a short list of runs: the
pieces of a class from one rank to another go to consecutive bins. Executors rank the pieces of
each class by doc_id, piece and a hash of the text, at every size of the corpus: the pieces are sorted
by ranges, so that a frequent size is no hot partition, and counted on from part to part.

Null and empty texts have no piece, an empty table gives no row; very long texts are cut into as many
pieces as they need. Rows with null or repeated ids are packed each on its own, null ids first; rows
that are equal in id and text are interchangeable. Only doc_id and text are read, so other columns,
whatever their names, change nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.arrowtext import chunks
from sparkloom.llm.common import stored, texts
from sparkloom.llm.tokens import VOCABULARY, token_lists

CAPACITY = 4096
#: Pieces of a part of the sort that ranks them.
PART_ROWS = 1_000_000
#: Runs of a plan that are sent to every executor (48 bytes each); a longer plan is joined by a shuffle.
BROADCAST_RUNS = 100_000


class Classes:
    """A multiset of sizes, kept as counts."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int = 1) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def put(self, size: int, n: int = 1) -> None:
        if size not in self.count:
            self.count[size] = 0
            insort(self.sizes, size)
        self.count[size] += n

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(self.count[s], n - len(out))
            if len(out) == n:
                break
        return out

    def largest_at_most(self, size: int) -> int | None:
        i = bisect_left(self.sizes, size + 1)
        return self.sizes[i - 1] if i else None

    def best_two(self, room: int) -> tuple[int, int]:
        """Sizes a >= b of two pieces with the largest sum within room; the larger a first where sums are equal."""
        best, j, i = (-1, 0, 0), len(self.sizes) - 1, 0
        while i <= j:
            b, a = self.sizes[i], self.sizes[j]
            if a + b > room or (i == j and self.count[a] < 2):
                j -= 1
                continue
            best = max(best, (a + b, a, b))
            i += 1
        return best[1], best[2]


def dominating(rest: Classes, size: int, capacity: int) -> tuple[int, ...] | None:
    """Partners of a piece of this size (itself not in rest) in a set that dominates, or None."""
    room = capacity - size
    least = rest.smallest(3)
    fit = int(np.searchsorted(np.cumsum(least), room, side="right")) if least else 0
    if not fit:
        return ()
    one = rest.largest_at_most(room)
    if fit == 1 or one == room:
        return (one,)
    if fit > 2:
        return None
    a, b = rest.best_two(room)
    if one >= a + b:
        return (one,)
    if one == a:
        between: list[int] = []  # the two smallest pieces after a and before b in order of size
        for s in rest.sizes[bisect_left(rest.sizes, b + 1) :]:
            if s > a or len(between) >= 2:
                break
            between += [s] * min(2, rest.count[s] - (s == a))
        if len(between) < 2 or between[0] + between[1] > room:
            return a, b
    return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Runs (size, rank from, rank to, pieces of the run in a bin, first bin, place in the bin), bins fixed by reduction, bins in all."""
    rest = Classes(histogram)
    used = dict.fromkeys(histogram, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def run(size: int, n: int, each: int, first: int, place: int) -> None:
        runs.append((size, used[size], used[size] + n, each, first, place))
        used[size] += n

    for size in sorted(histogram, reverse=True):
        while rest.count.get(size):
            rest.take(size)
            partners = dominating(rest, size, capacity)
            rest.put(size)
            if partners is None:
                break
            members = (size, *partners)
            times = min(rest.count[s] // members.count(s) for s in members)
            place = 0
            for s in members:
                run(s, times, 1, bins, place)
                rest.take(s, times)
                place += s
            bins += times
    fixed = bins
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left: runs of bins
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((first, n))

    for size in reversed(rest.sizes):
        n = rest.count[size]
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                first, have = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            else:
                room, first, have = capacity, bins, -(-n // (capacity // size))
                bins += have
            each = room // size
            filled = min(have, n // each)
            if filled:
                run(size, filled * each, each, first, capacity - room)
                leave(room - each * size, first, filled)
                n -= filled * each
                first, have = first + filled, have - filled
            if n and have and n < each:
                run(size, n, n, first, capacity - room)
                leave(room - n * size, first, 1)
                n, first, have = 0, first + 1, have - 1
            leave(room, first, have)
    return runs, fixed, bins


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, token_start, n_tokens, tie (a hash of the text): the last piece of a document also holds its separator."""

    def cut(batches):
        for chunk in chunks(batches):
            total = np.array([len(x) + 1 if x else 0 for x in token_lists(chunk.column("text"), vocabulary)], dtype=np.int64)
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            yield pa.RecordBatch.from_arrays([*(chunk.column(c).take(pa.array(row)) for c in ("doc_id", "tie")), *map(pa.array, (piece, start, np.minimum(capacity, total[row] - start)))], names=["doc_id", "tie", "piece", "token_start", "n_tokens"])

    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    return rows.mapInArrow(cut, "doc_id long, tie long, piece long, token_start long, n_tokens long")


def _numbered(batches):
    """Rows of a part in order, with their number within (part, n_tokens): rows of one size are next to each other."""
    size, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column("n_tokens").to_numpy()
        first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        within = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
        if n[0] == size:
            within[: first[1] if len(first) > 1 else len(n)] += seen
        size, seen = n[-1], int(within[-1]) + 1
        yield batch.append_column("within", pa.array(within))


def ranked(cut: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """cut with ``rank``, the place of each piece among those of its size in order of doc_id, piece and tie."""
    order = ["n_tokens", "doc_id", "piece", "tie"]
    parts = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cut.count() // part_rows))
    rows = cut.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", within long"
    rows = stored(rows.mapInArrow(_numbered, fields), "ranked")
    count = rows.groupBy("n_tokens", "part").agg(F.count("*").alias("count"))  # as many rows as there are sizes and parts together
    before = count.withColumn("before", F.sum("count").over(Window.partitionBy("n_tokens").orderBy("part")) - F.col("count")).drop("count")
    return rows.join(before, ["n_tokens", "part"]).withColumn("rank", F.col("within") + F.col("before"))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, token_start, n_tokens, bin_id, bin_start: the sequence of each piece and its place in there."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, vocabulary), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("n_tokens").count().collect()}  # at most ``capacity`` rows
    runs, _, _ = plan(histogram, capacity)
    table = spark.createDataFrame(runs, "size long, rank_from long, rank_to long, each long, first_bin long, place long")
    if len(runs) <= BROADCAST_RUNS:  # a few for each size up to the capacity, however large the corpus
        table = F.broadcast(table)
    at = F.col("rank") - F.col("rank_from")
    return ranked(cut).join(table, (F.col("n_tokens") == F.col("size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).select(
        "doc_id", "piece", "token_start", "n_tokens", (F.col("first_bin") + F.floor(at / F.col("each"))).alias("bin_id"), (F.col("place") + at % F.col("each") * F.col("n_tokens")).alias("bin_start")
    )
