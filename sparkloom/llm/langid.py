"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter pair or triple is bound into one vector: the
vectors of its letters, rotated by two, one and no places, are multiplied component by component.
A document is the sum (bundle) of the vectors of all its pairs and triples, a language the sum of
the unit vectors of its training documents, and they are compared by cosine. Runs of anything that
is no letter count as one separator.

Prototypes are trained on at most ``SAMPLE`` labelled documents of each language, taken by a hash of
doc_id from the whole table, and as many others calibrate what is accepted. Texts in one alphabet
share letters and so have cosines well above the noise of 1 / sqrt(DIM) = 0.02, the higher the longer
they are. So stretches of ``LEVELS`` characters of the calibrating documents are judged like
documents, and for each power of two of n-grams a text has to reach the ``REJECTED`` quantile of their
cosines, and also that of their margins to the next language if its cosine is below the ``DOUBTFUL``
quantile (a text in two languages is near both of them, junk is near none). Texts of under
``JUDGED`` n-grams are too short to tell a language from junk and are accepted if they have a letter
pair; without ``POINTS`` calibrating texts of a size, those of the size below count, or
``LEAST_COSINE`` and no margin where there are none.

Null and empty texts, texts without a letter pair, and every text where there is nothing to train on,
have a null language and are not accepted. Equal cosines go to the language first in the alphabet.
Very long texts are judged whole. Each row is judged by itself, so repeated rows and ids do no harm;
an empty table gives an empty result. Other columns, whatever their names, pass through ``accepted``
unchanged and are left out by ``identify``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.arrowtext import chunks, codepoints, fold
from sparkloom.llm.common import small_batches, stored, texts

DIM, SYMBOLS, SAMPLE, LEAST_COSINE = 2048, 4096, 256, 0.09
REJECTED, DOUBTFUL, LEVELS, JUDGED, POINTS = 0.002, 0.01, tuple(1 << i for i in range(4, 12)), 32, 500
#: Triples whose vectors are held at once, documents times triples in a table of counts, bytes and rows of a chunk.
SLICE, TABLE, BYTES, ROWS = 1024, 1 << 20, 1 << 19, 1024


class Model(NamedTuple):
    """Languages in order, their unit vectors, and by size (power of two of n-grams) the least cosine, the one past which no margin is asked for, and the least margin."""

    names: list[str]
    profiles: np.ndarray
    least_cosine: np.ndarray
    sure_cosine: np.ndarray
    least_margin: np.ndarray


def letter_vectors() -> np.ndarray:
    rng = np.random.default_rng(3)
    return np.concatenate([rng.choice(np.array([-1, 1], np.int8), (64, DIM)) for _ in range(SYMBOLS // 64)])  # in parts, since numbers of 8 bytes are drawn


_LETTERS: list[np.ndarray] = []


def _letters() -> list[np.ndarray]:
    """The letters' vectors rotated by 2, 1 and 0 places."""
    if not _LETTERS:
        base = letter_vectors()
        _LETTERS.extend(np.roll(base, k, axis=1) for k in (2, 1, 0))
    return _LETTERS


def symbols(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and symbol of the letters and separators that are left."""
    sym = fold(codes)
    sym = np.where((sym >= 48) & (sym < 58), 0, sym)
    if len(sym) and sym.max() >= SYMBOLS:
        sym = np.where(sym < SYMBOLS, sym, 1024 + (sym * np.uint32(2654435761) >> np.uint32(8)) % (SYMBOLS - 1024))
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    at = np.flatnonzero(keep)
    return np.searchsorted(starts, at, side="right") - 1, sym[at].astype(np.int64)


def _add(out: np.ndarray, row: np.ndarray, code: np.ndarray, most: int, vectors) -> None:
    """Add the vectors of the n-grams, by code below ``most``, to their rows."""
    n = len(out)
    if most <= 1 << 24:
        seen = np.zeros(most, bool)
        seen[code] = True
        distinct, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
    else:
        distinct, code = np.unique(code, return_inverse=True)
    step = min(SLICE, max(1, TABLE // n))
    order = np.argsort(code, kind="stable") if len(distinct) > step else None
    for at in range(0, len(distinct), step):
        part = distinct[at : at + step]
        if order is None:
            r, k = row, code
        else:
            use = order[np.searchsorted(code[order], at) : np.searchsorted(code[order], at + len(part))]
            r, k = row[use], code[use] - at
        counts = np.bincount(r * len(part) + k, minlength=n * len(part)).reshape(n, len(part)).astype(np.float32)
        out += counts @ vectors(part).astype(np.float32)


def document_vectors(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each row, and how many n-grams it has."""
    n = len(starts) - 1
    out, size = np.zeros((n, DIM), np.float32), np.zeros(n, np.int64)
    row, sym = symbols(codes, starts)
    letters = np.flatnonzero(np.bincount(sym, minlength=SYMBOLS))
    m = len(letters)
    local = np.zeros(SYMBOLS, np.int64)
    local[letters] = np.arange(m)
    sym = local[sym]
    first, second, third = _letters()
    pair = np.flatnonzero(row[1:] == row[:-1])
    if len(pair):
        _add(out, row[pair], sym[pair] * m + sym[pair + 1], m**2, lambda c: second[letters[c // m]] * third[letters[c % m]])
        size += np.bincount(row[pair], minlength=n)
    three = np.flatnonzero(row[2:] == row[:-2])
    if len(three):
        _add(out, row[three], (sym[three] * m + sym[three + 1]) * m + sym[three + 2], m**3, lambda c: first[letters[c // (m * m)]] * second[letters[c // m % m]] * third[letters[c % m]])
        size += np.bincount(row[three], minlength=n)
    return out, size


def _bundles(batches):
    """Sums of unit document vectors by language: one row for each language of a chunk."""
    for chunk in chunks(batches, limit=BYTES, rows=ROWS):
        vec, n = document_vectors(*codepoints(chunk.column("text")))
        vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
        lang = chunk.column("lang").to_pylist()
        names = sorted(set(lang))
        sums = [vec[[i for i, x in enumerate(lang) if x == name]].sum(axis=0, dtype=np.float64) for name in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["lang", "v"])


def fragments(text: str) -> list[str]:
    """Up to four stretches, evenly spread, of each of the ``LEVELS``, and the text if it isn't longer than the last of them."""
    out = [text] if len(text) <= LEVELS[-1] else []
    for size in LEVELS:
        n = min(4, len(text) // size)
        out += [text[at : at + size] for at in ((len(text) - size) * k // max(1, n - 1) for k in range(n))]
    return out


def sizes(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1


def thresholds(n: np.ndarray, value: np.ndarray, least: float, quantile: float = REJECTED) -> np.ndarray:
    """By size: the quantile of the values of texts of that size, never less than that of a size below."""
    size, out, now, known = sizes(n), np.full(64, -1.0), least, False
    for k in range(64):
        own = value[size == k]
        if len(own) >= POINTS:
            least_here = float(np.quantile(own, quantile))
            now, known = max(now, least_here) if known else least_here, True
        if 1 << k >= JUDGED:
            out[k] = now
    return out


def prototypes(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled documents of each language, calibrated on as many others.

    Of each (language, slot of the hash of doc_id) the document with the least hash is taken, so
    nothing but one long for each slot is gathered before the texts are read; the slots of a language
    train and calibrate in turn, the first of them trains.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64("doc_id")).withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2 * sample)))
    chosen = rows.groupBy("lang", "slot").agg(F.min("hash").alias("hash"))  # 2 * ``sample`` rows a language, so the planner can broadcast them
    chosen = stored(chosen.withColumn("trains", F.row_number().over(Window.partitionBy("lang").orderBy("slot")) % 2 == 1), "sample")
    part = lambda trains: rows.join(chosen.where(F.col("trains") == trains), ["lang", "slot", "hash"], "left_semi").select("lang", "text")
    sums: dict[str, np.ndarray] = {}
    for r in part(True).mapInArrow(_bundles, "lang string, v array<double>").toLocalIterator():
        sums[r[0]] = sums.get(r[0], 0) + np.array(r[1])
    names = sorted(k for k, v in sums.items() if np.linalg.norm(v) > 0)
    profiles = np.stack([sums[k] / np.linalg.norm(sums[k]) for k in names]).astype(np.float32) if names else np.zeros((0, DIM), np.float32)

    def calibrate(batches):
        for chunk in chunks(batches, limit=BYTES, rows=ROWS):
            whole = pa.RecordBatch.from_arrays([pa.array([f for t in chunk.column("text").to_pylist() for f in fragments(t)], pa.string())], names=["text"])
            for part in chunks([whole], limit=BYTES, rows=ROWS):
                n, _, top, margin = compare(part.column("text"), names, profiles)
                yield pa.RecordBatch.from_arrays([pa.array([x.tolist()]) for x in (n, top, margin)], names=["n", "cosine", "margin"])

    found = [np.zeros(0), np.zeros(0), np.zeros(0)]
    if names:  # numbers only, a bounded sample's
        for r in part(False).mapInArrow(calibrate, "n array<long>, cosine array<double>, margin array<double>").toLocalIterator():
            found = [np.concatenate([a, np.array(b)]) for a, b in zip(found, r)]
    return Model(names, profiles, thresholds(found[0], found[1], LEAST_COSINE), thresholds(found[0], found[1], LEAST_COSINE, DOUBTFUL), thresholds(found[0], found[2], 0.0))


def compare(column: pa.Array, names: list[str], profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of n-grams, best language, its cosine and the margin to the next one, for each text."""
    vec, n = document_vectors(*codepoints(column))
    cosine = vec @ profiles.T / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
    best = cosine.argmax(axis=1)
    at = np.arange(len(n))
    top = cosine[at, best].astype(np.float64)
    if len(names) == 1:
        return n, best, top, top
    rest = cosine.copy()
    rest[at, best] = -2
    return n, best, top, top - rest.max(axis=1)


def judge(column: pa.Array, model: Model):
    """Language, cosine, margin to the next language, and whether it is accepted, for each text."""
    if not model.names:
        return pa.nulls(len(column), pa.string()), pa.nulls(len(column), pa.float64()), pa.nulls(len(column), pa.float64()), pa.array(np.zeros(len(column), bool))
    n, best, top, margin = compare(column, model.names, model.profiles)
    none, size = n == 0, sizes(n)
    language = pa.array([None if x else model.names[i] for i, x in zip(best, none)], pa.string())
    fits = ~none & (top >= model.least_cosine[size]) & ((top >= model.sure_cosine[size]) | (margin >= model.least_margin[size]))
    return language, pa.array(top, mask=none), pa.array(margin.astype(np.float64), mask=none), pa.array(fits)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, language, cosine, margin, accepted: a row for each row of docs."""
    model = model or prototypes(docs)

    def run(batches):
        for chunk in chunks(batches, limit=BYTES, rows=ROWS):
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *judge(chunk.column("text"), model)], names=["doc_id", "language", "cosine", "margin", "accepted"])

    return texts(docs).mapInArrow(run, "doc_id long, language string, cosine double, margin double, accepted boolean")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that are accepted, with all their columns."""
    small_batches(docs.sparkSession)
    model = model or prototypes(docs)
    plain = [f"c{i}" for i in range(len(docs.columns))]  # mapInArrow takes no names with dots
    text = plain[docs.columns.index("text")]
    fields = [T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields)]

    def run(batches):
        for chunk in chunks(batches, text, BYTES, ROWS):
            yield chunk.append_column("keep", judge(chunk.column(text), model)[-1])

    judged = docs.toDF(*plain).mapInArrow(run, T.StructType([*fields, T.StructField("keep", T.BooleanType())]))
    return judged.where("keep").select(*(F.col(c).alias(name) for c, name in zip(plain, docs.columns)))
