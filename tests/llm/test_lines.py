import random

import numpy as np
import pytest

from sparkloom.llm import linededup as L


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distances(edits):
    rng = random.Random(edits)
    left = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    right = []
    for a in left:
        b = list(a)
        for _ in range(rng.randint(0, edits + 1)):
            b[(at := rng.randint(0, len(b))) : at + rng.randint(0, 1)] = rng.choice(["", "a", "𐐷"])
        right.append("".join(b))
    want = [min(levenshtein(a, b), edits + 1) for a, b in zip(left, right)]
    assert L.edit_distances(left, right, edits).tolist() == want


def brute(rows, edits, least):
    lines = sorted({(d, i, x.strip(" \t\r")) for d, t in rows if d is not None and t for i, x in enumerate(t.split("\n")) if len(x.strip(" \t\r")) >= least})
    out = set()
    for k, (d, i, x) in enumerate(lines):
        for e, j, y in lines[:k]:
            if abs(len(x) - len(y)) <= edits and (n := levenshtein(x, y)) <= edits:
                out.add((d, i, e, j, n))
                break
    return out


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(6, 30))) for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append("".join(s) + rng.choice(["", "\r", "  "]))
        rows.append((d, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (None, "abc abc abc abc"), (3, rows[3][1]), (102, "\n\n"), (103, "z" * 40 + "\n" + "z" * 41)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(docs, seed):
    rows = texts(seed)
    assert {tuple(r) for r in L.repeated_lines(docs(rows), edits=2, least=8).collect()} == brute(rows, 2, 8)


def test_drop(clashing):
    a, b, c = "one line that is long enough, really", "another line that is long enough too", "a third line of quite sufficient length"
    df = clashing([(1, f"{a}\n{b}\nx"), (2, f"{a}!\n{c}"), (3, b), (4, None), (5, ""), (None, a)])
    out = L.drop_repeated_lines(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, f"{a}\n{b}\nx", len(f"{a}\n{b}\nx")), (2, c, len(c)), (4, None, None), (5, "", 0), (None, a, len(a))}
    assert L.drop_repeated_lines(df.limit(0)).count() == 0


def test_long_line(docs):
    long = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 300_000))
    found = L.repeated_lines(docs([(1, long), (2, long[:150_000] + "#" + long[150_001:])])).collect()
    assert [tuple(r) for r in found] == [(2, 0, 1, 0, 1)]


@pytest.mark.parametrize("seed", [3, 4])
def test_short_lines_repeat(docs, seed):
    rng = random.Random(seed)
    rows = texts(seed) + [(200 + i, "\n".join(rng.choice(["}", "é", " ab\t", "Ietzte.", "Ietzta.", "And ornd.", "And ornd", "", "  "]) for _ in range(5))) for i in range(8)]
    short = lambda a: len(a) < L.NEAR_CHARS
    lines = {(d, i): x.strip(" \t\r") for d, t in rows if d is not None and t for i, x in enumerate(t.split("\n"))}
    first = {}
    for place in sorted(lines):
        first.setdefault(lines[place], place)
    want = {(*p, *first[x], 0) for p, x in lines.items() if x and short(x) and p != first[x]} | brute(rows, L.EDITS, L.NEAR_CHARS)
    assert sum(short(lines[r[:2]]) for r in want) > 10
    assert {tuple(r) for r in L.repeated_lines(docs(rows)).collect()} == want


def test_drop_short_lines(docs):
    rows = [(1, "Ietzte.\n\nIetzte.\nIetzta."), (2, "Ietzte."), (3, "x\n}\n}")]
    assert {(r.doc_id, r.text) for r in L.drop_repeated_lines(docs(rows)).collect()} == {(1, "Ietzte.\n\nIetzta."), (3, "x\n}")}


def test_whole_table(spark):
    from tests.conftest import compared

    folder = "/root/testdata/sf0.01"
    ours, theirs = compared(L.repeated_lines(spark.read.parquet(f"{folder}/documents.parquet")), L.ORACLE, folder)
    assert ours == theirs
