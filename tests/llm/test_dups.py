import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import decontam, passages, simhash
from sparkloom.llm.arrowtext import Words, codepoints
from sparkloom.llm.components import connected_components

rng = random.Random(4)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(t, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in t.split())


def test_close_pairs_is_exact():
    g = np.random.default_rng(2)
    sig = g.integers(-(2**63), 2**63, (300, 4), dtype=np.int64)
    for i in range(1, 300, 2):
        flips = g.choice(256, g.integers(0, 80), replace=False)
        bits = simhash.unpack(sig[i - 1 : i])[0].copy()
        bits[flips] ^= 1
        sig[i] = np.packbits(bits, bitorder="little").view(np.int64)
    start = np.repeat([0, 64, 65, 200], [64, 1, 135, 100])
    bits = simhash.unpack(sig)
    want = {(i, j) for i in range(300) for j in range(start[i], i) if (bits[i] != bits[j]).sum() <= 42}
    got = [(int(a), int(b)) for p in simhash.close_pairs(sig, start) for a, b in zip(*p)]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_against_brute_force(docs):
    rows = []
    for i in range(60):
        t = text(120, i)
        rows += [(10 * i, t), (10 * i + 1, edited(t, 0.04, i)), (10 * i + 2, text(120, 1000 + i))]
    rows += [(900, None), (901, ""), (902, "..."), (903, text(120, 0)), (0, rows[0][1]), (None, rows[0][1])]
    found = simhash.near_duplicates(docs(rows)).collect()
    sig = {}
    for i, t in rows:
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t], pa.string())})
        for b in simhash.signatures([batch]):
            if i is not None:
                sig[i] = simhash.unpack(np.stack([b.column(c).to_numpy() for c in simhash.SIG], axis=1))[0]
    ids = sorted(sig)
    near = [(a, b) for a in ids for b in ids if a < b and (sig[a] != sig[b]).sum() <= simhash.RADIUS]
    group = {r.doc_id: r.group_id for r in found}
    assert sum(group.get(a, -1) == group.get(b, -2) for a, b in near) >= 0.9 * len(near) > 40
    assert all(group[a] <= a for a in group) and group[903] == 0
    assert {r.doc_id for r in found if r.kept} == set(group.values())
    assert not {900, 901, 902} & set(group) and not any(i % 10 == 2 for i in group if i < 900)
    # links are those of distinct signatures, each counted once
    rep = {}
    for i in ids:
        rep.setdefault(sig[i].tobytes(), i)
    assert all(r.class_id == rep[sig[r.doc_id].tobytes()] for r in found)
    want = {i: sum(a in rep.values() and b in rep.values() and i in (a, b) for a, b in near) for i in rep.values()}
    got = {r.class_id: r.links for r in found}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * sum(want.values()) > 40


def test_links_in_a_cluster(docs):
    """Texts with a few words of their own, and copies of them: links are counted, no pairs are returned."""
    base = text(400, 3).split()
    rows = [(i, " ".join([*base, f"own{i % 40}", f"word{i % 40}"])) for i in range(120)]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(rows)).collect()}
    sig = {}
    for b in simhash.signatures([pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})]):
        for i, row in zip(b.column("doc_id").to_pylist(), zip(*(b.column(c).to_pylist() for c in simhash.SIG))):
            sig[i] = row
    assert len(found) == 120 and {r.group_id for r in found.values()} == {0}
    assert len(set(sig.values())) > 5 and all(r.links == len(set(sig.values())) - 1 for r in found.values())


def test_no_pair_is_lost():
    """Signatures on both sides of the radius, within one block and between two: by bands and by comparing all."""
    g = np.random.default_rng(11)
    sig = g.integers(-(2**63), 2**63, (400, 4), dtype=np.int64)
    for i in range(200):
        bits = simhash.unpack(sig[i : i + 1])[0].copy()
        bits[g.choice(256, i % 10 + 36, replace=False)] ^= 1
        sig[200 + i] = np.packbits(bits, bitorder="little").view(np.int64)
    bits = simhash.unpack(sig)
    for cut in (0, 130, 200, 390):
        for radius in (0, 13, 42):
            want = {(i, j) for i in range(cut, 400) for j in range(cut or i) if (bits[i] != bits[j]).sum() <= radius}
            assert radius < 42 or cut == 390 or len(want) > 80
            for pairs in (simhash._banded(sig, cut, radius, simhash.layout(radius), most=50), simhash._all(sig, cut, radius, tile=64), simhash.pairs_between(sig, cut, radius)):
                got = [(int(a), int(b)) for p in pairs for a, b in zip(*p)]
                assert len(got) == len(set(got)) and set(got) == want


def test_pipeline_drops_all_within_the_radius(spark, docs, monkeypatch):
    """Texts about as far apart as the radius, in several blocks: all links are found and one text of each group stays."""
    monkeypatch.setattr(simhash, "SMALL_BLOCK", 100)
    rows = []
    for i in range(200):
        t = text(100, 5000 + i)
        rows += [(2 * i, t), (2 * i + 1, edited(t, 0.13, i))]
    ids, sig = [], []
    for b in simhash.signatures([pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})]):
        ids += b.column("doc_id").to_pylist()
        sig += list(simhash.unpack(np.stack([b.column(c).to_numpy() for c in simhash.SIG], axis=1)))
    near = [(a, b) for a in range(400) for b in range(a) if (sig[a] != sig[b]).sum() <= simhash.RADIUS]
    assert 100 < len(near) < 200 and sum((sig[a] != sig[b]).sum() > 36 for a, b in near) > 30 and len({x.tobytes() for x in sig}) == 400
    links = {}
    for p in near:
        for x in p:
            links[ids[x]] = links.get(ids[x], 0) + 1
    df = docs(rows)
    assert {r.doc_id: r.links for r in simhash.near_duplicates(df).collect()} == links
    group = {i: i for i, _ in rows}
    for a, b in sorted((ids[b], ids[a]) for a, b in near):
        group = {x: min(group[a], group[b]) if v in (group[a], group[b]) else v for x, v in group.items()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == set(group.values())


def test_even_split_and_long_text(docs):
    """A bit that half of the words set is 0; a text of a million words is read whole."""
    one, other = ("alpha",), ("alpha", "beta")
    bits = [simhash.unpack(np.stack([b.column(c).to_numpy() for c in simhash.SIG], axis=1))[0] for w in (one, ("beta",), other) for b in simhash.signatures([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(w)]})])]
    assert np.array_equal(bits[2], bits[0] & bits[1])
    t = text(3000, 8)
    long = " ".join([t] * 300)
    assert {(r.doc_id, r.group_id, r.kept) for r in simhash.near_duplicates(docs([(1, long), (2, t)])).collect()} == {(1, 1, True), (2, 1, False)}


def test_drop_near_duplicates(clashing):
    t = text(80, 5)
    df = clashing([(1, t), (2, t), (3, text(80, 6)), (4, None), (None, t), (5, "")])
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 3, 4, None, 5]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1), (7, 7)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_contaminated(docs, spark):
    item = "What is the Name of the river that flows through seven towns and ends up in the northern sea?"
    short = "Only five words in here."
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (4, "too short"), (5, ""), (None, text(20, 1)), (6, item)], "item_id long, text string")
    body = f"Élan… {item.upper()} and more"
    rows = [(1, body), (2, f"x{short}"), (3, f"so: only FIVE words, in here!"), (4, None), (5, ""), (6, text(200, 3)), (7, " ".join(item.split()[:12])), (1, body), (None, item)]
    got = {(r.doc_id, r.item_id): (r.start, r.end, r.n_windows) for r in decontam.contaminated(docs(rows), bench).collect()}
    at = body.index(item.upper())
    words = len(decontam.folded_words(item))
    assert got == {(1, 1): (at, at + len(item) - 1, words - 12), (1, 6): (at, at + len(item) - 1, words - 12), (3, 2): (4, len(rows[2][1]) - 1, 1)}
    assert {r.doc_id for r in decontam.decontaminate(docs(rows), bench).collect()} == {2, 4, 5, 6, 7, None}
    assert decontam.contaminated(docs(rows), bench.limit(0)).count() == 0 and decontam.contaminated(docs([]), bench).count() == 0


def test_short_answers(clashing, spark, tmp_path):
    """Items of any length are found, as the SQL finds them; only longer ones throw a document out."""
    from tests.conftest import compared

    bench = spark.createDataFrame([(1, "Yes"), (2, "the Blue Nile"), (3, "one two three four five six"), (4, "??"), (5, text(15, 2)), (6, "yes")], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    rows = [(1, "yes, yes: The blue Nile!"), (2, "the blue and the nile"), (3, "so one two THREE four five six"), (4, f"{text(15, 2)} yes"), (5, text(12, 2)), (6, "The Blue Nile"), (7, "word " * 300_000 + "yes")]
    d = clashing(rows)
    d.write.parquet(f"{tmp_path}/documents.parquet/p")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet/p")
    got = decontam.contaminated(d, bench)
    sql = decontam.ORACLE.replace("documents", f"'{tmp_path}/documents.parquet/p/*.parquet'").replace("benchmark", f"'{tmp_path}/benchmark.parquet/p/*.parquet'")
    ours, theirs = compared(got, sql, "/nowhere")
    assert ours == theirs and {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (1, 6), (1, 2), (3, 3), (4, 5), (4, 1), (4, 6), (6, 2), (7, 1), (7, 6)}
    kept = decontam.decontaminate(d, bench)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 6, 7}


def test_automaton_matches_scan(docs, spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    pats = [(p.strip().split(), ids) for p, _, ids in decontam.patterns([(r.item_id, r.text) for r in bench.collect()])]
    want = set()
    for r in d.collect():
        joined = f" {' '.join(decontam.folded_words(r.text))} "
        want |= {(r.doc_id, i) for p, ids in pats for i in ids if f" {' '.join(p)} " in joined}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, bench).collect()} == want


def test_chains_by_brute_force():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 9)
        runs = sorted((r.randint(0, 60), r.randint(0, 60), r.randint(3, 9)) for _ in range(n))
        at, of, size = (list(x) for x in zip(*runs))
        score = list(map(float, size))
        for j in range(n):
            for i in range(j):
                if at[i] + size[i] <= at[j] and of[i] + size[i] <= of[j]:
                    score[j] = max(score[j], size[j] + score[i] - passages.GAP * (at[j] - at[i] - size[i] + of[j] - of[i] - size[i]))
        found = passages.chains(at, of, size, size)
        assert sorted(x for c in found for x in c) == list(range(n))
        best = found[0]
        total = sum(size[x] for x in best) - passages.GAP * sum(at[b] - at[a] - size[a] + of[b] - of[a] - size[a] for a, b in zip(best, best[1:]))
        assert abs(total - max(score)) < 1e-9


def test_common_words():
    r = random.Random(8)
    for _ in range(200):
        a, b = (np.array([r.randint(0, 4) for _ in range(r.randint(0, 12))]) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert passages.common_words(a, b) == table[-1][-1]


def test_passages(clashing):
    p, q = text(60, 70), text(90, 71)
    fuzzy = edited(q, 0.06, 3)
    rows = [(1, f"{text(100, 72)} {p} {text(30, 73)}"), (2, f"{text(40, 74)} {p.upper()}. {text(50, 75)} {q}"), (3, f"{fuzzy} {text(80, 76)}"), (4, text(300, 77)), (5, None), (6, ""), (7, "a a"), (None, p), (2, f"{text(40, 74)} {p.upper()}. {text(50, 75)} {q}"), (8, f"{p} {text(10, 90)} {p}")]
    got = {(r.doc_id, r.of_doc_id): r for r in passages.repeated_passages(clashing(rows)).distinct().collect()}
    assert set(got) == {(2, 1), (3, 2), (8, 1)}
    assert (got[2, 1].first_word, got[2, 1].end_word, got[2, 1].of_first_word, got[2, 1].of_end_word, got[2, 1].identity) == (40, 100, 100, 160, 1.0)
    assert got[3, 2].end_word - got[3, 2].first_word >= 80 and got[3, 2].identity >= 0.88
    assert passages.repeated_passages(clashing(rows).limit(0)).count() == 0


def test_every_exact_repeat_has_a_seed():
    for seed in range(20):
        t = text(2 * passages.K - 1, seed)
        keys = []
        for around in (f"{text(30, seed + 50)} {t} {text(30, seed + 99)}", f"{text(7, seed + 150)} {t}"):
            key, _, _ = passages.seed_places(Words(*codepoints(pa.array([around]))))
            keys.append(set(key.tolist()))
        assert keys[0] & keys[1]


def _covered(found, doc):
    return {w for r in found if r.doc_id == doc for w in range(r.first_word, r.end_word)}


def test_passages_apart(docs):
    """Passages with unrelated text between them, on both sides or on one, that don't make one passage."""
    p, q, u, v, x = text(100, 200), text(100, 201), text(60, 202), text(60, 203), text(60, 204)
    rows = [(1, f"{p} {text(100, 210)} {q}"), (2, f"{p} {text(100, 211)} {q}"), (3, f"{u} {text(50, 212)} {v}"), (4, f"{u} {text(50, 213)} {v}")]
    rows += [(5, f"{x} {text(100, 214)} {text(60, 205)}"), (6, f"{x} {text(60, 205)}")]
    found = passages.repeated_passages(docs(rows)).collect()
    spans = lambda d: sorted((r.of_doc_id, r.first_word, r.end_word, r.of_first_word, r.of_end_word) for r in found if r.doc_id == d)
    assert spans(2) == [(1, 0, 100, 0, 100), (1, 200, 300, 200, 300)]
    assert spans(4) == [(3, 0, 60, 0, 60), (3, 110, 170, 110, 170)]
    assert spans(6) == [(5, 0, 60, 0, 60), (5, 60, 120, 160, 220)]
    assert len(found) == 6 and all(r.identity == 1 for r in found)


def test_parts_of_a_run():
    """A copy that goes on with few equal words on the same diagonal is found alone."""
    g = np.random.default_rng(5)
    a = g.integers(0, 1 << 30, 400).astype(np.int32)
    b = g.integers(0, 1 << 30, 400).astype(np.int32)
    b[50:110] = a[50:110]
    for i in range(126, 340, 24):
        b[i : i + 8] = a[i : i + 8]
    assert passages.passages_of(a, 0, b, 0, [50], [50], [292]) == [(50, 110, 50, 110, 60)]


def test_passage_twice_in_a_later_document(docs):
    """Every copy counts, also one of which a part is quoted before."""
    p, q, z = text(60, 220), text(150, 221), text(50, 222)
    rows = [(1, f"{text(30, 230)} {p} {text(30, 231)}"), (2, f"{p} {text(80, 232)} {p} {text(90, 233)} {p}"), (3, q), (4, f"{' '.join(q.split()[:60])} {text(70, 234)} {q}")]
    rows += [(5, f"{z} {text(70, 235)} {z}"), (6, f"{z} {text(70, 236)} {z} {text(70, 237)} {z}")]
    found = passages.repeated_passages(docs(rows)).collect()
    assert _covered(found, 2) == {*range(60), *range(140, 200), *range(290, 350)}
    assert _covered(found, 4) == {*range(60), *range(130, 280)}
    assert _covered(found, 6) == {*range(50), *range(120, 170), *range(240, 290)}
    assert {(r.doc_id, r.of_doc_id) for r in found} == {(2, 1), (4, 3), (6, 5)}
