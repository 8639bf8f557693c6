"""Steps whose cost or memory once outgrew their input: right results on odd cases, and the plan that keeps them small."""

import random

import pytest

from sparkloom.operators import communities, history
from sparkloom.plans.catalog import from_tables
from sparkloom.plans.schema import struct


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blame_runs_without_a_hash_table(spark):
    lines = [(1, 1, "c1", "a"), (1, 2, "c1", "a"), (1, 3, "c2", "a"), (1, 4, "c1", "a"), (1, 6, "c1", "a"), (1, 7, "c1", "a"), (1, 8, "c1", "a"), (1, 9, "c1", "b"), (2, 1, "c1", "b"), (2, 2, None, None), (2, 3, None, None)]
    b = spark.createDataFrame([(f, n, c, a, 0) for f, n, c, a in lines], struct("blame_lines")).repartition(3)
    runs = history.blame_runs(from_tables(spark, {"blame_lines": b}))
    want = [(1, "a", "c1", 1, 2), (1, "a", "c1", 4, 4), (1, "a", "c1", 6, 8), (1, "a", "c2", 3, 3), (1, "b", "c1", 9, 9), (2, "b", "c1", 1, 1), (2, None, None, 2, 3)]
    assert sorted(map(tuple, runs.collect()), key=str) == sorted(want, key=str)
    assert "Aggregate" not in plan(runs)


def naive(parents, node, path=()):
    """C3 by definition: every way up is worked out anew."""
    if node in path:
        return None
    above = [naive(parents, p, (*path, node)) for p in parents.get(node, [])]
    if None in above:
        return None
    lists, out = [[p, *a] for p, a in zip(parents.get(node, []), above, strict=True)] + [list(parents.get(node, []))], []
    while lists := [x for x in lists if x]:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:
            return None
        out.append(head)
        lists = [x[1:] if x[0] == head else x for x in lists]
    return out


def test_c3_of_many_classes(spark):
    draw = random.Random(7)
    edges = [(base + draw.randrange(12), base + draw.randrange(12)) for base in range(0, 1200, 12) for _ in range(draw.randrange(4, 20))]
    h = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "id long, child_symbol_id long, parent_symbol_id long").repartition(5)
    parents = {}
    for a, b in edges:
        parents.setdefault(a, {})[b] = None
    df = communities.c3(h, 12)
    want = {a: None if (o := naive(parents, a)) is None else ",".join(map(str, o)) for a in parents}
    assert {r.class_id: r.order for r in df.collect()} == want
    assert any(o is None for o in want.values()) and any(o and o.count(",") > 2 for o in want.values())
    assert "FlatMapGroups" not in plan(df)


def test_c3_of_stacked_diamonds(spark):
    """Each of 18 floors doubles the ways up, 2 ** 18 of them; an ancestor is worked out once."""
    rows = [x for i in range(18) for x in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))]
    parents, asked = {}, []

    class Told(dict):
        def get(self, k, d=None):
            asked.append(k)
            return super().get(k, d)

    for a, b in rows:
        parents.setdefault(a, []).append(b)
    assert communities.linearise(Told(parents), 0) == list(range(1, 55)) and len(asked) == 55


def propagated(calls, rounds, min_size):
    """Label propagation by definition, every round."""
    w = {}
    for a, b, c in calls:
        for u, v in ((a, b), (b, a)):
            w.setdefault(u, {})[v] = w.setdefault(u, {}).get(v, 0) + c
    best = lambda votes: min(votes, key=lambda k: (-round(votes[k], 6), k))
    label = {u: u for u in w}
    for _ in range(rounds):
        new = {}
        for u, near in w.items():
            votes = {}
            for v, c in near.items():
                votes[label[v]] = votes.get(label[v], 0) + c
            new[u] = best(votes)
        label = new
    size = {c: list(label.values()).count(c) for c in label.values()}
    pull = {}
    for u, near in w.items():
        for v, c in near.items():
            if size[label[u]] < min_size <= size[label[v]]:
                to = pull.setdefault(label[u], {})
                to[label[v]] = to.get(label[v], 0) + c
    return {u: best(pull[c]) if c in pull else c for u, c in label.items()}


def graph(spark, calls):
    nodes = sorted({x for e in calls for x in e[:2]})
    symbols = spark.createDataFrame([(n, 1, f"s{n}", f"m.s{n}", "Function", n, 0, n % 2 == 0, None, None) for n in nodes], struct("symbols"))
    edges = spark.createDataFrame([(i, a, b, "CALLS", float(c), 1, 1) for i, (a, b, c) in enumerate(calls)], struct("edges"))
    return from_tables(spark, {"symbols": symbols, "edges": edges})


@pytest.mark.parametrize("rounds", [0, 1, 2, 3, 4, 9, 10, 20])
def test_communities_after_every_number_of_rounds(spark, rounds):
    draw = random.Random(rounds)
    calls = [(a, b, draw.choice((0.25, 0.5, 1))) for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(70)) if a != b]
    calls += [(100, 101, 1), (110, 111, 1), (111, 112, 1), *((200 + i, 201 + i, 1) for i in range(30))]  # pairs and stars swap for ever, the path takes long
    got = communities.communities(graph(spark, calls), rounds)
    assert {r.id: r.community for r in got.collect()} == propagated(calls, rounds, 3)


def test_rounds_end_when_labels_swap(spark, monkeypatch):
    written = []
    monkeypatch.setattr(communities, "checkpoint", lambda df, keep=communities.checkpoint: written.append(df.columns) or keep(df))
    cat = graph(spark, [(1, 2, 1), (5, 6, 1), (6, 7, 1)])
    label = communities.communities(cat)
    assert {r.id: r.community for r in label.collect()} == propagated([(1, 2, 1), (5, 6, 1), (6, 7, 1)], 20, 3)
    assert len(written) <= 5  # edges, both ways, two blocks and the result
    for df in (communities.community_graph(cat, label), communities.community_details(cat, label)):
        df.collect()
        assert "edge_kind" not in plan(df)
    assert len(written) <= 5
