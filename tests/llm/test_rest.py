import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, fingerprints, langid, packing, pfor, urlfilter
from sparkloom.llm.tokens import VOCABULARY, encoding
from tests.conftest import compared


def plain_leaders(rows):
    """(doc_id, n_chars, same_as, leader_id, lcp, tail_leader_id, lcs) of each row, by comparing all rows; doc_ids don't repeat with other texts."""
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    order = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, *[None] * 6))
            continue
        twins = [j for j, u in rows if u == t and j is not None]
        got = []
        for turn in (lambda x: x, lambda x: x[::-1]):
            shared = [(common(turn(t), turn(u)), j) for j, u in rows if u and order(j) < order(i)]
            level = max((k for c, _ in shared for k in range(12) if 4**k <= c), default=None)
            lead = None if level is None else min((order(j), j, c) for c, j in shared if c >= 4**level)
            got += [i, len(t)] if lead is None else [lead[1], lead[2]]
        out.append((i, len(t), min(twins, default=None), *got))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2, 5000])
def test_fingerprints(clashing, hot):
    head = "the same thirty-two characters here and "
    rows = [(5, head + "one"), (3, head + "other"), (9, head + "one"), (1, "é𐐷x"), (2, "é𐐷x"), (4, None), (6, ""), (7, ""), (None, head), (8, "x" * 300_000), (10, "y" + "x" * 200_000), (11, "not " + head + "one"), (12, "also not " + head + "one")]
    r = random.Random(5)
    pool = ["".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(6)]
    rows += [(100 + i, r.choice(pool)[: r.randint(0, 90)] + r.choice("ab") * r.randint(0, 3) + r.choice(pool)) for i in range(60)]
    show = lambda df: sorted(((r.doc_id, r.n_chars, r.same_as, r.leader_id, r.lcp, r.tail_leader_id, r.lcs) for r in df.collect()), key=repr)
    assert show(fingerprints.fingerprints(clashing(rows), hot=hot, kept=16)) == plain_leaders(rows)
    twice = fingerprints.fingerprints(clashing([*rows[:4], (5, head + "one"), (5, head + "two")]), hot=hot).where("doc_id = 5").collect()
    assert len(twice) == 3 and len({(r.fingerprint, r.leader_id, r.lcp) for r in twice}) == 2
    assert fingerprints.fingerprints(clashing([])).count() == 0


def test_spans_and_extensions():
    r = random.Random(1)
    codes = np.array([r.randint(0, 2) for _ in range(400)], np.uint32)
    p = fingerprints.Prefixes(codes)
    for _ in range(300):
        a, b = r.randint(0, 399), r.randint(0, 399)
        n = r.randint(0, 400 - max(a, b))
        assert bool(p.equal(np.array([a]), p, np.array([b]), np.array([n]))[0]) == (codes[a : a + n] == codes[b : b + n]).all()
        want = next((k for k in range(400 - max(a, b)) if codes[a + k] != codes[b + k]), 400 - max(a, b))
        assert p.extension(np.array([a]), np.array([400]), p, np.array([b]), np.array([400]))[0] == want


def test_language_accuracy_on_held_out(spark, sf):
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = langid.prototypes(d.where("doc_id % 2 = 0"), sample=64)
    assert model[0] == ["de", "en", "es", "fr"]
    rows = langid.identify(d.where("doc_id % 2 = 1"), model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in rows]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.99


def test_language_by_definition():
    texts = ["Hello, wörld again", "ab", "", None, "x1y 22 zz"]
    letters = langid.letter_vectors().astype(np.int64)
    vec, n = langid.document_vectors(*langid.codepoints(pa.array(texts)))
    for t, v, k in zip(texts, vec, n):
        s = re.sub(r"[\W\d]+", "\0", (t or "").lower()).lstrip("\0")
        want = np.zeros(langid.DIM)
        for a, b in zip(s, s[1:]):
            want += np.roll(letters[ord(a)], 1) * letters[ord(b)]
        for a, b, c in zip(s, s[1:], s[2:]):
            want += np.roll(letters[ord(a)], 2) * np.roll(letters[ord(b)], 1) * letters[ord(c)]
        assert k == max(0, len(s) - 1) + max(0, len(s) - 2) and np.array_equal(v, want)


def test_language_cases(clashing, docs):
    rows = [(i, "the quick brown fox jumps over the lazy dog and the cat " * 3) for i in range(5)] + [(10, None), (11, ""), (12, "12 34"), (13, "съешь же ещё этих мягких французских булок да выпей чаю"), (1, "the brown dog"), (None, "the lazy fox")]
    model = langid.prototypes(docs(rows[:5]))
    out = langid.identify(clashing(rows), model)
    got = {(r.doc_id, r.language, r.accepted) for r in out.collect()}
    assert {(10, None, False), (11, None, False), (12, None, False), (1, "en", True), (None, "en", True)} <= got and (13, "en", False) in got
    kept = langid.accepted(clashing(rows), model)
    assert kept.columns == clashing(rows).columns and kept.count() == 7
    assert langid.identify(docs([])).count() == 0
    assert not any(r.accepted or r.language for r in langid.identify(docs(rows), langid.Model([], np.zeros((0, langid.DIM), np.float32), *np.zeros((3, 64)))).collect())


def test_language_rejects_junk(spark, docs):
    """Both error rates: held-out labelled documents that are rejected, and junk in the same alphabet that is accepted."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.prototypes(d.where("doc_id % 2 = 0"))
    clean = d.where("doc_id % 20 = 1 AND length(text) >= 2")
    rejected = langid.identify(clean, model).where("NOT accepted").count() / clean.count()
    r = random.Random(7)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    foreign = "Kun tulin kotiin illalla huomasin että ovi oli auki ja valot päällä kaikissa huoneissa, minä ja ystäväni lähdimme metsään kävelemään. "
    code = 'for (int i = 0; i < n; i++) { if (x[i] != null) { printf("%d", x[i]->next); } } {"a": 1, "b": [2, 3]} <div class="x"></div> '
    random_text = lambda n: [letters(n) for _ in range(100)] + ["".join(r.choice("0123456789abcdef") for _ in range(n)) for _ in range(50)]
    others = [(foreign + code) * k for k in range(3, 8)] + [foreign * k for k in range(3, 8)] + [code * k for k in range(3, 8)]
    passed = [langid.identify(docs(list(enumerate(junk))), model).where("accepted").count() / len(junk) for junk in (random_text(600), random_text(2400), others)]
    assert rejected < 0.005 and passed[0] < 0.2 and passed[1] < 0.05 and passed[2] == 0, (rejected, passed)


def test_language_long_texts_ties_and_repeats(docs):
    words = "the quick brown fox jumps over the lazy dog and "
    model = langid.prototypes(docs([(i, words * 3) for i in range(4)]))
    rows = [(1, words * 40_000), (1, words), (1, words), (2, "a"), (3, "7 ! 7")]
    got = langid.identify(docs(rows), model).collect()
    assert len(got) == 5 and sum(r.accepted for r in got) == 3 and len({(r.cosine, r.margin) for r in got if r.cosine and r.cosine > 0.5}) == 2
    # a text in two languages has little margin, but is accepted
    two = langid.prototypes(docs([(i, words * 3) for i in range(4)]).union(docs([(i, "der schnelle braune Fuchs springt über den faulen Hund und " * 3) for i in range(4, 8)]).withColumn("lang", F.lit("de"))))
    mixed = langid.identify(docs([(1, (words + "der schnelle braune Fuchs springt über den faulen Hund und ") * 4)]), two).collect()[0]
    assert mixed.accepted and mixed.cosine > 0.6 and mixed.margin < 0.3
    both = langid.Model(["de", "en"], np.repeat(model.profiles, 2, axis=0), np.full(64, -1.0), np.full(64, -1.0), np.zeros(64))
    assert {(r.language, r.margin) for r in langid.identify(docs([(1, words)]), both).collect()} == {("de", 0.0)}


def plain_features(url):
    """The n-grams of one URL, one after another."""
    u = url.strip().lower()
    m = re.match(r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)(.*)$", u, re.S)
    out = set()
    for salt, part in enumerate((m[1].removeprefix("www."), m[2])):
        data = f"^{part}$".encode()
        for n in urlfilter.SIZES:
            for i in range(len(data) - n + 1):
                h = (1469598103934665603 + 2 * n + salt) % 2**64
                for c in data[i : i + n]:
                    h = (h ^ c) * 1099511628211 % 2**64
                out.add(((h ^ h >> 29) % 2 ** (urlfilter.BITS - 1)) + salt * 2 ** (urlfilter.BITS - 1))
    return out


def plain_training(rows):
    """Weights by place (-1 is the bias), by loops over rows and places."""
    found = [plain_features(u) for u, _ in rows]
    half = 2 ** (urlfilter.BITS - 1)
    value = [{p: 1 / math.sqrt(sum((q < half) == (p < half) for q in f)) for p in f} for f in found]
    w, step, n = {-1: 0.0}, {}, [sum(y == k for _, y in rows) for k in (0, 1)]
    for _ in range(urlfilter.STEPS):
        grad = {p: urlfilter.DECAY * x for p, x in w.items() if p >= 0}
        for v, (_, y) in zip(value, rows):
            error = 0.5 / n[y] * (1 / (1 + math.exp(-(w[-1] + sum(w.get(p, 0.0) * x for p, x in v.items())))) - y)
            grad[-1] = grad.get(-1, 0.0) + error
            for p, x in v.items():
                grad[p] = grad.get(p, 0.0) + error * x
        step = {p: 0.9 * step.get(p, 0.0) - urlfilter.RATE * g for p, g in grad.items()}
        for p, x in step.items():
            w[p] = w.get(p, 0.0) + x
    return w


def test_url_training_by_plain_loop():
    rows = urlfilter.labelled_urls()[::97]
    assert {y for _, y in rows} == {0, 1}
    for u, _ in [*rows, ("HTTP://WWW.Ünïcode.example/Ä?q", 0), ("", 0), ("www.x", 0)]:
        row, place = urlfilter.features(pa.array(["x", u, None]))
        assert set(place[row == 1].tolist()) == plain_features(u) and not (row == 2).any()
    w, want = urlfilter.train(rows), plain_training(rows)
    assert all(math.isclose(w[p], x, rel_tol=1e-6, abs_tol=1e-9) for p, x in want.items()) and np.count_nonzero(w) == len(want)


def test_url_filter_on_words_it_has_not_seen(spark):
    """The bad hosts of the test pages: none of their words is a word of the training table."""
    bad = ("casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x")
    known = {w for u, _ in urlfilter.labelled_urls() for w in re.split(r"[^a-z0-9]+", u.lower())}
    assert not known & {w for b in bad for w in b.split("-")}
    got = urlfilter.scored(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()
    caught = sum(r.bad for r in got if any(b in r.url for b in bad))
    false = sum(r.bad for r in got if not any(b in r.url for b in bad))
    assert caught >= 0.9 * sum(any(b in r.url for b in bad) for r in got) > 100 and false <= 0.01 * len(got)


def test_url_filter(spark):
    rows = urlfilter.labelled_urls()
    host = lambda u: u.split("/")[2]
    out = set(random.Random(2).sample(sorted({host(u) for u, _ in rows}), 70))
    w = urlfilter.train([r for r in rows if host(r[0]) not in out])
    held = [(u, y) for u, y in rows if host(u) in out]
    assert np.mean((urlfilter.probabilities(pa.array([u for u, _ in held]), w) > 0.5) == np.array([bool(y) for _, y in held])) > 0.95
    long = "https://garden.org/" + "a-long-path/" * 100_000
    pages = spark.createDataFrame([(1, "http://www.casino-win.example.com/en/1", "x"), (2, None, None), (3, "", "x"), (None, "https://garden.example.org/about", "x"), (1, "http://www.casino-win.example.com/en/1", "y"), (5, long, "z")], "page_id long, url string, p_bad string")
    pages = pages.withColumn("row", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("bad", F.lit(1))
    full = urlfilter.train(rows).astype(np.float32)
    got = urlfilter.scored(pages).collect()
    assert sorted((str(r.page_id), r.bad) for r in got if r.url != "") == [("1", True), ("1", True), ("2", False), ("5", False), ("None", False)] and len(got) == 6
    assert all(r.p_bad is None if r.url is None else math.isclose(r.p_bad, urlfilter.probabilities(pa.array([r.url]), full)[0]) for r in got)
    assert urlfilter.scored(pages.limit(0)).count() == 0
    assert {r.p_bad for r in urlfilter.scored(pages, []).collect()} == {None, 0.5}


def plain_chat(rows):
    """conv_id -> (prompt, turns, parts, tokens, attachments), one part after another."""
    count = lambda t: len(re.findall(r"[^\W_]+|[^\w\s]|_", t))
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "unknown")):
        try:
            parts = json.loads(text) if text and text.lstrip().startswith("[") else None
            assert parts and all(isinstance(p, dict) and p.get("type") for p in parts)
        except (ValueError, AssertionError):
            parts = [{"type": "text", "text": text or ""}]
        prompt, n, k, tokens, att = out.setdefault(conv, ["", 0, 0, 0, []])
        shown = ""
        for i, p in enumerate(parts):
            if p["type"] == "text":
                shown += p.get("text") or ""
                tokens += count(p.get("text") or "")
                continue
            kind = p["type"] if p["type"] in ("image", "audio", "document") else "other"
            size = {"image": 85 + 170 * math.ceil((p.get("width") or 1) / 512) * math.ceil((p.get("height") or 1) / 512), "audio": math.ceil(25 * (p.get("seconds") or 1)), "document": math.ceil(500 * (p.get("pages") or 1)), "other": 0}[kind]
            shown += f"<|{kind}:{turn}.{i}|>"
            tokens += size
            att = [*att, f"{kind} {turn}.{i} {p.get('url') or '-'} {size}"]
        out[conv] = [f"{prompt}<|{role or 'unknown'}|>\n{shown}<|end|>\n", n + 1, k + len(parts), tokens, att]
    return {c: (v[0], v[1], v[2], v[3], "\n".join(v[4])) for c, v in out.items()}


def test_chat(spark):
    j = json.dumps
    rows = [
        (1, 0, "user", j([{"type": "text", "text": "Look: "}, {"type": "image", "url": "a.png", "width": 1000, "height": 600}, {"type": "text", "text": " and"}, {"type": "audio", "url": "b.wav", "seconds": 2.5}])),
        (1, 1, "assistant", "Plain, with [brackets]."), (2, 0, None, j([{"type": "document", "url": "c.pdf", "pages": 3}, {"type": "video", "url": "d"}, {"type": "image"}])),
        (2, 1, "user", "[not json"), (2, 2, "user", None), (3, 0, "user", ""), (3, 1, "user", "[]"), (3, 2, "user", "word " * 20000), (3, 2, "user", "word " * 20000), (4, 0, "user", "[1, 2]"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tokens string")
    got = {r.conv_id: (r.prompt, r.n_turns, r.n_parts, r.n_tokens, r.attachments) for r in chat.formatted(df).collect()}
    assert got == plain_chat(rows)
    assert chat.formatted(df.limit(0)).count() == 0
    assert chat.formatted(spark.createDataFrame([(None, None, None, None)], df.schema.simpleString()[7:-1].replace(":", " ").rsplit(",", 1)[0].replace(",", ", ").replace("bigint", "long"))).first().prompt == "<|unknown|>\n<|end|>\n"


def reduced_by_hand(items, capacity):
    """Martello and Toth's sets, one piece at a time; then best fit. Returns fixed sets and other bins."""
    left, fixed = sorted(items, reverse=True), []
    for j in sorted(set(items), reverse=True):
        while j in left:
            rest = list(left)
            rest.remove(j)
            room, fit, used = capacity - j, 0, 0
            for x in sorted(rest):
                if used + x > room:
                    break
                used, fit = used + x, fit + 1
            f = [j] if not fit else None
            if fit:
                star = max(x for x in rest if x <= room)
                if fit == 1 or star == room:
                    f = [j, star]
                elif fit == 2:
                    _, a, b = max((rest[p] + rest[q], rest[p], rest[q]) for p in range(len(rest)) for q in range(p + 1, len(rest)) if rest[p] + rest[q] <= room)
                    if star >= a + b:
                        f = [j, star]
                    elif star == a:
                        first = rest.index(a)
                        between = rest[first + 1 : rest.index(b, first + 1)]
                        if len(between) < 2 or between[-1] + between[-2] > room:
                            f = [j, a, b]
            if f is None:
                break
            for x in f:
                left.remove(x)
            fixed.append(f)
    bins = []
    for x in left:
        open_ = [b for b in bins if sum(b) + x <= capacity]
        if open_:
            max(open_, key=sum).append(x)
        else:
            bins.append([x])
    return fixed, bins


def test_plan_against_pieces_one_by_one():
    r = random.Random(6)
    for _ in range(400):
        capacity = r.choice([10, 20, 50, 100])
        items = [r.randint(r.choice([1, capacity // 4]), capacity) for _ in range(r.randint(1, 22))]
        runs, fixed, bins = packing.plan({x: items.count(x) for x in items}, capacity)
        place = {}
        for size, a, b, each, first, start in runs:
            for k in range(a, b):
                place[size, k] = (first + (k - a) // each, start + (k - a) % each * size)
        assert len(place) == len(items)
        loads = {}
        for (size, _), (b, at) in place.items():
            loads.setdefault(b, []).append((at, size))
        for b in loads.values():
            at = 0
            for start, size in sorted(b):
                assert start == at
                at += size
            assert at <= capacity
        want, other = reduced_by_hand(items, capacity)
        assert (fixed, len(loads)) == (len(want), bins) == (len(want), len(want) + len(other))
        assert sorted(sum(s for _, s in b) for b in loads.values()) == sorted(map(sum, [*want, *other]))


def test_reduction_keeps_an_optimum():
    def least(items, capacity):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    r = random.Random(7)
    for _ in range(60):
        items = sorted((r.randint(3, 20) for _ in range(8)), reverse=True)
        fixed, bins = reduced_by_hand(items, 20)
        rest = sorted((x for b in bins for x in b), reverse=True)
        assert len(fixed) + least(rest, 20) == least(items, 20)


def test_pack(clashing):
    rows = [(i, "word " * random.Random(i).randint(0, 900)) for i in range(60)] + [(100, None), (101, ""), (102, "long text " * 3000), (None, "a b"), (None, "a b"), (7, "again"), (7, "again")]
    out = packing.pack(clashing(rows), capacity=512).collect()
    encode = encoding().encode_ordinary
    want = {}
    for i, t in rows:
        if t:
            want[i] = want.get(i, 0) + len(encode(t)) + 1
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == want
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append((r.bin_start, r.n_tokens))
    for b in bins.values():
        at = 0
        for start, n in sorted(b):
            assert start == at
            at += n
        assert at <= 512
    assert sorted(bins) == list(range(len(bins)))
    assert packing.pack(clashing([])).count() == 0


def test_ranks_whatever_the_parts(docs):
    """Ranks in a class go by doc_id, piece and tie, for any number of parts."""
    rows = [(i // 2 if i % 9 else None, "word " * random.Random(i % 40).randint(0, 700)) for i in range(300)]
    cut = packing.stored(packing.pieces(docs(rows), 256), "pieces")
    want = {}
    for r in sorted(cut.collect(), key=lambda r: (r.n_tokens, r.doc_id is not None, r.doc_id or 0, r.piece, r.tie)):
        want.setdefault(r.n_tokens, []).append((r.doc_id, r.piece, r.tie))
    for part_rows in (5, 60, 1_000_000):
        got = {}
        for r in sorted(packing.ranked(cut, part_rows).collect(), key=lambda r: (r.n_tokens, r.rank)):
            assert r.rank == len(got.setdefault(r.n_tokens, []))
            got[r.n_tokens].append((r.doc_id, r.piece, r.tie))
        assert got == want


def test_pack_against_the_plan_piece_by_piece(spark, sf):
    """The whole table: the query is the plan's runs dealt out one by one to the sorted pieces."""
    cut = packing.pieces(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    by_size = {}
    for r in sorted(cut, key=lambda r: (r.n_tokens, r.doc_id, r.piece)):
        by_size.setdefault(r.n_tokens, []).append((r.doc_id, r.piece))
    want = {}
    for size, low, high, each, first, place in packing.plan({k: len(v) for k, v in by_size.items()}, packing.CAPACITY)[0]:
        for k, piece in enumerate(by_size[size][low:high]):
            want[piece] = first + k // each, place + k % each * size
    got = {(r.doc_id, r.piece): (r.bin_id, r.bin_start) for r in packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32])
def test_blocks_round_trip(top):
    r = np.random.default_rng(top)
    for kind in range(6):
        counts = r.integers(0, 400, 5) if kind % 2 else np.array([0, 1, 127, 128, 129])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        ids = r.integers(0, top, offsets[-1]).astype(np.uint32)
        if kind > 2:
            ids = np.where(r.random(len(ids)) < 0.92, ids % 5, ids).astype(np.uint32)
        data, ends, starts, blocks = pfor.encode(ids, offsets)
        for k in range(5):
            payload, s = data[ends[k] : ends[k + 1]].tobytes(), starts[blocks[k] : blocks[k + 1]]
            want = ids[offsets[k] : offsets[k + 1]]
            assert np.array_equal(pfor.decode(payload, int(counts[k]), s), want)
            for b in range(len(s)):
                assert np.array_equal(pfor.decode_block(payload, int(s[b]), min(128, int(counts[k]) - 128 * b)), want[128 * b : 128 * b + 128])


def test_encoded(clashing):
    rows = [(1, "Hello there, this is a text. " * 40), (2, None), (3, ""), (None, "x"), (1, "again"), (4, "long " * 40_000)]
    encode = encoding(VOCABULARY).encode_ordinary
    got = pfor.encoded(clashing(rows)).collect()
    back = sorted((str(r.doc_id), pfor.decode(bytes(r.payload), r.n_tokens, r.block_starts).tolist()) for r in got)
    assert back == sorted((str(i), encode(t) if t else []) for i, t in rows)
    assert pfor.encoded(clashing([])).count() == 0


def test_shared_folder():
    from types import SimpleNamespace

    from sparkloom.llm.common import base_folder

    session = lambda master, folder: SimpleNamespace(conf={"spark.checkpoint.dir": folder} if folder else {}, sparkContext=SimpleNamespace(master=master))
    assert base_folder(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y" and base_folder(session("local[8]", None))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            base_folder(session(master, None))


@pytest.mark.parametrize("name", ["op2_fingerprints", "op5_chat_format", "op9_decontamination", "op10_line_dedup"])
def test_oracle(spark, sf, name):
    from sparkloom.llm import queries

    ours, theirs = compared(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)
    assert ours == theirs and ours
