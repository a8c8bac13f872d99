"""Operators against brute force, exact round trips or held-out accuracy."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from helpers import table, words

from millrace.llm import audio, common, fixity, langid, mixing, nbsvm, sharding, simhash, toxicity, winnowing
from millrace.llm import textcore as tc


def edited(rng, w, share):
    out = []
    for x in w:
        u = rng.random()
        out += [x] if u > share else [] if u < share / 3 else [words(rng, 1)[0]] if u < 2 * share / 3 else [x, words(rng, 1)[0]]
    return out


# SimHash


def near_corpus(seed=1, n=300):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(3, 200)) for _ in range(n)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(0, n, 5):
        for _ in range(rng.randrange(4)):
            rows.append((len(rows), " ".join(edited(rng, base[i], rng.choice((0, 0.02, 0.06))))))
    return rows


@pytest.mark.parametrize("radius,slack", [(simhash.RADIUS, simhash.SLACK), (95, 3), (120, 400)])
def test_simhash_pairs_equal_brute_force(spark, radius, slack, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_POINTS", 50)  # several tiles in a shard
    rows = near_corpus()
    docs = table(spark, rows)
    p = simhash.fingerprints(docs).toPandas()
    f = [p[c].to_numpy().view(np.uint64) for c in simhash.PRINT]
    want = set()
    for i in range(len(p)):
        d = sum(np.bitwise_count(x[i] ^ x).astype(int) for x in f)
        for j in np.flatnonzero((d <= radius) & (np.abs(p.code - p.code[i]) <= slack)):
            a, b = int(p.doc_id[i]), int(p.doc_id[j])
            if a < b:
                want.add((a, b, int(d[j])))
    # equal fingerprints are given once each, by their least id, and stand for each other
    least = p.groupby(list(simhash.KEY)).doc_id.transform("min")
    rep = dict(zip(p.doc_id, least))
    got = [tuple(r) for r in simhash.pairs(docs, radius, slack).collect()]
    assert len(got) == len(set(got))
    assert {x for x in got if x[2] or rep[x[0]] != rep[x[1]]} == {(min(rep[a], rep[b]), max(rep[a], rep[b]), d) for a, b, d in want if rep[a] != rep[b]}
    assert {x for x in got if rep[x[0]] == rep[x[1]]} == {(rep[b], b, 0) for b in rep if rep[b] != b}


def test_simhash_groups_are_components(spark):
    rows = near_corpus(2)
    pairs = [(r["a"], r["b"]) for r in simhash.pairs(table(spark, rows)).collect()]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    size = Counter(find(i) for i in root)
    prints = {r["doc_id"]: tuple(r[c] for c in simhash.KEY) for r in simhash.fingerprints(table(spark, rows)).collect()}
    different = {p: np.array(p[: simhash.WORDS], np.int64).view(np.uint64) for p in set(prints.values())}
    links = {p: sum(q != p and int(np.bitwise_count(f ^ g).sum()) <= simhash.RADIUS for q, g in different.items()) for p, f in different.items()}
    want = {(i, find(i), find(i) == i, links[prints[i]]) for i in root if size[find(i)] > 1}
    got = simhash.groups(table(spark, rows)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    kept = {r["doc_id"] for r in simhash.deduplicate(table(spark, rows)).collect()}
    assert kept == {find(i) for i in root}


@pytest.mark.parametrize("radius,slack", [(simhash.RADIUS, simhash.SLACK), (30, 4), (70, simhash.SLACK)])
def test_simhash_bands_give_each_pair_once(radius, slack):
    """The lookups of all bands together, also where values of a band are held by many, against brute force."""
    rng = np.random.default_rng(5)
    n = 2400
    f = rng.integers(0, 1 << 64, (simhash.WORDS, n), dtype=np.uint64)
    f[0, : n // 3] = f[0, 0] ^ (rng.integers(0, 1 << 64, n // 3, dtype=np.uint64) & np.uint64(0x8000400020001))  # crowded bands
    few = [np.uint64(1) << rng.integers(0, 64, (simhash.WORDS, 500), dtype=np.uint64) for _ in range(14)]
    f[:, 500:1000] = f[:, :500]
    f[:, -500:] = f[:, 200:700]
    for k, x in enumerate(few):
        f[:, 500:1000] ^= x * (rng.random(500) < k / 10)
        f[:, -500:] ^= x * (rng.random(500) < 0.6)
    points = f, rng.integers(0, 9, n)
    d = simhash.hamming(f[:, :, None], f[:, None, :]).astype(int)
    near = (d <= radius) & (np.abs(points[1][:, None] - points[1]) <= slack)
    want = sorted((i, j, d[i, j]) for i, j in zip(*np.nonzero(np.triu(near, 1))))
    half = n // 2
    parts = (points[0][:, :half], points[1][:half]), (points[0][:, half:], points[1][half:])
    across = sorted((i, j, d[i, half + j]) for i, j in zip(*np.nonzero(near[:half, half:])))
    assert len(want) > 150 and len(across) > 40
    bands = range(len(simhash._bands(radius)[0]) - 1)
    for q, h, pairs in ((points, None, want), (*parts, across)):
        got = [(*((i, j) if h else (min(i, j), max(i, j))), x) for b in bands for part in simhash._near(q, h, radius, slack, b) for i, j, x in zip(*part)]
        assert sorted(got) == pairs


def test_simhash_search_is_cheap():
    """A band's search over 400,000 fingerprints, by the time that numpy takes here to look up as many values: about 5 to 8 times that; the search before took 15 to 22."""
    n, reach, bits = 400_000, 3, 20
    points = np.random.default_rng(6).integers(0, 1 << 64, (simhash.WORDS, n), dtype=np.uint64), np.zeros(n, np.int64)
    values, counts = np.sort((points[0][0] >> np.uint64(64 - bits)).astype(np.int64)), np.zeros(1 << bits, np.int64)

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    def unit():
        for at in range(0, n, 1 << 14):
            for mask in range(100):
                counts.take(values[at : at + (1 << 14)] ^ (mask << 9))

    took = min(seconds(lambda: list(simhash._near(points, None, simhash.RADIUS, simhash.SLACK, 1))) for _ in range(2))
    masks = sum(math.comb(bits, k) for k in range(reach + 1)) / 2
    assert took < 11 * masks / 100 * min(seconds(unit) for _ in range(3))


def test_simhash_tasks_get_whole_tiles(spark, monkeypatch):
    """With T tiles a fingerprint is sent T + 1 times, once bands needn't be spread over tasks; nothing changes in what is found."""
    docs = table(spark, near_corpus(3, 500))
    distinct = simhash._distinct(simhash.fingerprints(docs))
    n = distinct.count()
    want = sorted(map(tuple, simhash.groups(docs).collect()))
    for points in (n, n // 4, n // 12):
        monkeypatch.setattr(simhash, "TILE_POINTS", points)
        monkeypatch.setattr(simhash, "TASKS_A_CORE", 0)
        tiles = -(-n // points)
        assert simhash._sharded(distinct, simhash.RADIUS, simhash.SLACK).count() <= n * (tiles + 1)
        assert sorted(map(tuple, simhash.groups(docs).collect())) == want


def test_repeated_rows_leave_one(spark):
    rng = random.Random(17)
    a, b, c, d = (" ".join(words(rng, 80)) for _ in range(4))
    near = b + " " + words(rng, 1)[0]
    rows = [(1, a), (1, a), (1, a), (7, a), (7, b), (2, near), (9, b), (None, c), (None, c), (None, d), (5, d), (None, None), (None, None), (3, ""), (3, ""), (9, "!")]
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in simhash.deduplicate(table(spark, rows)).collect())))
    # of a: id 1 once; of b and near: id 2; of c: one without an id; of d: id 5; rows without a word all stay
    assert kept == sorted(map(str, [(1, a), (2, near), (None, c), (5, d), (None, None), (None, None), (3, ""), (3, ""), (9, "!")]))
    got = {tuple(r)[:3] for r in simhash.groups(table(spark, rows)).collect()}
    assert got == {(1, 1, True), (7, 1, False), (7, 2, False), (2, 2, True), (9, 2, False)}
    # a text under two ids whose groups are named apart keeps a copy of each
    rows = [(7, a), (9, a), (11, a), (7, b), (2, b)]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(table(spark, rows)).collect()) == sorted([(7, a), (2, b)])


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    names = rng.sample(range(10_000), 300)
    edges = [(names[i], names[i + 1]) for i in range(149)] + [(names[150], names[i]) for i in range(151, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    a, b = min(names[:150]), min(names[150:])
    assert got == {x: a for x in names[:150] if x != a} | {x: b for x in names[150:] if x != b}


def test_simhash_bits_are_majorities():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 1 << 63, 70_000, dtype=np.uint64) * np.uint64(2)
    row = np.sort(rng.integers(0, 3, len(f)) * 2)
    words_ = simhash._simhash(f, row, 6)
    for r in range(6):
        for x, g in zip(words_, simhash._bits_of(f)):
            mine = g[row == r]
            bits = (mine[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            want = sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(mine)) if len(mine) else 0
            assert int(x[r]) == want


def test_near_copies_pair_and_others_do_not():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(60, 400)) for _ in range(150)]
    copies = [edited(rng, w, 0.05) for w in base]
    f, _ = simhash.fingerprint(pa.array([" ".join(w) for w in base + copies]))
    d = simhash.hamming(f[:, :, None], f[:, None, :])
    n = len(base)
    assert np.mean(d[np.arange(n), np.arange(n) + n] <= simhash.RADIUS) > 0.97
    assert (d[:n, :n][np.triu_indices(n, 1)] > simhash.RADIUS).all()


def test_near_copies_pair_whatever_their_length(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 60))) for i in range(1200)]
    rows += [(2000 + i, f"{rows[i][1]} {rows[i][1]}") for i in range(20)]  # the same distinct words, twice as long
    rows += [(3000 + i, " ".join(words(rng, 12))) for i in range(40)]
    rows += [(4000 + i, f"{rows[1220 + i][1]} {words(rng, 1)[0]}") for i in range(40)]  # a word more makes 8 %
    p = simhash.fingerprints(table(spark, rows)).toPandas()
    f = np.stack([p[c].to_numpy().view(np.uint64) for c in simhash.PRINT])
    d = simhash.hamming(f[:, :, None], f[:, None, :])
    want = {(min(a, b), max(a, b)) for i, j in zip(*np.nonzero(d <= 51)) if i != j for a, b in [(int(p.doc_id[i]), int(p.doc_id[j]))]}
    assert {(i, 2000 + i) for i in range(20)} <= want and sum((3000 + i, 4000 + i) in want for i in range(40)) > 10
    assert {(r["a"], r["b"]) for r in simhash.pairs(table(spark, rows)).collect()} == want


# winnowing


def spans(doc, item, least):
    """Maximal common spans of at least `least` words."""
    out = set()
    for i in range(len(doc)):
        for j in range(len(item)):
            if doc[i] == item[j] and (not i or not j or doc[i - 1] != item[j - 1]):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, n))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_winnowing_finds_every_span(spark, limit):
    rng = random.Random(3)
    few = [f"t{i}" for i in range(4)]  # a small vocabulary makes ties and short repeats
    items = [[rng.choice(few) for _ in range(rng.randrange(2, 25))] for _ in range(8)] + [words(rng, 40)]
    docs = []
    for i in range(40):
        w = [rng.choice(few) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            it = rng.choice(items)
            a = rng.randrange(len(it))
            w[rng.randrange(len(w) + 1) : 0] = it[a : a + rng.randrange(1, 30)]
        docs.append(w)
    d = table(spark, [(i, ", ".join(w).upper()) for i, w in enumerate(docs)] + [(None, " ".join(items[-1])), (7, " ".join(docs[7]))])
    bm = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    want = Counter()
    for key, w in [*enumerate(docs), (None, items[-1]), (7, docs[7])]:
        for j, it in enumerate(items):
            for a, b, n in spans(w, it, min(6, max(3, len(it)))):
                want[(key, j, a, b, n, len(it))] += 1
    got = Counter(tuple(r) for r in winnowing.contamination(d, bm, k=3, w=4, broadcast_bytes=limit).collect())
    assert got == want
    bad = {k[0] for k in want}
    kept = sorted(str(r["doc_id"]) for r in winnowing.decontaminate(d, bm, k=3, w=4, broadcast_bytes=limit).collect())
    assert kept == sorted(str(i) for i in [*range(40), None, 7] if i not in bad)


def test_winnowing_of_repetitive_text():
    """Texts of a few lines repeated: the same spans as by brute force."""
    rng = random.Random(31)
    for trial in range(12):
        period = rng.choice((1, 2, 3, 7, 9, 25))
        line = words(rng, period)
        doc, item = line * (90 // period), line * (60 // period)
        if trial % 3:
            doc.insert(rng.randrange(len(doc)), "odd"), item.insert(rng.randrange(len(item)), "odd")
        index = winnowing.Index(pa.array([" ".join(item)], type=pa.large_string()), 8, 6)
        got = winnowing.matches(pa.array([" ".join(doc)], type=pa.large_string()), index, 8, 6)
        assert set(zip(*(x.tolist() for x in got[2:]))) == spans(doc, item, 13)


def test_winnowing_of_one_word_repeated():
    """100,000 equal words against an item of 10,000: one span on each of their 109,975 diagonals long enough."""
    began = time.perf_counter()
    index = winnowing.Index(pa.array(["w " * 10_000], type=pa.large_string()), 8, 6)
    r, s, a, b, n = winnowing.matches(pa.array(["w " * 100_000], type=pa.large_string()), index, 8, 6)
    assert time.perf_counter() - began < 10
    want = {(max(0, d), max(0, -d)): min(100_000 - max(0, d), 10_000 - max(0, -d)) for d in range(-9987, 99_988)}
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want


# mixing


def fill(sizes, weights, budget, epochs):
    """Water-filling in rounds, as it is usually told."""
    cap = {s: sizes[s] * epochs if weights[s] > 0 else 0.0 for s in sizes}
    budget = min(budget, sum(cap.values()))
    got, free = {}, {s for s in sizes if weights[s] > 0}
    while free:
        level = (budget - sum(got.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level >= cap[s]}
        if not over:
            return {s: 0.0 for s in sizes} | got | {s: weights[s] * level for s in free}
        got |= {s: cap[s] for s in over}
        free -= over
    return {s: 0.0 for s in sizes} | got


@pytest.mark.parametrize("seed", range(4))
def test_allocation_equals_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice((0, 10, 500, 3000, rng.randrange(1, 10_000))) for i in range(9)}
    weights = {s: rng.choice((0.0, 1.0, 1.0, rng.random() * 5)) for s in sizes}
    share, cap = rng.choice((0.3, 1.0, 2.5, 50.0)), rng.choice((1.0, 2.5, 4.0))
    df = spark.createDataFrame([(s, float(n), weights[s]) for s, n in sizes.items()], "source string, size double, weight double")
    got = {r["source"]: r["quota"] for r in mixing.allocate(df, share, cap).collect()}
    want = fill(sizes, weights, share * sum(sizes.values()), cap)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_mixture_repeats_and_thins(spark):
    rows = [(i, "w " * 50, "en", "big" if i % 10 else "small", 100) for i in range(3000)]
    d = table(spark, rows)
    options = {"weights": {"big": 1.0, "small": 1.0}, "max_epochs": 2.5}
    got = Counter((r["doc_id"], r["source"]) for r in mixing.sample(d, **options).collect())
    small = [got[(i, "small")] for i in range(0, 3000, 10)]
    assert set(small) == {2, 3} and abs(np.mean(small) - 2.5) < 0.15
    assert abs(sum(n for (_, s), n in got.items() if s == "big") - 2250) < 120
    assert Counter(r["doc_id"] for r in mixing.mix(d, **options).collect()) == Counter({i: n for (i, _), n in got.items()})
    assert Counter((r["doc_id"], r["source"]) for r in mixing.sample(d.repartition(7), **options).collect()) == got
    other = Counter((r["doc_id"], r["source"]) for r in mixing.sample(d, seed=5, **options).collect())
    assert other != got


# sharding


@pytest.mark.parametrize("shards,size", [(1, None), (7, None), (None, 1000), (200, None)])
def test_shards_are_contiguous_and_balanced(spark, shards, size):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(200)]), rng.choice((None, "", "é" * rng.randrange(300)))) for _ in range(400)]
    got = sharding.shard(table(spark, rows), shard_bytes=size or 1, shards=shards, partitions=5).collect()
    keys = sorted(((i is not None, i or 0, len((t or "").encode())) for i, t in rows))
    total = sum(k[2] for k in keys)
    number = shards or -(-total // size)
    want, at = [], 0
    for n, (there, i, b) in enumerate(keys):
        want.append((i if there else None, b, at, n, min(at * number // total, number - 1)))
        at += b
    assert sorted((tuple(r) for r in got), key=lambda r: r[3]) == want


# fixity


def test_shards_are_cut_exactly(spark):
    """A text that starts one byte before a cut belongs to the shard before it, however large the total."""
    rows = [(1, "x" * 9_999_999), (2, "y"), (3, "z" * 10_000_000)]
    got = {r["doc_id"]: (r["byte_start"], r["shard"]) for r in sharding.shard(table(spark, rows), shards=2).collect()}
    assert got == {1: (0, 0), 2: (9_999_999, 0), 3: (10_000_000, 1)}
    some = [(i, "x" * (1 + i * 7919 % 997)) for i in range(2000)]
    total = sum(len(t) for _, t in some)
    for n in (3, 1999, total, 10**15):
        assert all(r["shard"] == r["byte_start"] * n // total for r in sharding.shard(table(spark, some), shards=n).collect())


def test_audit_finds_all_damage_and_nothing_else(spark):
    rng = random.Random(11)
    rows = [(i, f"http://x/{i}", " ".join(words(rng, rng.randrange(20)))) for i in [*range(0, 9000, 3), -40, -41]]
    rows += [(30, "http://again", "second record"), (None, "u", "no id"), (None, None, None)]
    a = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert fixity.audit(a, a.repartition(5)).count() == 0
    lost, bad = {30, 600, 8997}, {0, 33, -41, 4095, 4098}
    hurt = [r for r in rows if r[0] not in lost] + [(1, "new", "x"), (70_000, "new", "y")]
    hurt = [(i, u, h + "!") if i in bad else (i, u, h) for i, u, h in hurt if (i, u) != (None, "u")]
    got = {r["page_id"]: r for r in fixity.audit(a, spark.createDataFrame(hurt, "page_id bigint, url string, html string")).collect()}
    want = dict.fromkeys(lost, "missing") | dict.fromkeys(bad & {r[0] for r in rows}, "corrupt") | {1: "extra", 70_000: "extra", None: "corrupt"}
    assert {k: r["status"] for k, r in got.items()} == want
    # offsets: bytes of the records before, in the same file of 4096 ids
    size = {r["key"]: r["n_bytes"] for r in fixity.records(a.where("page_id <> 30")).collect()}
    assert got[4098]["byte_offset"] == sum(n for k, n in size.items() if 4096 <= k < 4098) and got[4098]["file"] == 1
    assert got[600]["byte_offset"] == sum(n for k, n in size.items() if 0 <= k < 600) + sum(r["n_bytes"] for r in fixity.records(a.where("page_id = 30")).collect())
    assert fixity.audit(a.limit(0), a).count() == a.select("page_id").distinct().count()


def test_tree_levels(spark):
    a = spark.range(5000).selectExpr("id AS page_id", "'u' AS url", "cast(id AS string) AS html")
    t = fixity.Tree(a)
    assert [x.count() for x in t.levels] == [5000, 313, 20, 2, 1]
    assert t.root() == fixity.Tree(a.repartition(3)).root()


# classifiers


def two_kinds(rng, n, marked, marks, share=0.06, low=30, high=200):
    out = []
    for _ in range(n):
        w = words(rng, rng.randrange(low, high))
        if marked:
            w = [rng.choice(marks) if rng.random() < share else x for x in w]
        out.append(" ".join(w))
    return out


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(8)
    marks = ["grobian", "schurke", "halunke", "lumpenpack", "nichtsnutz", "taugenichts"]
    sample = [(t, 1) for t in two_kinds(rng, 150, True, marks)] + [(t, 0) for t in two_kinds(rng, 400, False, marks)]
    model = toxicity.fit(sample)
    docs = [(i, t) for i, t in enumerate(two_kinds(rng, 100, True, marks) + two_kinds(rng, 300, False, marks))]
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(table(spark, docs), model).collect()}
    assert sum(got[i] for i in range(100)) >= 95 and sum(got[i] for i in range(100, 400)) <= 6
    kept = {r["doc_id"] for r in toxicity.reject(table(spark, docs), model).collect()}
    assert kept == {i for i, bad in got.items() if not bad}
    # a mark at the very end of a long text is found: the whole text is read
    clean = " ".join(words(rng, 2000))
    score = toxicity.Scorer(model)(pa.array([clean, clean + " " + " ".join(marks * 12)]))[2]
    assert score[0] < model.threshold <= score[1]


def test_toxicity_scores_allow_for_length():
    rng = random.Random(12)
    marks = ["".join(rng.choice("qvwxzjk") for _ in range(8)) for _ in range(40)]
    slip = lambda n: " ".join(rng.choice(marks) if rng.random() < 0.004 else w for w in words(rng, n))  # noqa: E731  ordinary texts have some of the words, too
    clean = [(slip(rng.choice((60, 200, 600, 2500))), 0) for _ in range(600)]
    model = toxicity.fit(clean + [(" ".join(rng.choice(marks) if rng.random() < 0.3 else w for w in words(rng, rng.randrange(40, 300))), 1) for _ in range(150)])
    judge = lambda texts: toxicity.Scorer(model)(pa.array(texts))[2] >= model.threshold
    longer = judge([slip(30_000) for _ in range(10)])  # longer than all that were held out
    short = judge([" ".join(rng.choice(marks) if rng.random() < 0.3 else w for w in words(rng, 60)) for _ in range(60)])
    passage = judge([f"{slip(1200)} {' '.join(rng.choice(marks) for _ in range(60))} {slip(1200)}" for _ in range(40)])
    assert longer.mean() <= 0.05 and short.mean() >= 0.8 and passage.mean() >= 0.9, (longer.mean(), short.mean(), passage.mean())


def test_windows_cover_the_text():
    rng = random.Random(2)
    for size in (5, 64, 112):
        text = " ".join(words(rng, 300)).encode() + b"x" * 500
        ends = toxicity.windows(text, size)
        assert ends[-1] == len(text) and all(0 < b - a <= size for a, b in zip([0, *ends], ends))
        assert toxicity.windows(b"before " + text, size, 7) == [7 + e for e in ends]
    assert toxicity.windows(b"", 5) == []


def test_toxicity_measures_equal_brute_force():
    """Gains by one call of the compressor for each window, and both measures by loops."""
    rng = random.Random(4)
    marks = ["grobian", "schurke", "halunke"]
    model = toxicity.fit([(t, 1) for t in two_kinds(rng, 60, True, marks)] + [(t, 0) for t in two_kinds(rng, 120, False, marks)], pairs=5, screen=2, general=4096)
    assert len({p.toxic for p in model.pairs}) > 1 and all(p.toxic != p.ordinary for p in model.pairs)
    texts = two_kinds(rng, 10, True, marks, 0.2) + ["", None, "a", " ".join(words(rng, 900))]
    count, gain, whole, passage = toxicity.Scorer(model).measure(pa.array(texts, type=pa.large_string()))

    def size(w, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(w))

    found = 0
    for i, t in enumerate(texts):
        data, excess, at = (t or "").lower().encode(), [], 0
        for end in toxicity.windows(data, model.window):
            g = [size(data[at:end], p.ordinary) - size(data[at:end], p.toxic) for p in model.pairs]
            mean = sum(g) / 5 if sum(g[:2]) >= 2 * model.doubt else 0.0
            excess.append(max(mean - model.usual, 0.0))
            at = end
        best = max((sum(excess[j : j + toxicity.PASSAGE]) for j in range(len(excess))), default=0.0)
        assert count[i] == len(excess) and np.allclose([gain[i], whole[i], passage[i]], [sum(excess), sum(excess) / max(len(excess), 1) ** 0.5, best])
        found += sum(excess) > 0
    assert found >= 8


def test_samples_are_bounded(spark):
    """One id in 50,000 rows, texts beyond the bytes allowed, contradictory labels: what reaches the driver stays small."""
    rows = spark.range(50_000).selectExpr("id % 5 AS doc_id", "concat('text ', id % 7) AS text", "'en' AS lang")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)] + [(4, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = common.labelled_sample(rows, labels, "toxic", 10, 1)
    assert sorted(y for _, y in got) == [0, 0, 1, 1] and {t for t, _ in got} <= {f"text {i}" for i in range(7)}
    assert got == common.labelled_sample(rows.repartition(3), labels, "toxic", 10, 1)
    assert len(common.labelled_sample(rows, labels, "toxic", 1, 1)) == 2
    assert len(common.labelled_sample(rows, labels, "toxic", 10, 1, max_bytes=7)) == 2  # one text of six bytes a class
    assert len(langid.sample(rows, 3, 1)) == 3 and len(langid.sample(rows, 10, 1)) == 5
    two = rows.unionByName(spark.createDataFrame([(0, "texte", "fr"), (9, "texte", "fr")], "doc_id bigint, text string, lang string"))
    assert sorted(y for _, y in langid.sample(two, 10, 1)) == ["en"] * 4 + ["fr"]
    assert {y for _, y in langid.sample(two, 10, 1, max_languages=1)} == {"en"}


def test_nbsvm_on_held_out_texts(spark):
    rng = random.Random(6)
    bad = ["click", "here", "$$$", "win", "!!!"]
    sample = [(t, 0) for t in two_kinds(rng, 200, True, bad, 0.15)] + [(t, 1) for t in two_kinds(rng, 400, False, bad)]
    model = nbsvm.fit(sample)
    docs = [(i, t) for i, t in enumerate(two_kinds(rng, 100, True, bad, 0.15) + two_kinds(rng, 200, False, bad))]
    got = {r["doc_id"]: r["quality"] for r in nbsvm.classify(table(spark, docs), model).collect()}
    assert sum(got[i] == 0 for i in range(100)) >= 97 and sum(got[i] for i in range(100, 300)) >= 196


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 4)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    w = nbsvm.descend([np.arange(4)] * 60, list(x), y, 4, 0.5, 2000, 0, 1e-8)
    cost = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    best = cost(w)
    assert all(cost(w + rng.normal(size=4) * s) >= best - 1e-9 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_nbsvm_weights_and_scores_by_hand():
    """Log-count ratios from sets of features, scaling, interpolation, the held-out bias and scores, in plain Python."""
    rng = random.Random(14)
    sample = [(t, 0) for t in two_kinds(rng, 12, True, ["spam", "win"], 0.3, 5, 12)] + [(t, 1) for t in two_kinds(rng, 20, False, [], 0, 5, 12)]
    bits, smoothing, c, beta = 12, 0.5, 0.2, 0.4
    model = nbsvm.fit(sample, bits=bits, smoothing=smoothing, c=c, beta=beta, held=0.25, max_false_rate=0.2, epochs=15, seed=3)
    grams = lambda t: set(nbsvm.features(pa.array([t]), bits)[1].tolist())
    bad, good = [t for t, y in sample if y == 0], [t for t, y in sample if y == 1]
    texts, y = bad[:9] + good[:15], [-1.0] * 9 + [1.0] * 15
    p, q = Counter(), Counter()
    for t, k in zip(texts, y):
        (p if k > 0 else q).update(grams(t))
    total = lambda n: sum(n.values()) + smoothing * (1 << bits)
    ratio = {a: np.log((smoothing + p[a]) / total(p)) - np.log((smoothing + q[a]) / total(q)) for a in set(p) | set(q)}
    rows = [np.array([*sorted(grams(t)), 1 << bits]) for t in texts]
    w = nbsvm.descend(rows, [np.array([*(ratio[a] for a in r[:-1].tolist()), 1.0]) for r in rows], np.array(y), (1 << bits) + 1, c, 15, 3)
    mean = np.mean([abs(w[a]) for a in ratio if ratio[a] != 0])
    want = {a: ((1 - beta) * mean + beta * w[a]) * r for a, r in ratio.items()}
    raw = sorted(sum(want.get(a, 0.0) for a in grams(t)) for t in good[15:])
    assert model.bias == pytest.approx(-raw[int(5 * 0.2)])
    for t, _ in sample:
        assert model.score(pa.array([t]))[0] == pytest.approx(sum(want.get(a, 0.0) for a in grams(t)) + model.bias)


def test_nbsvm_features_are_token_grams():
    texts = ["Go, go! x", "", None, "go go"]
    row, at = nbsvm.features(pa.array(texts, type=pa.large_string()))
    assert [int((row == i).sum()) for i in range(4)] == [4 + 4, 0, 0, 2]
    assert set(at[row == 3]) & set(at[row == 0])


LANGS = {"aa": "the of and to in is", "bb": "der die und das nicht ein", "cc": "le la les des un que"}


def lingual(rng, lang, n):
    own = LANGS[lang].split()
    return [" ".join(rng.choice(own) if rng.random() < 0.5 else rng.choice(own)[::-1] + rng.choice(own) for _ in range(rng.randrange(4, 60))) for _ in range(n)]


def test_language_on_held_out_texts(spark):
    rng = random.Random(12)
    rows, k = [], 0
    for lang in LANGS:
        for t in lingual(rng, lang, 120):
            rows.append((k, t, lang, "s", len(t)))
            k += 1
    model = langid.train(table(spark, rows), per_language=100)
    test = [(i, t, "?", lang, 0) for lang in LANGS for i, t in enumerate(lingual(rng, lang, 60))]
    got = langid.identify(table(spark, test), model).collect()
    assert len(got) == 180 and np.mean([r["predicted"] == s[3] for r, s in zip(got, test)]) > 0.97
    assert (model.weight == 0).mean() > 0.5  # the L1 part leaves zeros
    dense = langid.train(table(spark, rows), per_language=100, l1=0.0)
    assert (dense.weight == 0).mean() < (model.weight == 0).mean()


def test_document_frequencies_are_exact(spark):
    rng = random.Random(1)
    texts = [*lingual(rng, "aa", 30), "", None, "ÄÖ ß"]
    seen, n = langid.frequencies(table(spark, [(i, t) for i, t in enumerate(texts)]).repartition(5))
    want = np.zeros(1 << langid.BITS, np.int64)
    for t in texts:
        want[langid.counts(pa.array([t], type=pa.large_string()))[1]] += 1
    assert n == len(texts) and (seen == want).all()
    _, _, times = langid.counts(pa.array(["abab"]))
    assert times.sum() == 4 + 3 + 2


def test_one_step_of_the_leader_by_hand():
    """A single batch from zero weights: gradients, steps and the elastic net in plain Python."""
    rng = random.Random(3)
    names = sorted(LANGS)[:3]
    sample = [(t, lang) for lang in names for t in lingual(rng, lang, 4)]
    bits, alpha, beta, l1, l2 = 10, 0.7, 1.3, 0.01, 0.2
    seen, n = np.arange(1 << bits) % 7, 50
    model = langid.fit(sample, seen, n, bits=bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=1, batch=100, held=0.0)
    grad = {}
    for text, lang in sample:
        _, at, times = langid.counts(pa.array([text]), bits)
        tfidf = {int(a): int(t) * (np.log((1 + n) / (1 + int(seen[a]))) + 1) for a, t in zip(at, times)}
        norm = sum(v * v for v in tfidf.values()) ** 0.5
        for c, name in enumerate(names):
            for a, v in [*((a, v / norm) for a, v in tfidf.items()), ("bias", 1.0)]:
                grad[a, c] = grad.get((a, c), 0.0) + (1 / 3 - (name == lang)) * v / len(sample)
    step = lambda g: 0.0 if abs(g) <= l1 else -(g - np.sign(g) * l1) / ((beta + abs(g)) / alpha + l2)
    want = np.zeros((1 << bits, 3))
    for (a, c), g in grad.items():
        if a != "bias":
            want[a, c] = step(g)
    assert np.allclose(model.weight, want) and np.allclose(model.bias, [step(grad["bias", c]) for c in range(3)])
    assert 0 < (want == 0).mean() < 1 and model.temperature == 1.0
    # scores of a text: the sum over its grams
    text = sample[0][0]
    _, at, times = langid.counts(pa.array([text]), bits)
    value = times * (np.log((1 + n) / (1 + seen[at])) + 1)
    assert np.allclose(model.logits(pa.array([text]))[0], (value / np.sqrt((value * value).sum())) @ want[at] + model.bias)


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert langid.temperature(logits * 4, y) == pytest.approx(4, rel=0.15)


# audio


def test_resampling_equals_direct_convolution():
    rng = np.random.default_rng(0)
    x = rng.normal(size=700)
    for source, target in ((11025, 8000), (8000, 16000), (44100, 8000), (8000, 8000)):
        got = audio.resample(x, source, target, block=97)
        assert len(got) == -(-len(x) * target // source)
        if source == target:
            assert (got == x).all()
            continue
        cut, half = min(1.0, target / source), int(16 * max(1.0, source / target))
        for m in (0, 1, 50, len(got) // 2, len(got) - 1):
            t = m * source / target - np.arange(len(x))
            h = np.where(np.abs(t) <= half, np.sinc(t * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * t / half)), 0)
            assert got[m] == pytest.approx((h * x).sum(), abs=1e-6)


def test_clips_done_together_equal_single_ones(monkeypatch):
    """Matrix rows, branches by phase and single outputs give the same, and clips don't leak into each other."""
    rng = np.random.default_rng(5)
    clips = [rng.normal(size=n) for n in (0, 1, 30, 700, 5, 2500)]
    for source in (11025, 44100, 16000, 44101, 3):
        got = audio.resample_all(clips, source, 8000)
        assert [len(y) for y in got] == [-(-len(x) * 8000 // source) for x in clips]
        for name, value in (("STEP", 1), ("KERNEL_CELLS", 1), ("CELLS", 64)):
            with monkeypatch.context() as m:
                m.setattr(audio, name, value)
                for x, y, z in zip(clips, got, audio.resample_all([c[:200] for c in clips] if name == "KERNEL_CELLS" else clips, source, 8000)):
                    upto = len(y) if len(x) <= 200 or name != "KERNEL_CELLS" else max(0, (200 - 16 * max(1, -(-source // 8000)) - 1) * 8000 // source)
                    assert np.allclose(y[:upto], z[:upto], atol=1e-9)
    assert len(audio.resample(clips[3], 2_000_000_011, 8000)) == 1  # a rate whose branches would be millions


def test_features_equal_a_naive_loop(spark):
    """Every row of features() against loops over clips, frames, bins and segments."""
    s = audio.Settings()
    rng = np.random.default_rng(7)
    rows = []
    for i, rate in enumerate((8000, 11025, 8000, 16000, 11025)):
        t = np.arange(rate) / rate
        loud = np.repeat(rng.choice([0.0, 0.001, 0.02, 0.5], 10), -(-rate // 10))[:rate]
        rows.append((i, np.rint(loud * np.sin(2 * np.pi * 300 * (i + 1) * t) * 32767).astype("<i2").tobytes(), rate))
    got = {(r["id"], r["segment"], r["part"]): r for r in audio.features(spark.createDataFrame(rows, "id bigint, audio binary, rate int")).collect()}
    want = {}
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(s.window) / s.window)
    wave = np.exp(-2j * np.pi * np.arange(s.size // 2 + 1)[:, None] * np.arange(s.window) / s.size)
    for i, pcm, rate in rows:
        x = np.frombuffer(pcm, "<i2") / 32768
        cut, half = min(1.0, s.rate / rate), int(16 * max(1.0, rate / s.rate))
        y = x
        if rate != s.rate:
            y = []
            for m in range(-(-len(x) * s.rate // rate)):
                t = m * rate / s.rate - np.arange(max(0, int(m * rate / s.rate) - half - 1), min(len(x), int(m * rate / s.rate) + half + 2))
                h = np.where(np.abs(t) <= half, np.sinc(t * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * t / half)), 0)
                y.append((h * x[np.rint(m * rate / s.rate - t).astype(int)]).sum())
            y = np.array(y)
        frames = [y[a : a + s.window] for a in range(0, len(y) - s.window + 1, s.hop)]
        level = [10 * np.log10(max((f * f).mean(), 1e-10)) for f in frames]
        runs, at = [], 0
        while at < len(level):
            if level[at] < s.low_db:
                at += 1
                continue
            end = at
            while end < len(level) and level[end] >= s.low_db:
                end += 1
            if runs and at - runs[-1][1] <= s.gap:
                runs[-1][1] = end
            else:
                runs.append([at, end])
            at = end
        runs = [(a, b) for a, b in runs if b - a >= s.least and max(level[a:b]) >= s.high_db]
        for n, (a, b) in enumerate(runs):
            for k, start in enumerate(range(a, b, s.frames)):
                tensor = np.full((s.frames, s.mels), audio.FLOOR)
                for j in range(start, min(b, start + s.frames)):
                    tensor[j - start] = np.log(np.maximum(audio.filterbank(s) @ (np.abs((frames[j] * hann * wave).sum(axis=1)) ** 2 / s.size), 1e-10))
                want[i, n, k] = (start * s.hop / s.rate, ((min(b, start + s.frames) - 1) * s.hop + s.window) / s.rate, min(b, start + s.frames) - start, tensor)
    assert set(got) == set(want) and len(want) > 5
    for key, (start, end, n, tensor) in want.items():
        r = got[key]
        assert (r["start_s"], r["end_s"], r["frames"]) == (pytest.approx(start), pytest.approx(end), n)
        assert np.allclose(np.array(r["features"]).reshape(s.frames, s.mels), tensor, atol=2e-3)


def test_log_mel_equals_naive_transform():
    s = audio.Settings()
    y = np.random.default_rng(2).normal(size=1000) * 0.1
    bank = audio.filterbank(s)
    got, level = audio.log_mel(y, s, bank, block=3)
    assert got.shape == ((1000 - s.window) // s.hop + 1, s.mels)
    frame = y[2 * s.hop : 2 * s.hop + s.window]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(s.window) / s.window)
    k = np.arange(s.size // 2 + 1)[:, None]
    spectrum = (frame * hann * np.exp(-2j * np.pi * k * np.arange(s.window) / s.size)).sum(axis=1)
    assert got[2] == pytest.approx(np.log(np.maximum(bank @ (np.abs(spectrum) ** 2 / s.size), 1e-10)))
    assert level[2] == pytest.approx(10 * np.log10((frame**2).mean()))
    assert (bank.max(axis=1) > 0).all()


def test_hysteresis():
    s = audio.Settings(high_db=-20, low_db=-40, least=2, gap=1)
    level = np.array([-60, -30, -10, -30, -50, -30, -60, -60, -30, -30, -60, -60, -10, -60, -60, -15, -15])
    assert audio.segments(level, s) == [(1, 6), (15, 17)]
    assert audio.segments(np.array([]), s) == []


def test_audio_features_and_tensors(spark, tmp_path):
    rate = 8000
    t = np.arange(rate * 2) / rate
    wave = np.where((t > 0.5) & (t < 1.5), np.sin(2 * np.pi * 440 * t) * 0.5, 0)
    pcm = np.rint(wave * 32767).astype("<i2").tobytes()
    clips = spark.createDataFrame([(1, pcm, rate), (2, None, rate), (3, pcm + b"\0", 0), (4, bytes(4000), rate), (None, pcm, rate), (5, pcm, -1)], "id bigint, audio binary, rate int")
    df = audio.features(clips)
    rows = df.collect()
    assert {r["id"] for r in rows} == {1, None}
    one = sorted((r for r in rows if r["id"] == 1), key=lambda r: r["part"])
    assert one[0]["start_s"] == pytest.approx(0.5, abs=0.03) and one[-1]["end_s"] == pytest.approx(1.5, abs=0.03)
    assert [r["part"] for r in one] == list(range(len(one))) and all(len(r["features"]) == 32 * 40 for r in one)
    got = audio.tensors(df.toArrow())
    kind = got.schema.field("features").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [32, 40]
    cube = got["features"].combine_chunks().to_numpy_ndarray() if hasattr(got["features"].combine_chunks(), "to_numpy_ndarray") else got["features"].chunk(0).to_numpy_ndarray()
    assert cube.shape == (len(rows), 32, 40)
    bank = audio.filterbank(audio.Settings())
    assert abs(int(cube[0][5].argmax()) - int(bank[:, round(440 * 256 / 8000)].argmax())) <= 1
    assert audio.write_tensors(df, f"file://{tmp_path}/uri").agg({"rows": "sum"}).first()[0] == len(rows)
    files = audio.write_tensors(df, str(tmp_path / "out")).collect()
    read = pa.concat_tables(pa.ipc.open_file(r["file"]).read_all() for r in files)
    assert read.num_rows == len(rows) and isinstance(read.schema.field("features").type, pa.FixedShapeTensorType)


def test_sonify(spark):
    e = spark.createDataFrame([(1, [0.0, 1.0, -1.0]), (2, []), (3, None), (4, [None, float("nan"), 0.0])], "vec_id bigint, embedding array<double>")
    got = {r["id"]: r for r in audio.sonify(e).collect()}
    assert len(got[1]["audio"]) == 3 * 220 * 2 and len(got[2]["audio"]) == 0 and not any(got[4]["audio"])
    assert {r["id"] for r in audio.features(audio.sonify(e)).collect()} == {1}


# words


def test_words_and_winnowing_against_plain_python():
    texts = ["Ab,c  d", "", None, "ÉTÉ — été…ñ　漢字。x_y", "a" * 70 + " " + "a" * 71, "the end"]
    w = tc.words(pa.array(texts, type=pa.large_string()))
    word = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), tc.WORD))
    plain = [word.findall((t or "").lower()) for t in texts]
    assert np.diff(w.bounds()).tolist() == [len(p) for p in plain]
    assert len({int(h) for h in w.hash}) == len({x for p in plain for x in p})
    # scripts without spaces: a word for each character, full-width punctuation between
    rng = random.Random(13)
    pool = "ab 1.,é漢字かなカ、。！？（）：；Ａｂ０豈𠀀𳿿한글ก_\u3000\u2019\uff65\uff66\uffef\U00034000ＡÉ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(400)] + ["漢", "漢字", "a漢", "漢a"]
    w = tc.words(pa.array(texts, type=pa.large_string()))
    plain = [word.findall(t.lower()) for t in texts]
    data = "".join(t.lower() for t in texts).encode()
    assert [data[a:b].decode() for a, b in zip(w.start, w.end)] == [x for p in plain for x in p]
    assert np.diff(w.bounds()).tolist() == [len(p) for p in plain]
    assert len(tc.words(pa.array(["漢" * 114])).hash) == 114
    rng = np.random.default_rng(0)
    g = rng.integers(0, 40, 300).astype(np.uint64)
    row = np.sort(rng.integers(0, 4, 300))
    grams = tc.grams(tc.mix(g), row, 3)
    got = set(tc.winnow(grams, row, 3, 4).tolist())
    want = set()
    for i in range(300 - 5):
        if row[i] == row[i + 5]:
            part = grams[i : i + 4]
            want |= {i + int(k) for k in np.flatnonzero(part == part.min())}
    assert got == want
