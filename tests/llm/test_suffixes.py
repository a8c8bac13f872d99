import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffixes

from helpers import DOCS


def brute(rows, least):
    """Words covered by a window of `least` words that occurs at two places."""
    tokens = [(i, (t or "").lower().split()) for i, t in rows]
    seen = Counter(tuple(w[a : a + least]) for _, w in tokens for a in range(len(w) - least + 1))
    covered = {}
    for i, w in tokens:
        for a in range(len(w) - least + 1):
            if seen[tuple(w[a : a + least])] > 1 and i is not None:
                covered.setdefault(i, set()).update(range(a, a + least))
    out = set()
    for i, c in covered.items():
        for a in sorted(c):
            if a - 1 not in c:
                b = a
                while b in c:
                    b += 1
                out.add((i, a, b, b - a))
    return out


def corpus(seed, n=60, least=10):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randrange(400))
    passages = [[word() for _ in range(rng.randrange(least - 2, 3 * least))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((i, " ".join(w)))
    rows += [(n, "x " * 40), (n + 1, None), (n + 2, ""), (n + 3, rows[0][1]), (n + 4, " ".join("long%d" % (k % 997) for k in range(3000)))]
    return rows + [(None, rows[1][1])]


@pytest.mark.parametrize("seed,batch,bits,hot,family", [(1, 64, 1 << 28, 1 << 16, 100), (2, 1 << 20, 1 << 28, 3, 1 << 23), (3, 300, 1 << 16, 1 << 16, 1), (4, 200, 1 << 16, 12, 400), (5, 64, 1 << 28, 1, 1)])
def test_against_brute_force(spark, seed, batch, bits, hot, family):
    """Whatever the batches, filters, hot minimisers and lengths of families: the same passages."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = [tuple(r) for r in suffixes.repeats(docs, least=10, k=4, batch_words=batch, max_filter_bits=bits, hot=hot, family_words=family).collect()]
    assert set(got) == brute(rows, 10) and len(got) == len(set(got))


def test_equal_batches_take_no_room():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 32, 1000).astype(np.uint32)
    family, found = suffixes.Family(50), 0
    for _ in range(200):
        found += len(family.add(w, np.array([600, 400]))[0])
    assert family.size == 1000 and sum(len(x.key) for x in family.levels) == 551 + 351 and found == 199 * (551 + 351)
    assert len(family.repeated()[0]) == 551 + 351


def test_one_passage_in_a_third_of_all_rows(spark):
    """A hot passage and a hot doc_id: found whole, by the way of hot minimisers and without it."""
    line = " ".join(f"l{i}" for i in range(60))
    docs = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN 7 ELSE -id END AS doc_id",
        f"CASE WHEN id % 3 = 0 THEN concat('a', id, ' {line} b', id) WHEN id % 3 = 1 THEN 'short {line}' ELSE concat('x', id) END AS text")
    want = {(i, 1, 61, 60) for i in range(0, 3000, 3)} | {(7, 0, 61, 61)}
    for hot in (1 << 16, 100):
        assert {tuple(r) for r in suffixes.repeats(docs, hot=hot).collect()} == want


def test_levels_grow_geometrically_and_find_everything():
    rng = np.random.default_rng(0)
    family, text, hits = suffixes.Family(6), [], set()
    for k in range(16):
        w = rng.integers(0, 3, 40).astype(np.uint32)
        row, at = family.add(w, np.array([25, 15]))
        hits |= set(zip(row.tolist(), at.tolist()))
        text += [w[:25], w[25:]]
        sizes = [len(x.key) for x in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:]))
        assert all((np.diff(x.key.astype(object)) >= 0).all() for x in family.levels)
    row, at = family.repeated()
    hits |= set(zip(row.tolist(), at.tolist()))
    seen = Counter(tuple(w[a : a + 6]) for w in text for a in range(len(w) - 5))
    assert hits == {(i, a) for i, w in enumerate(text) for a in range(len(w) - 5) if seen[tuple(w[a : a + 6])] > 1}


def covered(spans):
    return {(i, k) for i, a, b, _ in spans for k in range(a, b)}


def test_index_takes_batches(spark, tmp_path):
    rows = corpus(5)
    index = suffixes.Index(spark, str(tmp_path / "index"), least=10, k=4, batch_words=500)
    got, sizes = set(), []
    for n in range(5):
        part = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows[n::5]], DOCS)
        got |= covered(map(tuple, index.add(part).collect()))
        assert got >= covered(brute([r for m in range(n + 1) for r in rows[m::5]], 10))
        sizes.append([m for _, m in index.levels()])
        assert all(a > b for a, b in zip(sizes[-1], sizes[-1][1:]))
    assert got == covered(brute(rows, 10))
    # a list of levels that was never finished is not read, and nothing else is left behind
    (tmp_path / "index" / "levels-99").mkdir()
    assert [m for _, m in suffixes.Index(spark, str(tmp_path / "index")).levels()] == sizes[-1]
    kept = {p.name for p in (tmp_path / "index").iterdir()} - {"levels-99", "levels-4"}
    assert kept == {n for n, _ in index.levels()}
    assert index.add(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], DOCS)
    assert suffixes.repeats(docs).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(1, text, 5, 6, 7), (2, text, 5, 6, 7)], "doc_id bigint, text string, start int, end int, key int")
    assert {tuple(r) for r in suffixes.repeats(odd).collect()} == {(1, 0, 60, 60), (2, 0, 60, 60)}
