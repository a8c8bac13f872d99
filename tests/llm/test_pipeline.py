"""run() against the stages worked out one by one with plain Python, on a small corpus with planted cases."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from helpers import DOCS, words

from millrace.llm import mixing

MARKS = ["grobian", "schurke", "halunke", "lumpenpack", "nichtsnutz", "taugenichts"]


def corpus(spark, folder):
    rng = random.Random(21)
    rows = [[i, words(rng, rng.randrange(30, 150)), f"s{i % 4}"] for i in range(600)]
    toxic = set(range(0, 240, 2))
    for i in toxic:
        rows[i][1] = [rng.choice(MARKS) if rng.random() < 0.08 else x for x in rows[i][1]]
    copies = {}
    for i in range(301, 340, 2):
        rows[i][1] = list(rows[i - 100][1])
        rows[i][1][3] = "swapped"
        copies[i] = i - 100
    items = [words(rng, 20) for _ in range(5)]
    leaked = set(range(401, 440, 4))
    for i in leaked:
        rows[i][1][10:10] = items[i % 5]
    spark.createDataFrame([(i, " ".join(w), "en", s, len(" ".join(w))) for i, w, s in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 600) if i % 3 != 1 or i > 300], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, toxic, copies, leaked


def test_run_equals_brute_force(spark, tmp_path):
    rows, toxic, copies, leaked = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # stage by stage
    after = {}
    now = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        after[name] = Counter(r["doc_id"] for r in now.collect())
    gone = {i for i in range(600)} - set(after["toxicity"])
    assert len(gone & toxic) >= 0.93 * len(toxic) and len(gone - toxic) <= 4
    kept = set(after["toxicity"])
    dropped = kept - set(after["simhash near-dedup"])
    assert dropped == {i for i, j in copies.items() if i in kept and j in kept}
    kept -= dropped
    assert kept - set(after["benchmark decontamination"]) == leaked & kept
    kept -= leaked
    size = {s: sum(len(" ".join(rows[i][1])) for i in kept if rows[i][2] == s) for s in ("s0", "s1", "s2", "s3")}
    total = sum(size.values())
    weight = {s: n**0.5 for s, n in size.items()}
    epochs = {s: min(4.0, total * weight[s] / sum(weight.values()) / size[s]) for s in size}
    draw = lambda i: int(hashlib.md5(f"4:{i}".encode()).hexdigest()[:13], 16) / mixing.DRAW
    want = Counter()
    for i in kept:
        e = epochs[rows[i][2]]
        want[i] = int(e) + (draw(i) < e - int(e))
    want = +want
    assert after["mixing"] == want
    at, plain = 0, []
    for n, i in enumerate(sorted(want.elements())):
        b = len(" ".join(rows[i][1]).encode())
        plain.append((i, b, at, n))
        at += b
    assert sorted((r[:4] for r in got), key=lambda r: r[3]) == plain and {r[4] for r in got} == {0}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding"]
