"""Every operator over odd tables: defined results, no crash, no confusion with columns of the input."""

import pytest
from helpers import odd, table, with_clashes

from millrace.llm import audio, fixity, langid, mixing, nbsvm, sharding, simhash, suffixes, toxicity, winnowing


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None), (6, 1, 0), (6, 0, 1), (99, 1, 1)]
ITEMS = [(1, "a b c"), (None, " ".join(f"w{i}" for i in range(30))), (2, None), (3, "")]


def pages(df):
    return df.selectExpr("doc_id AS page_id", "lang AS url", "text AS html")


def clips(df):
    return df.selectExpr("doc_id AS id", "cast(text as binary) AS audio", "cast(n_chars as int) AS rate")


def operators(spark):
    lb, bm = labels(spark, LABELS), benchmark(spark, ITEMS)
    return {
        "fixity": lambda d: fixity.audit(pages(d), pages(d.where("doc_id IS NULL OR doc_id <> 2"))),
        "winnowing": lambda d: winnowing.contamination(d, bm),
        "winnowing by shuffle": lambda d: winnowing.contamination(d, bm, broadcast_bytes=0),
        "suffixes": suffixes.repeats,
        "mixing": mixing.sample,
        "langid": lambda d: langid.identify(d, langid.train(d)),
        "simhash": simhash.groups,
        "simhash pairs": simhash.pairs,
        "audio": lambda d: audio.features(clips(d)),
        "toxicity": lambda d: toxicity.classify(d, toxicity.train(d, lb)),
        "sharding": lambda d: sharding.shard(d, shards=3),
        "nbsvm": lambda d: nbsvm.classify(d, nbsvm.train(d, lb)),
    }


def filters(spark):
    lb, bm = labels(spark, LABELS), benchmark(spark, ITEMS)
    return {
        "toxicity": lambda d: toxicity.reject(d, toxicity.train(d, lb)),
        "winnowing": lambda d: winnowing.decontaminate(d, bm),
        "winnowing by shuffle": lambda d: winnowing.decontaminate(d, bm, broadcast_bytes=0),
        "simhash": simhash.deduplicate,
        "mixing": mixing.mix,
    }


NAMES = ["fixity", "winnowing", "winnowing by shuffle", "suffixes", "mixing", "langid", "simhash", "simhash pairs", "audio", "toxicity", "sharding", "nbsvm"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(spark, name):
    f, d = operators(spark)[name], odd(spark)
    plain = sorted(map(str, f(d).collect()))
    assert sorted(map(str, f(with_clashes(d)).collect())) == plain


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](table(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "winnowing", "winnowing by shuffle", "simhash", "mixing"])
def test_filters_keep_columns(spark, name):
    f, d = filters(spark)[name], with_clashes(odd(spark))
    kept = f(d)
    assert kept.columns == d.columns and kept.schema.simpleString() == d.schema.simpleString()
    kept.collect()
    assert f(table(spark, [])).collect() == []


def test_judgements_cover_every_row(spark):
    d = odd(spark)
    for name in ("toxicity", "langid", "nbsvm", "sharding"):
        assert operators(spark)[name](d).count() == d.count(), name


def test_simhash_of_odd_rows(spark):
    got = {tuple(r) for r in simhash.groups(odd(spark)).collect()}
    assert got == {(1, 1, True, 0), (2, 1, False, 0)}
    # the repeated row, id 2 and the row without an id have the text of id 1; an id's other text and texts without words stay
    left = simhash.deduplicate(odd(spark))
    assert left.where("doc_id = 2").count() == 0 and left.where("doc_id = 1").count() == 2 and left.where("doc_id IS NULL").count() == 1
    assert left.count() == odd(spark).count() - 3


def test_no_model_without_labels(spark):
    d, none = odd(spark), labels(spark)
    assert toxicity.train(d, none) is None and nbsvm.train(d, none) is None
    assert toxicity.classify(d, None).where("toxic").count() == 0
    assert toxicity.reject(d, None).count() == d.count()
    assert nbsvm.classify(d, None).where("quality = 0").count() == 0
    assert {r["predicted"] for r in langid.identify(d, langid.train(d.where("lang IS NULL"))).collect()} == {None}


def test_empty_benchmark_and_empty_both(spark):
    d, none = odd(spark), benchmark(spark)
    for limit in (1 << 20, 0):
        assert winnowing.contamination(d, none, broadcast_bytes=limit).count() == 0
        assert winnowing.decontaminate(d, none, broadcast_bytes=limit).count() == d.count()
