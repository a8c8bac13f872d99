import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "l", "")]


def words(rng, n, vocab=VOCAB):
    return [rng.choice(vocab) + rng.choice(("", "ing", "er", "s")) for _ in range(n)]


def table(spark, rows):
    """documents from (doc_id, text) or whole rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", f"s{(r[0] or 0) % 3}", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd(spark):
    """Nulls in each column, empty and long texts, ties and repeated rows."""
    rng = random.Random(9)
    long = " ".join(words(rng, 60_000))
    some = " ".join(words(rng, 80))
    return spark.createDataFrame(
        [
            (1, some, "en", "a", len(some)), (1, some, "en", "a", len(some)), (2, some, "en", "b", len(some)), (3, None, "en", "a", None), (4, "", None, "a", 0),
            (None, some, "en", "a", len(some)), (None, None, None, None, None), (5, long, "en", None, len(long)), (6, " \n\t ", "de", "b", 4), (7, "!!! ...", "de", "b", 7),
            (8, "ß ü 漢字 😀 \u0000 é", "de", "b", 14), (9, "x" * 300_000, "de", "b", 300_000), (-5, "one two", "fr", "c", 7), (1, "another text under the same id", "en", "a", 30),
        ],
        DOCS,
    )


#: Names that operators use inside, as columns of the input.
CLASHES = "row key hash words start end n id at y print node root leaf tile home a b rep f0 f3 hi lo code copies group_id kept part offset first shard position record digest slice slot bits text_sha _gone _up windows gain score toxic predicted size weight cap epochs item dk ik".split()


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHES))
