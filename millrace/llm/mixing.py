"""Mixing sources to target weights by capped water-filling (operator 4).

Each source may be seen at most max_epochs times.  With a budget of B
characters a source of weight w gets lambda * w of them, or its cap if that is
less; what capped sources leave goes to the others in proportion to their
weights.  Instead of repeating rounds until none exceeds its cap, the sources
are sorted by cap / weight: the capped ones are a prefix of that order, and
prefix sums give the water level lambda at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, ready

#: Draws have 52 bits, exact in a double.
DRAW = float(1 << 52)
#: The plan has one row per source; it is broadcast up to this size and beyond it joined by a shuffle.
PLAN_BYTES = 64 << 20


def allocate(sizes: DataFrame, budget_share: float = 1.0, max_epochs: float = 4.0, power: float = 0.5) -> DataFrame:
    """Characters and epochs for each source.

    sizes has source, size and (null: size ** power) weight.  The budget is
    budget_share of the total size, at most what the caps allow.  Returns
    source, size, weight, cap, quota and epochs.  A source of size or weight 0, or whose weight is negative or not
    a number, gets 0 epochs.  One row per source: the ordering window runs over this
    small aggregate, never over documents.
    """
    w = F.coalesce(F.col("weight"), F.pow(F.col("size").cast("double"), F.lit(power)))
    t = sizes.select("source", "size", F.when((w > 0) & ~F.isnan(w), w).otherwise(0.0).alias("weight"))
    t = t.withColumn("cap", F.when(F.col("weight") > 0, F.col("size") * F.lit(float(max_epochs))).otherwise(0.0))
    everything = Window.partitionBy()
    t = t.withColumn("budget", F.least(F.sum("size").over(everything) * F.lit(float(budget_share)), F.sum("cap").over(everything)))
    full = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0)
    t = t.withColumn("full_at", full)
    before = Window.partitionBy().orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy().orderBy("full_at", "source").rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("left_over", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weights", F.sum("weight").over(rest))
    t = t.withColumn("level", F.when(F.col("weights") > 0, F.col("left_over") / F.col("weights")))
    # the first source in this order that doesn't fill sets the level for itself and all after it
    water = F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "source", "level"))).over(everything)["level"]
    t = t.withColumn("water", water)
    quota = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water")))
    t = t.withColumn("quota", quota)
    epochs = F.when(F.col("size") > 0, F.col("quota") / F.col("size")).otherwise(0.0)
    return t.select("source", "size", "weight", "cap", "quota", epochs.alias("epochs"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed: the first 52 bits of an MD5 sum."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(DRAW)


def _with_copies(docs: DataFrame, weights: dict | None, budget_share: float, max_epochs: float, power: float, seed: int) -> tuple[DataFrame, str]:
    """docs with the numbers 1 to a row's copies, for rows that have any; and the name of that column."""
    ready(docs)
    source, epochs, copies = (fresh(docs, f"mix_{x}") for x in ("source", "epochs", "copies"))
    given = F.lit(None).cast("double")
    if weights is not None:
        given = F.lit(0.0)
        for k, v in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(k).cast("string")), F.lit(float(v))).otherwise(given)
    sizes = (
        docs.groupBy("source").agg(F.sum(F.coalesce(F.col("n_chars"), F.lit(0))).alias("size"))
        .withColumn("weight", given)
    )
    plan = cut(allocate(sizes, budget_share, max_epochs, power).select(F.col("source").alias(source), F.col("epochs").alias(epochs)))
    plan = broadcast_if_small(plan, PLAN_BYTES, 100)
    whole = F.floor(F.col(epochs))
    number = (whole + (draw(F.col("doc_id"), seed) < F.col(epochs) - whole).cast("int")).cast("bigint")
    t = docs.join(plan, F.col("source").eqNullSafe(F.col(source)), "left").withColumn(copies, number).where(F.col(copies) > 0)
    return t.withColumn(copies, F.sequence(F.lit(1).cast("bigint"), F.col(copies))), copies


def mix(docs: DataFrame, weights: dict | None = None, budget_share: float = 1.0, max_epochs: float = 4.0, power: float = 0.5, seed: int = 4) -> DataFrame:
    """docs with every row as often as the mixture asks: whole epochs, and one more for a seeded fraction.

    A document of a source with e epochs comes floor(e) times, and once more if
    the draw of its doc_id is under e's fraction.  Sizes are n_chars (null: 0).
    A null source is a source of its own; with null doc_id all share one draw;
    rows with the same doc_id share theirs.  weights maps sources to target
    weights (absent ones get 0); by default a source's weight is its size to
    the given power.  Columns and their order stay; an empty table stays empty.
    """
    t, copies = _with_copies(docs, weights, budget_share, max_epochs, power, seed)
    return t.withColumn(copies, F.explode(copies)).drop(copies, *set(t.columns) - {*docs.columns, copies})


def sample(docs: DataFrame, weights: dict | None = None, budget_share: float = 1.0, max_epochs: float = 4.0, power: float = 0.5, seed: int = 4) -> DataFrame:
    """mix() as doc_id, source and copy (1, 2, ...), for which only doc_id, source and n_chars are read."""
    t, copies = _with_copies(docs.select("doc_id", "source", "n_chars"), weights, budget_share, max_epochs, power, seed)
    return t.select("doc_id", "source", F.explode(copies).alias("copy"))
