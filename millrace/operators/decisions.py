"""Gates and bounded decisions: unanimity, convergence, pins, escalation and levers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("ECONOMY", "STANDARD", "FRONTIER")
#: (signal, what it means, lever); advice levers never act by themselves.
LEVERS = (
    ("subagent_escalation_rate", "pins too cheap", "raise_pin"),
    ("escalation_near_zero", "pins may be lower", "lower_pin"),
    ("economy_share_of_mechanical_dispatches", "pins overridden", "sharpen_rubric"),
    ("mechanical_dispatches_near_zero", "too little delegated", "widen_delegation"),
    ("avg_main_weighted_input_per_turn", "context too long", "advise_compaction"),
    ("frontier_cost_share", "session model too dear", "advise_session_model"),
)
#: Kinds of work and their tier; the first row that holds one wins.
ROUTES = (
    ("run_and_report file_ops formatting log_parsing", "ECONOMY"),
    ("search locate", "ECONOMY"),
    ("summarize extract", "ECONOMY"),
    ("mechanical_edit", "STANDARD"),
    ("docs covered_refactor research drafting review", "STANDARD"),
    ("debugging design uncovered_refactor", "FRONTIER"),
    ("adversarial security architecture tradeoffs synthesis irreversible", "FRONTIER"),
)


def all_pass(checks: DataFrame, passed: str = "passed") -> DataFrame:
    """One row: passed is true when every check is (a null isn't), also when there is none."""
    return checks.agg(F.coalesce(F.bool_and(F.coalesce(F.col(passed), F.lit(False))), F.lit(True)).alias("passed"))


def unanimity(scores: DataFrame, *group: str, seats: int = 3, least: int = 90) -> DataFrame:
    """scores, lowest and passed per group: `seats` scores, all of at least `least`.  A missing one never passes, and none makes up for another."""
    return scores.groupBy(*group).agg(F.count("score").alias("scores"), F.min("score").alias("lowest")).withColumn(
        "passed", F.coalesce((F.col("scores") == seats) & (F.col("lowest") >= least), F.lit(False)))


def score_is_valid(score: Column, blocker: Column, changes: Column, least: int = 90) -> Column:
    """A passing score names no blocker; a failing one asks for a change at least."""
    fine = F.when(score >= least, F.lower(F.trim(blocker)) == "none").otherwise(changes >= 1)
    return F.coalesce(score.between(0, 100) & fine, F.lit(False))


def convergence(rounds: DataFrame, *run: str) -> DataFrame:
    """status per run from rounds (check_no, seats, passed): abort, degraded, converged_1, converged_2 or not_converged."""
    first = F.min(F.when(F.col("passed"), F.col("check_no")))
    t = rounds.groupBy(*run).agg(F.min("seats").alias("seats"), first.alias("at"))
    status = F.when(F.col("seats") < 2, "abort").when(F.col("seats") == 2, "degraded").when(F.col("at") == 1, "converged_1").when(F.col("at") == 2, "converged_2").otherwise("not_converged")
    return t.withColumn("status", status).drop("at")


def ordinal(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int")


def _named(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), n.cast("int"))


def pin_step(tier: Column, direction: Column, floor: Column, ceiling: Column) -> Column:
    """The tier one step up (+1) or down (-1), never beyond floor or ceiling."""
    moved = ordinal(tier) + F.signum(direction).cast("int")
    return _named(F.least(F.greatest(moved, ordinal(floor)), ordinal(ceiling)))


def escalate(tier: Column) -> Column:
    """The next tier up; null above the highest: a tier is never tried twice."""
    return F.when(ordinal(tier) < len(TIERS), _named(F.least(ordinal(tier) + 1, F.lit(len(TIERS)))))


def route(kind: Column, heavy: Column, verifiable: Column, irreversible: Column, high_stakes: Column) -> Column:
    """The tier of a piece of work by its kind, the first row of ROUTES that lists it.

    Heavy summaries are STANDARD.  A kind that no row lists is in doubt: the
    lower tier if its result can be verified by machine, else the higher one.
    What can't be undone and what is high-stakes is FRONTIER whatever its kind.
    """
    chain = F.when(irreversible | high_stakes, "FRONTIER").when(kind.isin("summarize", "extract") & heavy, "STANDARD")
    for kinds, tier in ROUTES:
        chain = chain.when(kind.isin(*kinds.split()), tier)
    return chain.when(verifiable, "STANDARD").otherwise("FRONTIER")


def diagnose(breach_rows: DataFrame) -> DataFrame:
    """Breached KPIs with the lever that each calls for; the lever table is a literal of six rows."""
    levers = breach_rows.sparkSession.createDataFrame(LEVERS, "kpi string, meaning string, lever string")
    return breach_rows.where("breached").join(F.broadcast(levers), "kpi", "left")


def reviewed(changes: DataFrame, *lever: str, wait: int = 3) -> DataFrame:
    """changes (cycle, value before, value after, higher_is_better, quality_breach) with verdict and retry_from.

    VERIFIED if the KPI that a change was for held or improved; REVERTED if it
    got worse or a quality breach came with it, and then the same change isn't
    tried again for `wait` cycles: retry_from is the first cycle that may.
    repeated_too_soon marks a change made before that.
    """
    gain = F.when(F.col("higher_is_better"), F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    bad = F.coalesce(gain < 0, F.lit(False)) | F.coalesce(F.col("quality_breach"), F.lit(False))
    t = changes.withColumn("verdict", F.when(bad, "REVERTED").otherwise("VERIFIED")).withColumn("retry_from", F.when(bad, F.col("cycle") + wait + 1))
    order = Window.partitionBy(*lever).orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("repeated_too_soon", F.coalesce(F.col("cycle") < F.max("retry_from").over(order), F.lit(False)))


def cooled(cycles: DataFrame, *lever: str, wait: int = 3) -> DataFrame:
    """cycles (cycle, changed, breached) with may_act (no change in the last `wait` cycles) and clean (two cycles without breach)."""
    order = Window.partitionBy(*lever).orderBy("cycle")
    recent = F.sum(F.col("changed").cast("int")).over(order.rowsBetween(-wait, -1))
    clean = F.sum(F.col("breached").cast("int")).over(order.rowsBetween(-1, 0))
    two = F.count(F.lit(1)).over(order.rowsBetween(-1, 0)) == 2
    return cycles.withColumn("may_act", F.coalesce(recent, F.lit(0)) == 0).withColumn("clean", two & (clean == 0))
