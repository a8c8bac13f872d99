"""Usage rollups and routing KPIs."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Targets:
    """Bounds, price weights and model-name patterns; patterns are tried tier by tier in this order."""

    window_days: int = 7
    tiers: tuple[tuple[str, str], ...] = (
        ("ECONOMY", "haiku|flash|mini"),
        ("STANDARD", "sonnet"),
        ("FRONTIER", r"codex|kimi|grok|gemini-3.1-pro|gpt-5.4$|gpt-5.5|luna|terra|sol|opus|fable"),
    )
    weights: dict[str, float] = field(default_factory=lambda: dict(cache_read=0.1, cache_write=1.25, uncached=1.0))
    mechanical: tuple[str, ...] = ("explore", "task")
    frontier_cost_share_max: float = 0.5
    avg_main_weighted_input_per_turn_max: float = 25_000
    economy_share_of_mechanical_dispatches_min: float = 0.8
    subagent_escalation_rate_max: float = 0.15


def tier(model: Column, targets: Targets = Targets()) -> Column:
    """ECONOMY, STANDARD, FRONTIER or UNKNOWN by the first pattern found in the lower-cased name."""
    name = F.lower(model)
    chain = F.when(F.coalesce(model, F.lit("")) == "", "UNKNOWN")
    for label, pattern in targets.tiers:
        chain = chain.when(name.rlike(pattern), label)
    return chain.otherwise("UNKNOWN")


def cutoff_date(as_of: datetime, days: int | None, targets: Targets = Targets()) -> str:
    """The first date of the window; 0 and None days mean the default."""
    return str((as_of - timedelta(days or targets.window_days)).date())


def in_window(created_at: Column, first_date: str) -> Column:
    """By the date prefix of ISO text, inclusive, without an upper bound.  ISO text sorts as its
    prefix does, so a plain comparison says the same and reaches the scan as a pushed filter."""
    return created_at >= F.lit(first_date)


def role() -> Column:
    own = (F.coalesce("parent_tool_call_id", F.lit("")) == "") & (F.coalesce("agent_id", F.lit("")) == "")
    return F.when(own, "main").otherwise("subagent")


def rollup(usage: DataFrame, first_date: str) -> DataFrame:
    """Calls and summed tokens and cost by model (null is a group) and role."""
    sums = {"in_tok": "input_tokens", "cr_tok": "cache_read_tokens", "cw_tok": "cache_write_tokens", "out_tok": "output_tokens", "aiu": "total_nano_aiu"}
    return usage.where(in_window(F.col("created_at"), first_date)).groupBy("model", role().alias("role")).agg(
        F.count(F.lit(1)).alias("calls"), *(F.sum(F.coalesce(c, F.lit(0))).alias(n) for n, c in sums.items()))


def dispatches(lines: DataFrame) -> DataFrame:
    """session, agent_type, model, effort and name of each task request in log lines (session, value).

    Lines without "task" are left before any parsing; malformed lines and lines
    that aren't objects are skipped.  A missing agent_type is '?', a null one
    stays null; a missing name is ''.
    """
    request = "struct<name:string,arguments:string>"
    t = lines.where(F.col("value").contains('"task"'))
    t = t.select("session", F.explode(F.from_json("value", f"data struct<toolRequests:array<{request}>>")["data"]["toolRequests"]).alias("r")).where("r.name = 'task'")
    a = F.coalesce(F.col("r.arguments"), F.lit("{}"))
    keys = F.coalesce(F.json_object_keys(a), F.array().cast("array<string>"))
    get = lambda k: F.get_json_object(a, f"$.{k}")
    or_missing = lambda k, default: F.when(F.array_contains(keys, k), get(k)).otherwise(default)
    return t.select(
        "session", or_missing("agent_type", "?").alias("agent_type"), get("model").alias("model"), get("reasoning_effort").alias("effort"), or_missing("name", "").alias("name"))


def cost_kpis(usage: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """One row from a rollup: total_nano_aiu, frontier_cost_share and avg_main_weighted_input_per_turn, unrounded.

    Uncached input is clamped at 0 per group, not per event.  A total of 0
    counts as 1, and so do 0 main calls.
    """
    w, t = targets.weights, usage.withColumn("tier", tier(F.col("model"), targets))
    weighted = (
        F.greatest(F.col("in_tok") - F.col("cr_tok") - F.col("cw_tok"), F.lit(0)) * F.lit(w["uncached"])
        + F.col("cw_tok") * F.lit(w["cache_write"]) + F.col("cr_tok") * F.lit(w["cache_read"]))
    main = F.col("role") == "main"
    one = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(1)).otherwise(c)
    sums = t.agg(
        F.sum("aiu").alias("aiu"), F.sum(F.when(F.col("tier") == "FRONTIER", F.col("aiu"))).alias("frontier"),
        F.sum(F.when(main, weighted)).alias("input"), F.sum(F.when(main, F.col("calls"))).alias("calls"))
    return sums.select(
        one(F.col("aiu")).cast("bigint").alias("total_nano_aiu"),
        (F.coalesce("frontier", F.lit(0)).cast("double") / one(F.col("aiu"))).alias("frontier_cost_share"),
        (F.coalesce("input", F.lit(0.0)) / one(F.col("calls"))).alias("avg_main_weighted_input_per_turn"))


def dispatch_kpis(tasks: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """One row: task_dispatches, mechanical_dispatches, and the two shares of mechanical ones (null without any)."""
    t = tasks.withColumn("m", F.coalesce(F.col("agent_type").isin(*targets.mechanical), F.lit(False))).withColumn("tier", tier(F.col("model"), targets))
    cheap = F.col("model").isNull() | (F.col("tier") == "ECONOMY")
    dear = F.col("model").isNotNull() & F.col("tier").isin("STANDARD", "FRONTIER")
    share = lambda c: F.avg(F.when(F.col("m"), c.cast("int")))
    return t.agg(
        F.count(F.lit(1)).alias("task_dispatches"), F.count_if("m").alias("mechanical_dispatches"),
        share(cheap).alias("economy_share_of_mechanical_dispatches"), share(dear).alias("subagent_escalation_rate"))


def kpis(usage: DataFrame, tasks: DataFrame, targets: Targets = Targets()) -> DataFrame:
    return cost_kpis(usage, targets).crossJoin(dispatch_kpis(tasks, targets))


RULES = (
    ("frontier_cost_share", ">", "frontier_cost_share_max"),
    ("avg_main_weighted_input_per_turn", ">", "avg_main_weighted_input_per_turn_max"),
    ("economy_share_of_mechanical_dispatches", "<", "economy_share_of_mechanical_dispatches_min"),
    ("subagent_escalation_rate", ">", "subagent_escalation_rate_max"),
)


def breaches(kpi_row: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """kpi, value, bound and breached (strictly beyond; a null never breaches) for the four rules."""
    rule = F.explode(F.array(*(
        F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value"), F.lit(float(getattr(targets, b))).alias("bound"), F.lit(op).alias("op")) for k, op, b in RULES)))
    t = kpi_row.select(rule.alias("r")).select("r.*")
    over = F.when(F.col("op") == ">", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    return t.select("kpi", "value", "bound", F.coalesce(over, F.lit(False)).alias("breached"))


def top_usage(usage: DataFrame, n: int = 12) -> DataFrame:
    """The n groups of highest cost; ties by model and role."""
    return usage.orderBy(F.desc("aiu"), F.asc_nulls_first("model"), "role").limit(n)


def trend(snapshots: DataFrame, kpi: str) -> DataFrame:
    """at, value, change from the snapshot before, and (=), up, down or '' where either is null."""
    before = F.lag(kpi).over(Window.orderBy("at"))  # snapshots are few: one a day at most
    t = snapshots.select("at", F.col(kpi).alias("value"), (F.col(kpi) - before).alias("change"))
    sign = F.when(F.col("change").isNull(), "").when(F.col("change") == 0, "(=)").when(F.col("change") > 0, "up").otherwise("down")
    return t.withColumn("trend", sign)


def retained(snapshots: DataFrame, keep: int = 52) -> DataFrame:
    return snapshots.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("at")))).where(F.col("_n") <= keep).drop("_n")
