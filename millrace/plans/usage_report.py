"""The usage report: KPIs against their bounds, kept snapshots and a page of Markdown."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from ..schemas import SNAPSHOTS
from ..session import exists, file_system
from ..sources import sinks

#: Snapshots that are kept, and groups that the page lists.
KEEP, TOP = 52, 12
LABELS = {
    "frontier_cost_share": "Frontier share of cost",
    "avg_main_weighted_input_per_turn": "Weighted input a main turn",
    "economy_share_of_mechanical_dispatches": "Economy share of mechanical dispatches",
    "subagent_escalation_rate": "Escalation rate of subagents",
}


def rounded(value: float | None, digits: int = 0) -> float | int | None:
    """For display alone: half to even on the exact binary value, which Spark's decimal rounding isn't."""
    return None if value is None else round(value, digits or None)


def snapshot(kpi_row: DataFrame, breach_rows: DataFrame, at: str) -> DataFrame:
    """One row of SNAPSHOTS: the KPIs, rounded as they are shown, and the names of those in breach."""
    k = kpi_row.first()
    names = [r["kpi"] for r in breach_rows.where("breached").orderBy("kpi").collect()]  # four rows at most
    whole = "avg_main_weighted_input_per_turn"
    values = [float(rounded(k[c], 0 if c == whole else 4)) if k[c] is not None else None for c in LABELS]
    return kpi_row.sparkSession.createDataFrame([(at, *values, names)], SNAPSHOTS)


def append_snapshot(spark: SparkSession, path: str, row: DataFrame, keep: int = KEEP) -> DataFrame:
    """Adds a snapshot to those kept and drops the oldest beyond `keep`; the table is replaced by a rename."""
    new = f"{path.rstrip('/')}.new"
    fs, p = file_system(spark, path)
    if not exists(spark, path) and exists(spark, f"{new}/_SUCCESS"):  # lost between both steps of a replacement
        fs.rename(file_system(spark, new)[1], p)
    held = spark.read.schema(row.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], row.schema)
    usage.retained(held.unionByName(row), keep).coalesce(1).write.mode("overwrite").parquet(new)
    fs.delete(p, True)
    fs.rename(file_system(spark, new)[1], p)
    return spark.read.schema(row.schema).parquet(path)


def _shown(kpi: str, value: float | None) -> str:
    if value is None:
        return "n/a"
    return f"{rounded(value):,}" if kpi == "avg_main_weighted_input_per_turn" else f"{value:.1%}"


def markdown(kpis: dict, breaches: list, top: list, before: dict | None, now: str, days: int) -> str:
    """The page, from single rows: KPIs with their bounds and the change since the snapshot before, the dearest groups and what is in breach."""
    lines = ["# Usage", "", f"As of {now}, {days} days.", "", "| KPI | value | bound | |", "|---|---|---|---|"]
    for r in breaches:
        old, new = (before or {}).get(r["kpi"]), r["value"]
        change = "" if old is None or new is None else " (=)" if new == old else f" ({'up' if new > old else 'down'} {_shown(r['kpi'], abs(new - old))})"
        lines.append(f"| {LABELS[r['kpi']]} | {_shown(r['kpi'], new)}{change} | {_shown(r['kpi'], r['bound'])} | {'breach' if r['breached'] else 'fine'} |")
    lines += ["", f"{kpis['task_dispatches']} tasks dispatched, {kpis['mechanical_dispatches']} of them mechanical.", "", "| model | role | calls | uncached input | cache read | output | cost |", "|---|---|---|---|---|---|---|"]
    for r in top:
        fresh = max(r["in_tok"] - r["cr_tok"] - r["cw_tok"], 0)
        lines.append(f"| {r['model']} | {r['role']} | {r['calls']:,} | {fresh:,} | {r['cr_tok']:,} | {r['out_tok']:,} | {r['aiu']:,} |")
    names = [LABELS[r["kpi"]] for r in breaches if r["breached"]]
    return "\n".join([*lines, "", "In breach: " + (", ".join(names) or "none") + ".", ""])


def publish(spark: SparkSession, events: DataFrame, lines: DataFrame, folder: str, as_of: datetime, days: int | None = None, targets: usage.Targets = usage.Targets()) -> list[str]:
    """Writes report.md and the snapshots to a folder; returns the KPIs in breach."""
    rolled = usage.rollup(events, usage.cutoff_date(as_of, days, targets))
    row = usage.kpis(rolled, usage.dispatches(lines), targets)
    found = usage.breaches(row, targets)
    at = as_of.isoformat(timespec="seconds")
    path = f"{folder.rstrip('/')}/snapshots"
    old = spark.read.schema(SNAPSHOTS).parquet(path).where(F.col("at") < at).orderBy(F.desc("at")).first() if exists(spark, path) else None
    append_snapshot(spark, path, snapshot(row, found, at))
    rows = {r["kpi"]: r for r in found.collect()}
    page = markdown(row.first().asDict(), [rows[k] for k in LABELS], usage.top_usage(rolled, TOP).collect(), old and old.asDict(), at, days or targets.window_days)
    sinks.write_text(f"{folder.rstrip('/')}/report.md", page)
    return [k for k in LABELS if rows[k]["breached"]]
