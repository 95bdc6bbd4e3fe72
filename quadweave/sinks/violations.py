"""Tables of violations with what is known of the run beside them: CSV folders, or a workbook of two sheets."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from quadweave.plans.shapes import PARTS, VALUE_COMPONENTS, Rule
from quadweave.sinks.xlsx import write_workbook

#: Conditions that a run checks.
CHECKED = {*VALUE_COMPONENTS, *PARTS, "minCount", "maxCount", "hasValue", "class", "range", "equals", "disjoint", "lessThan", "lessThanOrEquals", "closed"}


def coverage(rules: list[Rule], skipped: list[str] = ()) -> dict[str, object]:
    """How many shapes and conditions rules have, what texts had besides that are no rules, and conditions that no run checks."""
    return {
        "node_shapes": len({r.shape for r in rules}),
        "constraints": len(rules),
        "skipped_shapes": sorted(set(skipped)),
        "unknown_components": sorted({r.component for r in rules} - CHECKED),
        "profiles": sorted({r.profile for r in rules if r.profile}),
    }


def run_metadata(spark: SparkSession, rules: list[Rule], skipped: list[str] = (), started: datetime | None = None, **more: object) -> DataFrame:
    """(KEY, VALUE) of a run: its coverage, when it was, and whatever else is given; lists are a row for each item."""
    now = datetime.now(timezone.utc)
    facts: dict[str, object] = coverage(rules, skipped) | {"generated_at": now.isoformat(timespec="seconds")}
    if started is not None:
        facts |= {"started_at": started.isoformat(timespec="seconds"), "duration_seconds": round((now - started).total_seconds(), 3)}
    rows = [(key, str(v)) for key, value in (facts | more).items() for v in (value if isinstance(value, (list, tuple)) else [value])]
    return spark.createDataFrame(rows, "KEY string, VALUE string")


def write_violations(violations: DataFrame, folder: str, meta: DataFrame | None = None) -> None:
    """CSV parts in a folder, and what is known of the run in `<folder>_meta`."""
    violations.write.csv(folder, header=True, escape='"')
    if meta is not None:
        meta.coalesce(1).write.csv(f"{folder.rstrip('/')}_meta", header=True, escape='"')


def violations_workbook(violations: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """A workbook with the sheets violations and metadata."""
    write_workbook({"violations": violations} | ({"metadata": meta} if meta is not None else {}), path)
