"""The whole check: two workload results against one starting state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from driftline.operators.compare import compare_captures, comparison_summary
from driftline.operators.netchange import net_records
from driftline.operators.state import snapshot_net
from driftline.session import materialize


@dataclass(frozen=True)
class TableStates:
    """One table before the workload and after each of its two versions."""

    name: str
    keys: list[str]
    before: DataFrame
    baseline: DataFrame
    candidate: DataFrame
    ordinal: Column
    start_lsn: Column


def capture_side(tables: list[TableStates], side: str) -> DataFrame:
    """Net changes of all tables of one side as one capture."""
    union = None
    for t in tables:
        after = t.baseline if side == "baseline" else t.candidate
        net = snapshot_net(t.before, after, t.keys, t.name, t.start_lsn)
        records = net_records(net, t.keys, t.ordinal)
        union = records if union is None else union.unionByName(records)
    return union


def run_regression(tables: list[TableStates], ignore_fields=(), ignore_lsn: bool = True) -> tuple[DataFrame, DataFrame]:
    """(failures, summary) of the candidate's changes against the baseline's.

    Both captures and the failures are written once; the summary reads them.
    """
    baseline = materialize(capture_side(tables, "baseline"), "regression-baseline")
    candidate = materialize(capture_side(tables, "candidate"), "regression-candidate")
    failures = compare_captures(baseline, candidate, ignore_fields, ignore_lsn, unique_keys=True)
    failures = materialize(failures, "regression-failures")
    return failures, comparison_summary(baseline, candidate, failures)
