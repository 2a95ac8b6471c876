"""How much a query has read, from the metrics of the plan that ran."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ReadReport:
    """Rows and bytes that the scans gave, and files they opened. Rows are bounded by pages and row groups, not exact."""

    rows: int
    bytes: int
    files: int
    scans: int

    def fraction(self, total_rows: int) -> float:
        return self.rows / total_rows if total_rows else 0.0


def _scans(plan):
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if name in ("FileSourceScanExec", "BatchScanExec"):
            yield node
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))


def collect_with_report(df: DataFrame) -> tuple[list, ReadReport]:
    """The rows of ``df``, which should be few, and what reading them took."""
    rows = df.collect()
    found = {"numOutputRows": 0, "filesSize": 0, "numFiles": 0}
    scans = 0
    for scan in _scans(df._jdf.queryExecution().executedPlan()):
        scans += 1
        metrics = scan.metrics()
        for name in found:
            if metrics.contains(name):
                found[name] += metrics.apply(name).value()
    return rows, ReadReport(found["numOutputRows"], found["filesSize"], found["numFiles"], scans)
