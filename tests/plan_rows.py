"""How many rows the scans of a plan hand on."""

from __future__ import annotations


def rows_read(frame, column):
    """Rows that scans of files with this column hand on, after the frame has run."""
    total = 0
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan") and f"{column}#" in node.output().toString():
            total += node.metrics().apply("numOutputRows").value()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total
