"""What the physical plans of the registered queries must not hold."""

import re

import pytest

from weftframe.plans import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # Python runs on Arrow batches, never row by row
    assert "BatchEvalPython" not in plan
    # a window over one partition would hold the whole table
    windows = re.search(r"\bWindow\b[^\n]*\n(?:[^\n]*\b(?:Sort|Project)\b[^\n]*\n)*[^\n]*Exchange SinglePartition", plan)
    assert windows is None
    # nothing is gathered in one partition but partial aggregates and first rows
    for gathered in re.finditer(r"Exchange SinglePartition[^\n]*\n([^\n]*)", plan):
        assert re.search("Aggregate|LocalLimit", gathered.group(1)), gathered.group(1)
