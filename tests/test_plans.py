"""Plan hygiene of every registered query: no operator that cannot scale out."""

import contextlib
import io

import pytest

from conftest import SF_SMALL
from flowlure.plans import catalog, files

QUERIES = catalog.QUERIES | files.QUERIES
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "SinglePartition")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_scales_out(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[name](spark, SF_SMALL).explain("formatted")
    plan = buf.getvalue()
    found = [op for op in FORBIDDEN if op in plan]
    assert not found, found
    if name.startswith("strategy_sweep"):
        assert "FlatMapGroupsInPandas" in plan  # the one grouped pandas step, Arrow-batched
    else:
        assert "Python" not in plan
