"""What the plans of queries over tiles have no need of: further shuffles, windows, lists, JSON, joins."""

from __future__ import annotations

from pathlib import Path

import pytest

from quarry.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables are not here")

#: Query, a word of its plan, and how often it may come.
PLANS = (
    ("empty_layers", "REPARTITION_BY_NUM", 1),  # F12
    ("layer_counts", "to_json", 0),  # F4
    ("layer_by_name", "Window", 0),  # F5
    ("columnar_roundtrip_lines", "collect_list", 0),  # F7
    ("type_filter", "Join", 0),  # F8
    ("tile_size_report", "REPARTITION_BY_NUM", 1),  # F9
    ("scan_count_find", "collect_list", 0),  # F11
    ("feature_by_index", "REPARTITION_BY_NUM", 1),  # F15
    ("layer_shapes", "Window", 0),  # F17
    ("bbox_default", "to_json", 0),  # F19
    ("columnar_roundtrip_3d", "collect_list", 0),  # F20
)


@pytest.mark.parametrize("name, word, most", PLANS)
def test_plan(spark, name, word, most):
    plan = registry.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert plan.count(word) + (plan.count("structstojson") + plan.count("StructsToJson") if word == "to_json" else 0) <= most


@pytest.mark.parametrize("name", ["bbox_default", "type_filter"])  # F19
def test_only_keys_are_shuffled(spark, name):
    plan = registry.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    above, shuffled = plan.split("Exchange ")
    assert "array(" in above and "Sort " in above.splitlines()[-2]
    assert "array(" not in shuffled and "struct" not in shuffled.split("ReadSchema")[0]
