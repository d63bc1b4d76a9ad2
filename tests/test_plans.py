"""What the plans look like: shuffles, pruned columns, no row-wise Python, no cartesian products."""

import re

import pytest

from isobar.plans.catalog import QUERIES

#: Shuffles that a query needs at most, broadcasts apart.
SHUFFLES = {
    "track_summary": 1, "track_kinematics": 1, "hourly_interpolation": 1, "box_crossing": 1, "extremes_with_ties": 1, "filter_mean": 1, "laplacian": 1, "local_minima": 1, "box_smooth": 1,
    "components": 1, "uptake_grid_percent": 3, "presence_composite": 4, "in_out_split": 4, "monthly_means": 3,
}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert len(re.findall(r"\bExchange (?:hash|range|Single)", text)) <= SHUFFLES[name], text
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_scans_are_pruned(spark, data):
    text = plan(QUERIES["track_precipitation"](spark, data))
    assert "props" not in re.search(r"ReadSchema: (.*)", text)[1]
    text = plan(QUERIES["storm_extract"](spark, data))
    assert "EqualTo(user_id,3)" in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
