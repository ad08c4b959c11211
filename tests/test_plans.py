"""What the plans must look like whatever the data's size."""

import os
import re

import pytest

from victual.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"streaming_daily_totals"}))
def test_no_python_and_no_pairs(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct|NestedLoop", text)


@pytest.mark.parametrize("name", ["weekly_budget_summary", "week_nutrition", "last_seven_days", "meal_totals"])
def test_dates_reach_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan(spark, name))


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "weekly_budget_summary")
    assert "props" not in text and "p_brand" not in text and "c_acctbal" not in text


@pytest.mark.parametrize("name", ["recent_foods", "frequent_foods"])
def test_rank_limits_come_before_the_shuffle(spark, name):
    assert plan(spark, name).count("WindowGroupLimit") == 2


def test_changes_over_days_need_one_shuffle(spark):
    assert plan(spark, "weight_change_7d").count("Exchange hashpartitioning") == 1
