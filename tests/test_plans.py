"""Plans that must hold without broadcasts: no table is scanned more often than the query names it, plus once."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from checks import REGISTRY
from tests.compare import spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# How often each query names a table, at most.
NAMED = {"group_share": 4, "group_count_two_keys": 4, "clean_reports": 5, "cross_dup_remove": 2, "inner_join_spots": 1, "outer_union": 2}


@pytest.mark.parametrize("name", sorted(NAMED))
def test_scans_do_not_multiply(spark, no_broadcast, name):
    result = REGISTRY[name].query(spark, FOLDER)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    scans = Counter(tuple(sorted(set(re.findall(r"\w+(?=#)", line)))) for line in plan.split("\n") if "Relation [" in line)
    assert scans and max(scans.values()) <= 2 * NAMED[name], scans
    expected = spark_rows(result)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert spark_rows(REGISTRY[name].query(spark, FOLDER)) == expected


def test_no_cross_join_without_broadcasts(spark, no_broadcast):
    for name in NAMED:
        plan = REGISTRY[name].query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
