"""Region to channel: the join, regions that route nowhere, and the JSON forms of the map."""

from __future__ import annotations

import pytest

from acct_health.operators.routing import route, route_counts
from acct_health.params import parse_region_map, region_dim, region_dim_from_json

DESKS = {"NORTH": "desk-1", "SOUTH": "desk-2", "": "nobody", "VOID": None}


def _routed(spark, regions):
    df = spark.createDataFrame([(f"acc{i}", r) for i, r in enumerate(regions)], "account_id string, account_region string")
    return route(df, region_dim(spark, DESKS), len(DESKS))


@pytest.mark.parametrize("region, channel", [("NORTH", "desk-1"), ("SOUTH", "desk-2"), ("south", None), ("EAST", None), ("VOID", None), ("", None), (None, None)])
def test_each_kind_of_region(spark, region, channel):
    r = _routed(spark, [region]).first()
    assert (r["channel"], r["routable"], r["reason"]) == (channel, channel is not None, None if channel else "unknown_region")


def test_counts(spark):
    c = route_counts(_routed(spark, ["NORTH", None, "EAST", "SOUTH", "NORTH"])).first()
    assert (c["at_risk_count"], c["unknown_region_count"]) == (5, 2)


@pytest.mark.parametrize("text, expected", [
    ('{"NORTH": "x", "SOUTH": "y"}', {"NORTH": "x", "SOUTH": "y"}), ('{"regions": {"NORTH": "z"}, "SOUTH": "y"}', {"NORTH": "z"}),
    ('{"regions": null, "NORTH": "x"}', {}), ('{"regions": 3}', {}), ("[1, 2]", {}), ("{}", {})])
def test_json_forms_agree(spark, text, expected):
    assert parse_region_map(text) == expected
    dim = region_dim_from_json(spark, spark.createDataFrame([(text,)], "region_json string"))
    assert {r["account_region"]: r["channel"] for r in dim.collect()} == expected


def test_unset_map_is_the_default():
    assert parse_region_map(None) == parse_region_map("") and "AMER" in parse_region_map(None)
