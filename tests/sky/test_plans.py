"""Shapes of physical plans that have to hold at any size."""

import os

import pytest

from skyquilt import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(spark, name):
    return catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["code_range_join", "nearest_within_radius", "mutual_match", "cones_of_nations", "separation_pairs", "objects_in_field"])
def test_range_joins_are_equi_joins(spark, name):
    p = plan(spark, name)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_one_shuffle_a_tile_and_none_a_position(spark):
    import re

    count = lambda name: len(re.findall(r"Exchange hashpartitioning", plan(spark, name)))
    assert count("constellation_first_match") == 0
    assert plan(spark, "pyramid_levels_3").count("FileScan") == 0  # levels are read from their cuts
    # the pixels' own aggregation and the tiles, for the tiles and for the floor of their image, and that join
    assert count("tile_background") <= 5


def test_top_k_is_pruned_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "pyramid_level0") and "WindowGroupLimit" in plan(spark, "top_stars")


def test_scans_read_what_they_need(spark):
    p = plan(spark, "pyramid_level0")
    assert "o_orderdate" not in p and "o_orderpriority" not in p
    p = plan(spark, "search_statistics")
    assert "props" not in p


def test_no_python_in_expression_queries(spark):
    for name in ("wcs_pixels", "verify_fold", "tile_background", "constellation_first_match", "result_json"):
        p = plan(spark, name)
        assert "Python" not in p and "Pandas" not in p and "Arrow" not in p


def test_no_array_goes_through_the_join_of_solutions(spark):
    """Equal outlines compress in a shuffle, so that its partitions look small, but a sort holds them in full."""
    nodes, joins = [catalog.QUERIES["describe_solutions"](spark, DATA)._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joins += 1
            assert not any('"array"' in b.schema().json() for b in below)
        nodes += below
    assert joins == 1
