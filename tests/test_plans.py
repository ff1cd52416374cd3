"""What is broadcast: never a table that was exploded, which the optimizer takes for as small as its source."""

import pytest

from skytile.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def exploded_broadcasts(df) -> list[str]:
    """The broadcasts of a plan with an explode below them."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        for below in lines[i + 1 :]:
            if depth(below) <= depth(line):
                break
            if "Generate explode" in below:
                found.append(line.strip())
                break
    return found


@pytest.mark.parametrize("name", ["c1_tile_boxes", "c7_covered_share", "c8_fully_inside", "c2_without_rejected", "i7_tile_to_scene", "d17_parent_box", "c3_not_inside_rejected"])
def test_exploded_tables_are_not_broadcast(spark, name):
    assert exploded_broadcasts(QUERIES[name](spark, SF)) == []


def test_nearest_boxes_meet_by_shuffle(spark):
    plan = QUERIES["c16_nearest_box"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "level" in line for line in plan.split("\n"))


@pytest.mark.parametrize("name", ["d6_confusion", "d7_confusion_shares"])
def test_matches_are_made_once(spark, monkeypatch, name):
    """Four tables read them; the pairs' join is not planned for each."""
    from skytile.operators import evaluate

    stores = []
    monkeypatch.setattr(evaluate, "stored", lambda df, name="t", own=evaluate.stored: stores.append(name) or own(df, name))
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert stores == ["matches"] and "Generate explode" not in plan
