"""F4 to F22: anchors were computed once for their pairs and once more to be joined with what was assigned."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from revlens.functions import geometry as G
from revlens.operators import assignment, candidates
from revlens.plans.catalog import Chain
from revlens.session import Scratch, settings


def test_anchors_are_computed_once(spark, monkeypatch, tmp_path):
    folder = tmp_path / "in"
    folder.symlink_to(SMALL)
    plans = {}
    save_by = Scratch.save_by
    monkeypatch.setattr(Scratch, "save_by", lambda self, frame, name, *by: plans.update({name: frame._jdf.queryExecution().executedPlan().toString()}) or save_by(self, frame, name, *by))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        Chain(spark, str(folder)).taken()
    assert plans["taken"].count("FileScan parquet") <= 10
    assert plans["taken"].count("SortMergeJoin") <= 9
    assert "Exchange" not in plans["taken"]


def test_anchors_without_an_edge_stay(spark):
    """Anchor 1 and 2 want the same span, 3 has none in reach, 4 is alone in its drawing."""
    edges = spark.createDataFrame(
        [(1, 1, 1, 1, 0.5, 7), (1, 1, 1, 2, 0.1, 8), (1, 2, 2, 1, 0.9, 7), (1, 3, 3, 1, None, None), (2, 4, 1, 1, None, None)],
        "drawing_id long, char_no int, anchor_ord int, cand_rank int, total_score double, span_ord int",
    ).withColumns({c: F.col("span_ord").cast("double") for c in assignment.SPAN_KEY})
    got = assignment.greedy_anchors(edges, ("anchor_ord",), ("span_ord",)).orderBy("drawing_id", "char_no").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 8), (1, 2, 2, 7), (1, 3, 3, None), (2, 4, 1, None)]


@pytest.mark.parametrize("how, found", [("inner", [(1, 5)]), ("left", [(1, 5), (2, None)])])
def test_anchors_out_of_reach_stay_if_asked(spark, how, found):
    """The second anchor shares a cell with the span, but is farther than the radius."""
    anchors = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 280.0, 280.0)], "drawing_id long, char_no int, px double, py double")
    spans = spark.createDataFrame([(1, 5, 0.0, 0.0, 20.0, 20.0)], "drawing_id long, span_ord int, x0 double, y0 double, x1 double, y1 double")
    near = candidates.within_radius(anchors, spans, spans, how).orderBy("char_no")
    assert [(r["char_no"], r["span_ord"]) for r in near.collect()] == found
    assert set(G.CORNERS) <= set(near.columns)


def test_overlap_counts_the_union(spark):
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), (None, ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(candidates.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0, 0.0, 0.0, 1.0]
