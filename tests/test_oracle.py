"""Registered queries against DuckDB on the smallest tables: one of every family."""

import pytest
from conftest import SMALL, rows

from revlens.plans import catalog
from revlens.session import Scratch, settings

NAMES = [
    *(f"P{i}_" for i in range(1, 12)), *(f"G{i}_" for i in (1, 3, 5, 7, 8, 10, 12, 13, 17)), "S3_", "S4_", "S5_", "S7_", "S9_", "A2_", "A8_", "B1_", "F11_", "F13_", "J2_", "J3_", "J5_", "J10_", "J11_", "W3_", "I2_", "I3_", "M1a_", "M11_", "W1_", "B2_", "V0_", "C_", "K4_",
]


@pytest.mark.parametrize("prefix", NAMES)
def test_query_matches_sql(spark, duck, prefix):
    name = next(n for n in catalog.queries() if n.startswith(prefix))
    assert rows(catalog.queries()[name](spark, SMALL)) == rows(duck.sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", ["I1_greedy_assign", "C11_reasons", "C10_added", "E1_evidence_builder"])
def test_chain_matches_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SMALL)) == rows(duck.sql(catalog.oracle_sql()[name]))


def test_flagship_has_all_five_statuses(spark):
    got = {r["status"]: r["n"] for r in catalog.flagship(spark, SMALL).collect()}
    assert set(got) == {"unchanged", "changed", "removed", "uncertain", "added"}


def test_every_query_has_sql_but_pixel_measures():
    missing = set(catalog.queries()) - set(catalog.oracle_sql())
    assert missing == {"V4_otsu_binarize", "V5_largest_contour", "V8_crop_pixels"}


def test_chain_writes_two_narrow_tables_and_shuffles_nothing_else(spark, monkeypatch, tmp_path):
    """F1 to F24: the steps between were written and shuffled whole."""
    folder = tmp_path / "in"
    folder.symlink_to(SMALL)
    made = []
    save_by, save = Scratch.save_by, Scratch.save
    monkeypatch.setattr(Scratch, "save_by", lambda self, frame, name, *by: made.append(name) or save_by(self, frame, name, *by), raising=False)
    monkeypatch.setattr(Scratch, "save", lambda self, frame, name: made.append(name) or save(self, frame, name))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for name in ("J4_radius_candidates", "M11_reasons", "W2_edge_order", "I1_greedy_assign", "A12_coverage_metrics", "U6_key_difference", "U1_union_items", "J8_item_anchor", "P12_output_projection"):
            plan = catalog.queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, name
    assert made == ["items", "taken"]


def test_drawings_with_many_rows_are_assigned_in_rounds(spark, monkeypatch, tmp_path):
    folder = tmp_path / "in"
    folder.symlink_to(SMALL)
    monkeypatch.setattr(catalog.assignment, "FOLD_EDGES", 20)
    name = "I1_greedy_assign"
    assert rows(catalog.queries()[name](spark, str(folder))) == rows(catalog.queries()[name](spark, SMALL))


@pytest.mark.parametrize("name, scans", [("C9_scores_map", 2), ("A11_status_counts", 5), ("W2_edge_order", 10), ("E1_evidence_builder", 28)])
def test_chain_reads_no_step_twice(spark, name, scans):
    """joins back to a step computed it again, with all steps below it."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans


def test_anchors_without_spans_near_stay(spark):
    linked = spark.createDataFrame([(1, 1, 0, "R5", 1, 0.0, 0.0, 9.0, 9.0), (1, 2, 7, "R6", 2, 0.0, 0.0, 9.0, 9.0)], "drawing_id long, char_no int, page int, requirement string, row_ord int, bx0 double, by0 double, bx1 double, by1 double")
    spans = spark.createDataFrame([(1, 5, "R5", 0.0, 0.0, 9.0, 9.0, 0)], "drawing_id long, span_ord int, text string, x0 double, y0 double, x1 double, y1 double, block_id int").withColumns({"x1": catalog.F.lit(9.0)})
    far = spark.createDataFrame([(1, 6, "end", 900.0, 900.0, 999.0, 999.0, 0)], spans.schema)
    got = catalog.anchors.with_contexts(catalog.anchors.with_center(catalog.anchors.with_best(linked, spans.unionByName(far))), spans).orderBy("char_no").collect()
    assert [(r["char_no"], r["req_ord"], r["context_words"], r["n_context"]) for r in got] == [(1, 5, ["R5"], 1), (2, None, [], 0)]
