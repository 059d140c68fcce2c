"""F3 to F23: whole rows were shuffled to number the items of a drawing."""

import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SMALL, rows

from revlens.plans import demo
from revlens.plans.oracle import query
from revlens.session import Scratch


def _odd(folder, every: int):
    """The smallest tables with each ``every``-th row twice, ties decided by price, and fields that two numbers do not hold."""
    lines = pq.read_table(f"{SMALL}/lineitem.parquet")
    out = []
    for i, row in enumerate(lines.to_pylist()):
        if i % 11 == 0:
            row["l_linenumber"] = -row["l_linenumber"]
        if i % 13 == 0:
            row["l_quantity"] = 70000.0 + i % 3
        if i % 5 == 0:
            row["l_quantity"] += 0.25
        if i % 17 == 0:
            row["l_discount"] = None
        out.append(row)
        if every and i % every == 0:
            out.append(row | {"l_quantity": row["l_quantity"] + 0.125 * (i % 2), "l_extendedprice": row["l_extendedprice"] + (i % 5 - 2.5), "l_discount": 0.01 * (i % 9)})
    pq.write_table(pa.Table.from_pylist(out[::-1], schema=lines.schema), folder / "lineitem.parquet")
    shutil.copy(f"{SMALL}/part.parquet", folder / "part.parquet")
    return str(folder)


@pytest.mark.parametrize("every", [0, 7])
def test_odd_rows_are_numbered_like_sql(spark, tmp_path, every):
    folder = _odd(tmp_path, every)
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    assert rows(demo.items(spark, folder)) == rows(con.sql(query("SELECT * FROM items")))


def test_items_are_dealt_out_by_two_numbers(spark, monkeypatch, tmp_path):
    folder = tmp_path / "in"
    folder.symlink_to(SMALL)
    plans = []
    save_by = Scratch.save_by
    monkeypatch.setattr(Scratch, "save_by", lambda self, frame, *rest: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or save_by(self, frame, *rest))
    demo.items(spark, str(folder))
    assert len(plans) == 1
    assert plans[0].count("Exchange hashpartitioning") == 1
    assert "l_extendedprice" not in plans[0] and "l_shipdate" not in plans[0]
