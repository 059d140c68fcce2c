import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from revlens.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(SMALL).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def rows(frame_or_relation):
    """Rows as sorted tuples of columns in name order, doubles rounded."""
    pdf = frame_or_relation.toPandas() if hasattr(frame_or_relation, "toPandas") else frame_or_relation.df()
    cols = sorted(pdf.columns)

    def plain(v):
        if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and v.dtype.kind in "iuf" else str(v)

    return cols, sorted(tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False))
