import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from colloquy.session import session

    home = tmp_path_factory.mktemp("spark")
    s = session("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.checkpoint.dir": f"file://{home}/shared",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same(spark, got, sql, tables):
    """Whether a DataFrame holds the rows that DuckDB gives for ``sql`` over pandas tables or Parquet paths."""
    import duckdb

    con = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, str):
            con.execute(f"create view {name} as select * from read_parquet('{t}')")
        else:
            con.register(name, t)
    cols = sorted(got.columns)

    def norm(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19].replace("T00:00:00", "")
        return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)

    want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql}) q").fetchall()
    rows = [tuple(r) for r in got.select(*cols).collect()]
    a, b = (sorted(tuple(map(norm, r)) for r in x) for x in (rows, want))
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]
    return len(a)
