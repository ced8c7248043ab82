import duckdb
import pytest

from quillstream.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    return "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in got.collect()]
    if name not in catalogue.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name]).fetch_df().astype(object)
    want = want.where(want.notna(), None).to_dict("records")
    assert sorted(got.columns) == sorted(want[0] if want else got.columns)
    flat = lambda rs: sorted([text(r[c]) for c in sorted(r)] for r in rs)
    assert flat(rows) == flat(want)
