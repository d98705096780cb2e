"""Every query of the training-data operators that has SQL, against it, on the driver's smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from plumbline.llm import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_the_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, str(DATA))
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = Counter(tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    assert Counter(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want
