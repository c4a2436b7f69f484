"""The queries of the subpackage on the smallest tables, against SQL where there is some."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from glyphweir.llm.queries import QUERIES, SQL

COLUMNS = {"p2_found": ["kind", "low_id", "high_id"], "p4_found": ["low_id", "high_id"], "p5_found": ["field", "term", "mark"], "p6_found": ["kind", "low_item", "high_item"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    columns = sorted(df.columns)
    got = Counter(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name.endswith("_found"):
        assert not got or max(got.values()) == 1
    if name in SQL:
        con = duckdb.connect()
        for path in Path(small).iterdir():
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'").fetchall()
        rel = con.sql(SQL[name])
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert got == Counter(tuple(str(r[i]) for i in order) for r in rel.fetchall())
