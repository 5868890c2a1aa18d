from __future__ import annotations

import pytest

queries = pytest.importorskip("skytide.llm.queries")


@pytest.mark.parametrize(
    "name,columns",
    [("p8_ids", [("doc_id", "bigint"), ("ids", "array<int>")]), ("p9_found", [("doc_id", "bigint"), ("item_id", "bigint")]), ("p10_found", [("doc_id", "bigint")])],
)
def test_columns(spark, name, columns):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.dtypes == columns and df.count() >= 0
