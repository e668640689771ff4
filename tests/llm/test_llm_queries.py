"""The queries of the subpackage agree with SQL where they have any, on the smallest tables."""

import pytest
from compare import compare, duck

from tessera.llm import queries as Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    if name in Q.ORACLES:
        assert compare(spark, duck(D), name, Q.QUERIES[name], Q.ORACLES[name], D) is None
    else:
        assert Q.QUERIES[name](spark, D).count() >= 0


def test_found_columns(spark):
    want = {
        "p5_found": [("table_name", "string"), ("branch", "bigint"), ("nationkey", "bigint"), ("row_key", "bigint")],
        "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p8_found": [("mix_id", "string"), ("source", "string")],
        "p9_found": [("doc_id", "bigint"), ("subject", "string")],
    }
    for name, cols in want.items():
        assert Q.QUERIES[name](spark, D).dtypes == cols
