"""Every registered query next to its SQL on the smallest data set."""

import check
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in ORACLE:
        error, _ = check.compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
        assert error is None, error
    else:
        assert QUERIES[name](spark, sf_dir).toArrow().num_rows >= 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["qid", "chunk_id", "top_k", "filter_active", "target_sections", "distance", "rank"]
    assert out.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
