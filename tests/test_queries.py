import pytest

from trailguard.plans.queries import ORACLE_SQL, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_gzip_finds_what_the_plain_search_finds_in_literal_bodies(spark, sf_dir):
    found = {(r["session_id"], r["n"]) for r in QUERIES["gzip_overlap"](spark, sf_dir).collect()}
    plain = {(r["session_id"], r["n"]) for r in QUERIES["overlap_first_hit"](spark, sf_dir).where("match_form = 'literal'").collect()}
    assert found == plain


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
