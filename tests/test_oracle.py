"""A representative subset of queries against their DuckDB twins (the full set runs in tools/oracle_check.py)."""

import os

import pytest

from conftest import SF_SMALL

SUBSET = ["site_audit_rich", "page_keywords_rich", "zone_text", "page_analysis", "site_ml_result",
          "recommendations", "generate_all", "page_injected", "site_report"]


def names():
    """The subset, or every query with a twin if SITELENS_FULL_ORACLE is set."""
    if not os.environ.get("SITELENS_FULL_ORACLE"):
        return SUBSET
    from sitelens.plans.queries import ORACLE

    return sorted(ORACLE)


@pytest.mark.parametrize("name", names())
def test_matches_duckdb(spark, name):
    import __spark_entry__ as E
    from tools.oracle_check import check, duck_con

    info = check(spark, duck_con(SF_SMALL), name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert info["status"] == "OK", info
