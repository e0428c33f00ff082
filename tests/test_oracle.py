"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from mileglass.plans.registry import all_oracles, all_queries
from tests import oracle

QUERIES, ORACLES = all_queries(), all_oracles()
SLOW = {"fit_baseline"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = oracle.spark_result(QUERIES[name](spark, sf_dir))
    assert oracle.difference(got, oracle.duck_result(duck, ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_only_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == SLOW
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).limit(1).count() == 1
    assert QUERIES.keys() <= e.queries().keys()
    assert ORACLES.items() <= e.oracle_sql().items()
    assert e.oracle_sql().keys() <= e.queries().keys()


@pytest.mark.parametrize("missing", ["mileglass.llm", "corpus_pipeline", "xxhash"])
def test_entry_without_text_operators(monkeypatch, missing):
    import sys

    import __spark_entry__ as e
    for name in [m for m in sys.modules if m.startswith(("mileglass.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert QUERIES.keys() <= e.queries().keys() and ORACLES.items() <= e.oracle_sql().items()
