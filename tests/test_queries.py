"""Every core query against its SQL on the smallest tables."""

from importlib import import_module

import pytest
from oracles import check

MODULES = [import_module(f"loomstone.plans.{m}_queries") for m in ("packed", "browse", "retrieval", "sequence", "grouping", "assembly", "ontology", "streaming")]
WITH_SQL = [(n, m) for m in MODULES for n in getattr(m, "ORACLES", {})]
WITHOUT = [(n, m) for m in MODULES for n in m.QUERIES if n not in getattr(m, "ORACLES", {})]


@pytest.mark.parametrize(("name", "module"), WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_equals_sql(name, module, spark, small):
    check(module.QUERIES[name], module.ORACLES[name], spark, small)


@pytest.mark.parametrize(("name", "module"), WITHOUT, ids=[n for n, _ in WITHOUT])
def test_runs(name, module, spark, small):
    assert module.QUERIES[name](spark, small).toPandas() is not None


def test_entry_registers_all_and_runs(spark, small):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n for m in MODULES for n in m.QUERIES} <= names
    assert set(e.oracle_sql()) <= names
    assert e.entry(spark).columns == ["id", "title", "url", "source_path"]
