"""Every query of the subpackage on the smallest tables, against SQL where there is one."""

import sys
from importlib import import_module
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracles import check  # noqa: E402

MODULES = [import_module(f"loomstone.llm.{m}_queries") for m in ("langid", "clusters", "cooccurrence", "termfreq", "canonical", "encoding", "packing", "mixing", "toxicity")]
QUERIES = [(n, m) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize(("name", "module"), QUERIES, ids=[n for n, _ in QUERIES])
def test_query(name, module, spark, small):
    sql = getattr(module, "ORACLES", {}).get(name)
    if sql:
        check(module.QUERIES[name], sql, spark, small)
    else:
        rows = module.QUERIES[name](spark, small).collect()
        assert len(rows) == len({str(r) for r in rows})


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    """The tables without rows."""
    at = tmp_path_factory.mktemp("empty")
    for f in Path(small).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(str(at / f.name))
    return str(at)


@pytest.mark.parametrize(("name", "module"), QUERIES, ids=[n for n, _ in QUERIES])
def test_empty_tables(name, module, spark, empty):
    rows = module.QUERIES[name](spark, empty).collect()
    assert not rows or name == "p9_shares"
