"""Every query of the core with SQL agrees with it on the smallest tables; the others give rows."""

import importlib

import pytest
from compare import compare, duck

D = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"tessera.plans.{m}") for m in ("tpch", "relational", "scalars", "sql_text", "changes", "extras", "retrieval", "data_quality")]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    return duck(D)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, name, QUERIES[name], ORACLES[name], D) is None
    else:
        assert QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_hides_no_error(tmp_path):
    """Without the subpackage its queries are left out; an error inside it comes out."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'p1_found' in e.queries(), 'p9_found' in e.queries())"]
    assert subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True).stdout.split()[1:] == ["True", "False"]
    (tmp_path / "tessera" / "llm").mkdir()
    (tmp_path / "tessera" / "llm" / "__init__.py").touch()
    (tmp_path / "tessera" / "llm" / "queries.py").write_text("import a_module_that_is_not_there")
    assert "a_module_that_is_not_there" in subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True).stderr


def test_core_does_not_need_llm():
    """Nothing outside the subpackage names it, but for the entry, which tries to import it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "tessera"
    named = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "tessera.llm" in p.read_text()]
    assert not named


def test_plans(spark):
    """Filters and columns reach the scan; the top rows of groups are cut before the shuffle."""
    from tessera.sources.catalog import explain

    q6 = explain(QUERIES["tpch_q6"](spark, D))
    assert "PushedFilters: [IsNotNull" in q6 and "l_orderkey" not in q6
    assert "WindowGroupLimit" in explain(QUERIES["topk_per_group_api"](spark, D))
    assert "CartesianProduct" not in explain(QUERIES["tpch_q5"](spark, D))
