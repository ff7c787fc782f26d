"""Queries that SQL can express against their SQL; the registry; import without the subpackage."""

import os
import subprocess
import sys

import pytest

import oracle
from ferrule.llm import queries

SF = "/root/testdata/sf0.001"


def test_ten_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLES[name]) is None


def test_entry_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("ferrule", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(root, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "ferrule" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(k.startswith('op') for k in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
