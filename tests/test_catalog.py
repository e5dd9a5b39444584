import os
import subprocess
import sys

import pytest
from oracles import connect, oracle_rows, rows_of

from conftest import DATA
from telemill.plans import catalog

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, FOLDER)) == oracle_rows(duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_simulation_is_reproducible(spark):
    q = catalog.QUERIES["simulate_ideal_seeded"]
    assert rows_of(q(spark, FOLDER)) == rows_of(q(spark, FOLDER))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_llm_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('telemill.llm') or name == 'corpus_pipeline': raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) >= 40 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
