"""Spark queries against their SQL twins on the smallest tables.

QUIRE_TWINS=all runs every query; by default one quick module is checked, and
``tools/check_twins.py`` covers all of them at any scale.
"""

import os
import sys
from importlib import import_module
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check_twins import TABLES, compare  # noqa: E402

from quire.plans.registry import MODULES, all_queries  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
CHOSEN = MODULES if os.environ.get("QUIRE_TWINS") == "all" else ["maintenance_queries"]
CASES = [(n, q) for m in CHOSEN for n, q in import_module(f"quire.plans.{m}").registry.entries.items() if q[1]]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name, query", CASES, ids=[c[0] for c in CASES])
def test_twin(spark, duck, name, query):
    message, _ = compare(query[0](spark, str(FOLDER)), duck, query[1])
    assert message == ""


def test_every_query_has_a_name_of_its_own():
    assert len(all_queries()) > 120
