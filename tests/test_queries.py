"""Every query with SQL against DuckDB, the others for their size and repeatability."""

import os
import subprocess
import sys

import pytest
from compare import connect, spark_rows, sql_rows
from conftest import ROOT

from chronograph import queries
from chronograph.operators import dataset

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", ["link_dataset", "node_embeddings"])
def test_reruns_agree(spark, name):
    first = spark_rows(queries.QUERIES[name](spark, SF))
    assert first[1] and first == spark_rows(queries.QUERIES[name](spark, SF))


def test_every_positive_has_a_negative(spark):
    n, free = 15, {(2, 3), (2, 9), (7, 7), (14, 0)}
    pairs = [(s, t) for s in range(n) for t in range(n) if (s, t) not in free]
    edges = spark.createDataFrame([(i, s, t, float(i)) for i, (s, t) in enumerate(pairs)], "eid long, src long, dst long, ts double")
    rows = dataset.link_dataset(edges).collect()
    label = lambda k: sorted((r["split"], r["eid"]) for r in rows if r["label"] == k)
    assert label(0) == label(1) and {(r["src"], r["dst"]) for r in rows if r["label"] == 0} <= free


def test_entry_point_without_the_removable_parts():
    code = "import sys; sys.modules['chronograph.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_library_does_not_import_llm():
    for f in (ROOT / "chronograph").rglob("*.py"):
        if "llm" not in f.parts:
            assert "chronograph.llm" not in f.read_text(), f
