"""Every registered query against its SQL counterpart, on the smallest of the driver's data sets."""

import importlib.util
from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data")

ROOT = Path(__file__).resolve().parent.parent
_spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
ENTRY = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(ENTRY)
# The training-data queries have tests of their own.
QUERIES, ORACLES = ENTRY.sample_queries.QUERIES, ENTRY.sample_oracles.ORACLES


#: Learned scores are beyond SQL; `test_learning` holds them against plain solvers.
LEARNED = {"quality_model", "learning_to_rank"}


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def in_order(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() - ORACLES.keys() == LEARNED and ORACLES.keys() <= QUERIES.keys()
    assert QUERIES.keys() <= ENTRY.queries().keys() and ORACLES.keys() <= ENTRY.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(LEARNED))
def test_learned_scores_cover_all_items(spark, database, name):
    rows = QUERIES[name](spark, str(FOLDER)).collect()
    items = {str(i) for i, in database.sql("SELECT doc_id FROM documents").fetchall()}
    assert {r.item_id for r in rows} == items and len(rows) == len(items)
    assert all(0 < r.probability < 1 for r in rows) if name == "quality_model" else len({r.learned_score for r in rows}) > 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, database, name):
    result = QUERIES[name](spark, str(FOLDER))
    expected = database.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert in_order(map(tuple, result.collect()), result.columns) == in_order(expected.fetchall(), columns)


def test_entry(spark):
    rows = ENTRY.entry(spark).collect()
    assert rows and all(1 <= r.pick <= 8 for r in rows)
