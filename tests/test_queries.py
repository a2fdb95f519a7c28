"""Every registered query against its SQL check on the smallest tables."""

import duckdb
import pytest

import check_oracles as check
from vozlake.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


# their JSON text or file bytes differ between engines; unit tests cover them
UNCHECKED = {"evidence_payload", "payload_size", "source_fingerprint"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    good, message = check.compare(spark, connection, name, FOLDER, QUERIES[name], ORACLES.get(name))
    assert good or (good is None and name in UNCHECKED), message


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["rank", "topic", "frequency", "percentage", "cumulative_percentage", "within_80_percent"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
