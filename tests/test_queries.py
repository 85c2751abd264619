"""Every query with SQL against DuckDB; the stream against its batch twin."""

import glob
import os

import duckdb
import pytest

from tidewatch.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_stream_equals_batch(spark):
    got = {(r.key, r.ts, r.due) for r in catalogue.QUERIES["s01_stateful_recheck"](spark, DATA).collect()}
    rows = sorted((str(r.user_id), r.ts, "FAILED" if r.event_type == "error" else "NO_MATCH") for r in spark.read.parquet(f"{DATA}/events.parquet").collect())
    want, last = set(), {}
    for key, ts, status in rows:
        at, old = last.get(key, (None, None))
        due = at is None or (ts - at).total_seconds() >= 60 * {"FAILED": 120, "NO_MATCH": 1440}[old]
        if due:
            last[key] = (ts, status)
        want.add((key, ts, due))
    assert got == want
