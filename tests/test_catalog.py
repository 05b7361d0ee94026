"""Every registered query of the library against its SQL on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from txloom import registry
from txloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(row, order):
    return tuple(repr(round(row[i], 9)) if isinstance(row[i], float) else str(row[i]) for i in order)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    mine, theirs = (sorted(range(len(c)), key=lambda i: c[i]) for c in (got.columns, want.columns))
    assert sorted(shown(r, mine) for r in got.collect()) == sorted(shown(r, theirs) for r in want.fetchall())


def test_envelope_lines_are_made_once(spark, sf_dir, monkeypatch):
    """Lines whose text is another each time they are made, as after a shuffle: no row is lost or comes twice."""
    made = catalog.envelopes
    again = F.regexp_replace("value", '"request_id":"', F.concat(F.lit('"request_id":"'), F.reflect(F.lit("java.util.UUID"), F.lit("randomUUID"))))
    monkeypatch.setattr(catalog, "envelopes", lambda s, d: made(s, d).select(again.alias("value")))
    out = registry.queries()["S7_stream"](spark, sf_dir).where("client_id <> 'bad'")
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert (out.count(), out.select("event_id").distinct().count()) == (n, n)
