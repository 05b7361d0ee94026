"""The registered queries: names, columns, whole tables, and SQL where there is some."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from txloom.llm import queries as registered

COLUMNS = {
    "op1": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3": {"doc_id": "bigint", "item_id": "bigint"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6": {"doc_id": "bigint", "paragraph": "int", "family": "string"},
    "op7": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op11": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op12": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op13": {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}, "base_sha256": "string", "spans": "string"},
}
WHOLE = {"op1": "documents", "op2": "embeddings", "op4": "documents", "op8": "documents", "op9": "documents", "op10": "pages", "op13": "documents"}


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *registered.queries()} <= names
    assert sorted(n.split("_")[0] for n in registered.queries()) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sf_dir, name):
    op = name.split("_")[0]
    got = registered.queries()[name](spark, sf_dir).persist()
    assert COLUMNS[op].items() <= dict(got.dtypes).items()
    if op in WHOLE:
        assert got.count() == spark.read.parquet(f"{sf_dir}/{WHOLE[op]}.parquet").count()
    if op == "op5":
        lengths = got.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
        assert lengths["s"] <= -(-lengths["n"] // 2048) + 2
    if op in ("op6", "op13"):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_contamination_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(registered.oracle_sql()["op3_decontamination"])
    got = registered.queries()["op3_decontamination"](spark, sf_dir)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) != []
