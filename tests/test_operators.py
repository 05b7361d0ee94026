"""Small cases of single operators: edges, nulls, ties, planted patterns."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from txloom import schemas, scratch
from txloom.functions import scalars
from txloom.operators import aggregates, joins, predicates, rows
from txloom.plans import flagship
from txloom.sources import readers, sinks
from txloom.streaming import jobs

TX = "ts_text string, from_bank string, from_account string, to_bank string, to_account string, amount_paid decimal(18,4), payment_currency string, payment_format string"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("operator", "value", "rule", "kept"), [("igual", "USD", "USD", True), ("igual", "EUR", "USD", False), ("menor", "30", "50", True), ("menor", "60", "50", False), ("menor", "x", "50", False), ("menor", "abc", "b", True), ("entre", "2022/09/05 10:00", "2022/09/01,2022/09/05", True), ("entre", "2022/09/06 00:00", "2022/09/01,2022/09/05", False), ("en", "ACH", "Wire, ACH", True), ("en", "Cash", "Wire, ACH", False), ("EN", "Wire", "Wire", True), ("igual", None, "USD", False)])
def test_predicates(spark, operator, value, rule, kept):
    df = spark.createDataFrame([(value,)], "f string")
    assert df.where(predicates.predicate(df, operator, "f", rule)).count() == kept


def test_predicate_edges(spark):
    df = spark.createDataFrame([("2022/09/01 00:00",)], "f string")
    # the value is cut to the shorter limit, the limits are not
    assert predicates.keep(df, ("entre", "f", "2022/09/01 00:00,2022/09")).count() == 0
    assert predicates.keep(df, ("igual", "absent", "1")).count() == 0
    with pytest.raises(ValueError, match="unknown operator"):
        predicates.predicate(df, "like", "f", "x")
    with pytest.raises(ValueError, match="two limits"):
        predicates.predicate(df, "entre", "f", "1,2,3")


TEXTS = ["", "2", "2022/08/31 23:59", "2022/09", "2022/09/01", "2022/09/01 00:00", "2022/09/05 23:59", "2022/09/06", "2022/10", "~", None]


@pytest.mark.parametrize("limits", ["2022/09/01,2022/09/05", "2022/09/01 00:00,2022/09", "2022/09,2022/09/05", ",2022/09/05", "2022/09/01,", ",", "b,a", f"a,{chr(0x10FFFF)}"])
def test_ranges_are_those_of_cut_texts(spark, limits):
    low, high = limits.split(",")
    n = min(len(low), len(high))
    df = spark.createDataFrame([(t,) for t in TEXTS], "f string")
    want = sorted(t for t in TEXTS if t is not None and low <= t[:n] <= high)
    assert sorted(r.f for r in predicates.keep(df, ("entre", "f", limits)).collect()) == want


@pytest.mark.parametrize(("kind", "values"), [("decimal(6,2)", ["49.99", "50.00", "50.01", "9999.99", None]), ("int", [49, 50, 51, -5, None]), ("double", [49.5, 50.0, float("nan"), None]), ("string", ["49", "x", " 7", None])])
@pytest.mark.parametrize("bound", ["50", "50.001", "-1e9", "1e12", "inf", "nan"])
def test_less_than_a_number(spark, kind, values, bound):
    import decimal

    made = [(decimal.Decimal(v) if v is not None and kind.startswith("dec") else v,) for v in values]
    df = spark.createDataFrame(made, f"f {kind}")

    def under(v):
        try:
            return float(v) < float(bound)
        except (TypeError, ValueError):
            return False

    assert predicates.keep(df, ("menor", "f", bound)).count() == sum(under(v) for v in values)
    assert [r[0] for r in df.select(predicates.predicate(df, "menor", "f", bound)).collect()] == [under(v) for v in values]


def test_members_and_equals_of_numbers(spark):
    df = spark.createDataFrame([(7,), (70,), (None,)], "f bigint")
    count = lambda *rule: predicates.keep(df, rule).count()
    assert [count("igual", "f", x) for x in ("7", "07", "7.0", "x")] == [1, 0, 0, 0]
    assert [count("en", "f", x) for x in ("7, 70", "07", "x, 70")] == [2, 0, 1]


def test_predicates_reach_the_scan(spark):
    path = scratch.folder(spark, "pushed")
    spark.createDataFrame([("2022/09/01 00:00", "1", "A", "1", "B", 5, "US Dollar", "Wire")], TX.replace("decimal(18,4)", "int")).write.parquet(path)
    t = spark.read.parquet(path)
    t = t.withColumn("amount_paid", F.col("amount_paid").cast("decimal(18,4)"))
    t.write.parquet(path + "-tx")
    t = spark.read.parquet(path + "-tx")

    def pushed(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PushedFilters: ") :].split("]")[0] + plan.split("ReadSchema")[-1]

    rules = {("igual", "payment_format", "Wire"): "EqualTo(payment_format,Wire)", ("menor", "amount_paid", "50"): "LessThan(amount_paid,50.0000)", ("en", "payment_format", "Wire, ACH"): "In(payment_format, [ACH,Wire"}
    for rule, want in rules.items():
        assert want in pushed(predicates.keep(t, rule)).replace("[Wire,ACH", "[ACH,Wire"), pushed(predicates.keep(t, rule))
    days = pushed(predicates.keep(t, ("entre", "ts_text", "2022/09/01,2022/09/05")))
    assert "GreaterThanOrEqual(ts_text,2022/09/01)" in days and "LessThan(ts_text,2022/09/06)" in days
    for found in (flagship.small_transfers(t), flagship.scatter_gather(t, "2022/09/01,2022/09/05"), flagship.largest_by_bank(t, spark.createDataFrame([("b", "1")], "bank_name string, bank_id string"))):
        assert "EqualTo(payment_currency,US Dollar)" in pushed(found)
    assert "is_laundering" not in pushed(flagship.small_transfers(t)) and "ts_text" not in pushed(flagship.small_transfers(t))


def test_projection(spark):
    df = spark.createDataFrame([("c1", "42", "no-number"), ("c1", "007", None)], "client_id string, a string, b string")
    out = rows.project(df, ["b", "a", "absent"], int_fields=("a", "b"))
    assert out.columns == ["b", "a", "client_id"]
    assert sorted((r.a, r.b) for r in out.collect()) == [("42", "no-number"), ("7", None)]
    assert rows.project(df, ["absent"]).columns == ["client_id"]


@pytest.mark.parametrize(("value", "digits", "plain"), [("0012", "12", "12"), ("000", "0", "0"), ("", "N/A", "0"), (None, "N/A", None), (" 00AB", "00AB", "AB"), ("7", "7", "7")])
def test_ids(spark, value, digits, plain):
    assert one(spark, value, scalars.digits_id) == digits
    assert one(spark, value, scalars.plain_id) == plain


@pytest.mark.parametrize("n", [3, 4, 7, 1000])
def test_bucket_is_md5_modulo(spark, n):
    keys = ["", "a", "bank|12", "ñ"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(scalars.md5_bucket(F.col("k"), n)).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(k.encode()).hexdigest(), 16) % n + 1 for k in keys]


def test_scalars(spark):
    assert one(spark, "2022/09/01 10:00", scalars.day) == dt.date(2022, 9, 1)
    assert one(spark, "never", scalars.day) is None
    assert one(spark, "Shekel", scalars.iso_code) == "ILS"
    assert one(spark, "Shilling", scalars.iso_code) is None
    assert one(spark, "a:b:c:d", scalars.session_of) == "b"
    assert one(spark, "a", scalars.session_of) is None
    assert one(spark, "results_q12.csv", scalars.query_number) == 12
    assert one(spark, "none", scalars.query_number) is None
    assert [one(spark, x, lambda c: scalars.cents(c.cast("decimal(10,3)"))) for x in ("0.125", "0.135", "1.005")] == [12, 14, 100]
    usd = spark.createDataFrame([(5.0, "USD", None), (5.0, "EUR", 2.0), (5.0, "EUR", 0.0), (5.0, "EUR", None)], "a double, i string, r double").select(scalars.in_usd(F.col("a"), F.col("i"), F.col("r"))).collect()
    assert [r[0] for r in usd] == [5.0, 2.5, None, None]


def test_distinct_values(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "x"), ("B", "x"), (None, None), (None, "z")], "g string, v string")
    get = lambda *a, **k: sorted(tuple(r) for r in aggregates.distinct_values(df, ["g"], ["v"], *a, **k).collect())
    assert get(2, "eq") == [("", 2), ("A", 2)]
    assert get(1, "gt") == [("", 2), ("A", 2)]
    assert get(1, "gte") == [("", 2), ("A", 2), ("B", 1)]
    assert get(2, "eq", explode=True) == [("", ""), ("", "z"), ("A", "x"), ("A", "y")]


def test_largest_breaks_ties(spark):
    df = spark.createDataFrame([("b1", 5, "t2", "z"), ("b1", 5, "t1", "y"), ("b2", 0, "t1", "x"), ("b3", None, "t1", "w")], "bank string, amount int, ts text, acct string".replace("text", "string"))
    got = {r.bank: r for r in aggregates.largest(df, "bank", "amount", "ts", "acct").collect()}
    assert set(got) == {"b1", "b2"} and got["b1"].acct == "y"
    assert aggregates.largest(df, "bank", "amount", "ts", "acct", positive=True).count() == 1


def test_counts(spark):
    empty = spark.createDataFrame([], "client_id string")
    assert aggregates.total_count(empty).first()["count"] == 0
    lines = ['{"client_id":"c","request_id":"r","batches":[{"header":{"schema":["a"],"count":7},"payload":[]},{"header":{"schema":["a","b"]},"payload":[["1"],["2","3","4"]]}]}']
    text = spark.createDataFrame([(x,) for x in lines], "value string")
    parsed = text.select(F.from_json("value", schemas.ENVELOPE).alias("e")).select("e.*")
    assert aggregates.envelope_count(parsed).first()["count"] == 9
    assert [r.record for r in readers.envelope_rows(text).collect()] == [{"a": "1", "b": None}, {"a": "2", "b": "3"}]


def test_bad_envelopes(spark):
    lines = ['{"client_id":"c","request_id":"r","batches":[{"header":{"schema":["a"]},"payload":[["1"]]}]}', "", "  ", "{", "text", '{"client_id":"c","request_id":"r"}', '{"client_id":"c","batches":[{"header":{},"payload":[["1"]]},{"header":{"schema":["a"]},"payload":[["2"]]}]}', '{"client_id":"c","batches":[]}']
    text = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted((r.value[:12], r.reason) for r in readers.bad_envelopes(text).collect()) == sorted([("{", "no envelope"), ("text", "no envelope"), (lines[5][:12], "no batches"), (lines[6][:12], "no column names")])
    assert [r.record["a"] for r in readers.envelope_rows(text).collect() if r.record] == ["1", "2"]


def test_once_by_id_keeps_null_ids(spark):
    df = spark.createDataFrame([(1, "c1", "r1"), (2, "c1", "r1"), (3, "c2", "r1"), (4, "c1", None), (5, "c1", None)], "n int, client_id string, request_id string")
    assert sorted(r.n for r in joins.once_by_id(df, "client_id", "request_id", order=["n"]).collect()) == [1, 3, 4, 5]


def test_fill_is_by_day_row(spark):
    day = lambda n: dt.date(2022, 9, n)
    rates = spark.createDataFrame([(day(2), "EUR", 1.0), (day(2), "JPY", 140.0), (day(4), "EUR", 1.1)], schemas.RATES)
    got = sorted((r.rate_date.day, r.iso, r.rate) for r in joins.filled_rates(rates, "2022-09-01", "2022-09-05").collect())
    assert got == [(2, "EUR", 1.0), (2, "JPY", 140.0), (3, "EUR", 1.0), (3, "JPY", 140.0), (4, "EUR", 1.1), (5, "EUR", 1.1)]


@pytest.mark.parametrize(("fanout", "found"), [(6, 1), (5, 0)])
def test_planted_pattern(spark, fanout, found):
    empty = spark.createDataFrame([], TX)
    planted = rows.plant_scatter_gather(empty, ("1", "A"), ("2", "C"), fanout, "2022/09/01 08:00", 10.0, "US Dollar")
    assert planted.count() == 2 * fanout
    got = sorted((r.ts_text, r.amount_paid, r.payment_format) for r in planted.collect())
    assert got == [(f"2022/09/01 08:{k:02}", 10 + k, rows.PAYMENT_FORMATS[k % fanout % 6]) for k in range(2 * fanout)]
    pairs = flagship.scatter_gather(planted, "2022/09/01,2022/09/05")
    assert pairs.count() == found
    assert flagship.scatter_gather_accounts(pairs).count() == 2 * found
    with pytest.raises(ValueError, match="fanout"):
        rows.plant_scatter_gather(empty, ("1", "A"), ("2", "C"), 1, "2022/09/01 08:00", 10.0, "US Dollar")


def test_self_loops(spark):
    legs = [("A", "A"), *(("A", f"B{k}") for k in range(6)), *((f"B{k}", "C") for k in range(6)), ("A", "C"), ("C", "C")]
    df = spark.createDataFrame([("2022/09/01 00:00", "1", a, "1", b, 1, "US Dollar", "Wire") for a, b in legs], TX.replace("decimal(18,4)", "int"))
    n = lambda **k: {(r.a_account, r.c_account): r.n_between for r in flagship.scatter_gather(df, "2022/09/01,2022/09/05", gather_over=0, **k).collect()}
    assert n(drop_self_loops=True)[("A", "C")] == 6
    assert n()[("A", "C")] == 8  # A-A-C and A-C-C are paths too


@pytest.mark.parametrize("drop", [True, False])
def test_path_counts_are_those_of_the_paths(spark, drop):
    legs = [(a, b) for a in "ABCDE" for b in "ABCDE" if (ord(a) * 7 + ord(b) * 3) % 4]
    e = spark.createDataFrame([("1", a, "1", b) for a, b in legs], joins.EDGE)
    paths = joins.two_hops(e, e, drop)
    for end in "ab":
        want = paths.groupBy(f"{end}_bank", f"{end}_account").agg(F.count("*").alias("n"))
        assert sorted(joins.path_counts(e, e, end, drop).collect()) == sorted(want.collect()) != []


def brute_pairs(legs, scatter_over, gather_over, drop):
    links = set(legs)
    out = {}
    for a in {a for a, _ in links}:
        if sum(x == a for x, _ in links) > scatter_over:
            for x, b in links:
                for y, c in links:
                    if x == a and y == b and a != c and not (drop and (a == b or b == c)):
                        out.setdefault((a, c), set()).add(b)
    return {k: len(v) for k, v in out.items() if len(v) > gather_over}


@pytest.mark.parametrize("drop", [True, False])
@pytest.mark.parametrize(("scatter", "gather"), [(0, 0), (3, 2), (5, 5)])
def test_pruned_pairs_are_all_pairs(spark, drop, scatter, gather):
    import random

    rng = random.Random(scatter)
    legs = [(rng.randrange(25), rng.randrange(25)) for _ in range(170)]
    df = spark.createDataFrame([("1", str(a), "1", str(b)) for a, b in legs], joins.EDGE)
    got = {(int(r.a_account), int(r.c_account)): r.n_between for r in joins.scatter_gather_pairs(df, scatter, gather, drop).collect()}
    assert got == brute_pairs(legs, scatter, gather, drop) and (got or gather == 5)


def test_a_hub_is_joined_in_tiles(spark):
    """A middle account with most edges of both sides: the same paths, and no join key with more of them than a tile."""
    legs = [(f"a{k}", "hub") for k in range(60)] + [("hub", f"c{k}") for k in range(45)] + [(f"a{k}", f"b{k % 5}") for k in range(20)] + [(f"b{k}", "c1") for k in range(5)]
    e = spark.createDataFrame([("1", a, "1", b) for a, b in legs], joins.EDGE)
    want = sorted(map(tuple, joins.two_hops(e, e).collect()))
    assert len(want) == 60 * 45 + 20 and sorted(map(tuple, joins.two_hops(e, e, tile=8).collect())) == want
    met = joins.tiled_hops(e.toDF("a_bank", "a_account", "b_bank", "b_account"), e.toDF("b_bank", "b_account", "c_bank", "c_account"), 8)
    sizes = [r["count"] for r in met.groupBy("b_account", "rows_at", "cols_at").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 4 * 64


def test_usd_without_rate(spark):
    tx = spark.createDataFrame([("2022/09/01 00:00", "1", "A", "1", "B", 0.5, "US Dollar", "Wire"), ("2022/09/01 00:00", "1", "A", "1", "B", 0.5, "Euro", "ACH"), ("2022/09/01 00:00", "1", "A", "1", "B", 0.5, "Doubloon", "ACH")], TX.replace("decimal(18,4)", "double"))
    rates = spark.createDataFrame([(dt.date(2022, 9, 2), "USD", 1.0)], schemas.RATES)
    count = lambda **k: flagship.tiny_transfers(tx, rates, "2022/09/01,2022/09/05", **k).first()["count"]
    assert count() == 0
    assert count(usd_needs_rate=False) == 1


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, t string")
    b = spark.createDataFrame([("x", 1), (None, 2), ("x", 1)], "t string, n int")
    assert joins.differences(a, b).count() == 0
    assert joins.differences(a, b.limit(0)).count() == 2
    with pytest.raises(ValueError, match="columns differ"):
        joins.differences(a, b.drop("n"))
    for buckets in (1, 4096):
        assert sorted(map(tuple, joins.differences(a, b.limit(1), buckets).select("n", "t", "surplus").collect()), key=str) == sorted(map(tuple, joins.differences(a, b.limit(1)).collect()), key=str)
    swapped = spark.createDataFrame([("x", None), (None, "x")], "p string, q string")
    one = spark.createDataFrame([("x", None), ("x", None)], "p string, q string")
    assert sorted((r.p or "", r.surplus) for r in joins.differences(swapped, one).collect()) == [("", 1), ("x", -1)]


def test_comparison_by_client_shuffles_no_rows(spark):
    rows_of = lambda rows: spark.createDataFrame(rows, "client_id string, n int, t string")
    a = rows_of([("same", 1, "x"), ("same", 1, "x"), ("same", 2, None), ("twice", 1, "x"), ("twice", 1, "x"), ("left", 1, "x"), (None, 1, "x"), ("nulls", None, "x")])
    b = rows_of([("same", 2, None), ("same", 1, "x"), ("same", 1, "x"), ("twice", 1, "x"), ("twice", 2, "x"), ("right", 1, "x"), (None, 1, "x"), ("nulls", 1, None)])
    got = joins.compared(a, b, "client_id")
    assert {(r.client_id, r.n_a, r.n_b, r.equal) for r in got.collect()} == {("same", 3, 3, True), ("twice", 2, 2, False), ("left", 1, 0, False), ("right", 0, 1, False), (None, 1, 1, True), ("nulls", 1, 1, False)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Aggregate" in line]
    assert len(exchanged) == 2 and all("[client_id" in line for line in exchanged)


def test_one_client_is_written_again(spark):
    import pathlib

    path = scratch.folder(spark, "clients")
    at = pathlib.Path(path.removeprefix("file://"))
    files = lambda: {p.relative_to(at): p.stat().st_mtime_ns for p in at.rglob("part-*")}
    sinks.write_results(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "client_id string, n int"), path)
    before = files()
    again = spark.createDataFrame([("b", 9)], "client_id string, n int")
    sinks.write_results(again, path)
    sinks.write_client(again, path, "c d")
    after = files()
    assert {k: v for k, v in after.items() if "client_id=a" in str(k)} == {k: v for k, v in before.items() if "client_id=a" in str(k)} != {}
    read = lambda: sorted((r.client_id, r.n) for r in spark.read.option("header", True).schema("n int, client_id string").csv(path).collect())
    assert read() == [("a", 1), ("b", 9)]
    assert [r.value for r in spark.read.text(f"{path}/client_id=c d").collect()] == ["n"]


@pytest.mark.parametrize("limits", ["2022/09/02,2022/09/03", "2022/09/02 12:00,2022/09/03 11:00", "2022/08,2022/09/02", "2022/09/03,2022/09", ",2022/09/02"])
def test_a_period_reads_its_own_folders(spark, limits):
    times = [f"2022/{m:02}/{d:02} {h:02}:00" for m in (8, 9) for d in (1, 2, 3, 4) for h in (0, 11, 12, 23)]
    t = spark.createDataFrame([(x, "A", str(k)) for k, x in enumerate(times)], "ts_text string, from_account string, to_account string")
    want = sorted(r.ts_text for r in predicates.keep(t, ("entre", "ts_text", limits)).collect())
    for letters in (7, 10):
        path = scratch.folder(spark, "periods")
        sinks.write_by_period(t, path, letters)
        found = readers.read_period(spark, path, limits)
        assert sorted(r.ts_text for r in found.collect()) == want
        if letters == 10 and limits.startswith("2022/09/02,"):
            assert len({f.split("period=")[1][:10] for f in found.inputFiles()}) >= 2
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [" in plan and "period" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_ranks_of_wide_tables(spark):
    """Every rank right: columns beside the key, ties, nulls, a hot key, several partitions, names of the operator's own."""
    wide = [(k % 7 if k % 3 else 0, None if k % 50 == 0 else (k * 7919) % 997, f"text {k}", k, {"k": k}) for k in range(5000)]
    df = spark.createDataFrame(wide, "hot int, v int, part string, row int, place map<string,int>").repartition(8)
    got = rows.with_rank(df, "hot", "v").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r.hot, r.v) for r in got] == sorted(((h, v) for h, v, *_ in wide), key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    assert {r.row for r in got} == set(range(5000)) and all(r.part == f"text {r.row}" and r.place["k"] == r.row for r in got)
    sample = rows.systematic_sample(df, 12.5, "v", "row")
    assert sample.columns == df.columns
    order = sorted(range(5000), key=lambda k: (-1 if wide[k][1] is None else wide[k][1], k))
    assert sorted(r.row for r in sample.collect()) == sorted(k for i, k in enumerate(order, 1) if int(i * 0.125) > int((i - 1) * 0.125))
    assert {r.row for r in rows.head_sample(df, 10, "v", "row").collect()} == set(order[:500])
    assert rows.with_rank(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError, match="choose another name"):
        rows.with_rank(df, "v", name="row")


def test_no_task_ranks_a_hot_key_alone(spark):
    df = spark.range(40_000).select(F.lit(1).alias("k"), "id")
    sizes = [r.n for r in rows.ranked(df, "k").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 20_000


def test_samples(spark):
    df = spark.range(1000).toDF("n")
    assert rows.systematic_sample(df, 30, "n").count() == 300
    assert rows.head_sample(df, 12.5, "n").count() == 125
    assert 150 < rows.hash_sample(df, 20, "n").count() < 250
    assert 100 < rows.bernoulli_sample(df, 20, 7).count() < 300


def test_csv(spark):
    path = scratch.folder(spark, "csv")
    header = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
    lines = [header, "2022/09/01 00:10,010,8000,020,9000,5.5,US Dollar,5.5,US Dollar,Wire,0", "2022/09/01 00:11,010,8000"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted(readers.read_transactions(spark, path).collect())
    assert [(r.from_account, r.to_account, r.amount_paid) for r in got] == [("8000", "9000", "5.5"), ("8000", None, None)]
    assert readers.read_with_header(spark, path).columns[4] == "Account.1"
    assert schemas.unique_headers(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    with pytest.raises(ValueError, match="missing: rate"):
        schemas.require(spark.range(1), "id", "rate")
    out = scratch.folder(spark, "out")
    sinks.write_results(spark.createDataFrame([], "client_id string, n int"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ["client_id,n"]


def test_names_that_clash(spark):
    df = spark.createDataFrame([("c", "a:s1:x", "007", 1), ("c", None, "7", 2)], "client_id string, request_id string, bank_key string, n int").withColumn("session", F.lit("mine"))
    left = joins.without_cancelled(df, spark.createDataFrame([("c", "s1")], "client_id string, session string"))
    assert [(r.session, r.n) for r in left.collect()] == [("mine", 2)]
    named = joins.with_bank_name(df, spark.createDataFrame([("7", "Seven")], "bank_id string, bank_name string"), "bank_key")
    assert sorted((r.bank_key, r.bank_name) for r in named.collect()) == [("007", "Seven"), ("7", "Seven")]
    assert {(r.n, r.n_source) for r in joins.found_in(df, df, "bank_key").collect()} == {(1, 1), (2, 1)}
    for call in (lambda: joins.with_bank_name(named, named, "bank_key"), lambda: rows.split_cases(df, "session", [("a", "b", "c")], name="n")):
        with pytest.raises(ValueError, match="already has"):
            call()


def test_header_lines_split_on_every_comma(spark):
    path = scratch.folder(spark, "quoted")
    spark.createDataFrame([('a,a',), ('"x,y"',)], "value string").coalesce(1).write.text(path)
    assert [tuple(r) for r in readers.read_with_header(spark, path).collect()] == [('"x', 'y"')]


def test_folders_need_a_shared_one_on_a_cluster():
    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.folder(Cluster, "x")


def test_silence(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([("a", at(1)), ("a", at(9)), ("b", at(11))], "e string, ts timestamp")
    roster = spark.createDataFrame([("a",), ("b",), ("c",)], "e string")
    got = {r.e: r.silent_s for r in joins.silent(events, roster, "e", "2024-01-01 12:00:00", 7200).collect()}
    assert got == {"a": 10800, "c": None}
    assert [(r.e, r.alerts) for r in joins.gaps(events, "e", 7200).collect()] == [("a", 3)]


def test_streams_end_as_batches(spark, sf_dir):
    stream = readers.event_stream(spark, sf_dir)
    batch = readers.requests(spark, sf_dir)
    want = {r.client_id: r["count"] for r in aggregates.total_count(batch, "client_id").collect()}
    assert {r.client_id: r["count"] for r in jobs.count_by_client(stream).collect()} == want
    twice = readers.event_stream(spark, sf_dir)
    doubled = jobs.once(twice.unionByName(readers.event_stream(spark, sf_dir)), ["event_id"])
    assert doubled.count() == batch.select("event_id").distinct().count()
    at = dt.datetime(2024, 1, 1)
    path = scratch.folder(spark, "replays")
    kind = "client_id string, request_id string, ts timestamp"
    spark.createDataFrame([("c1", "r1", at), ("c1", "r1", at), ("c2", "r1", at), ("c1", None, at), ("c1", None, at), (None, "r1", at), (None, "r1", at)], kind).write.parquet(path)
    left = jobs.once(spark.readStream.schema(kind).parquet(path), ["client_id", "request_id"])
    assert sorted((str(r.client_id), str(r.request_id)) for r in left.collect()) == [("None", "r1"), ("None", "r1"), ("c1", "None"), ("c1", "None"), ("c1", "r1"), ("c2", "r1")]
    assert jobs.windowed_counts(readers.event_stream(spark, sf_dir), "1 day", "1 hour").agg(F.sum("n")).first()[0] == batch.count()


@pytest.mark.parametrize("own", [None, "32m"])
def test_joins_of_transfers_are_in_small_pieces(spark, sf_dir, own):
    """A task's memory goes by the size to which partitions are merged; a size that the session has set stays."""
    key = readers.PIECE[0]
    spark.conf.unset(key)
    try:
        if own:
            spark.conf.set(key, own)
        readers.transactions(spark, sf_dir)
        assert spark.conf.get(key) == (own or "16m")
    finally:
        spark.conf.unset(key)


def test_large_orders_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Files far smaller than their rows don't make Spark broadcast them, and shuffle partitions grow with the files."""
    path = scratch.folder(spark, "orders")
    n = 400_000
    wide = [f"'x' AS pad{k}" for k in range(8)]
    spark.range(n).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "TIMESTAMP '1996-05-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority", *wide).coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.range(n).selectExpr("id AS l_orderkey", "id % 7 AS l_partkey", "1.0 AS l_extendedprice", "0.5 AS l_discount", "'N' AS l_returnflag", *wide).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    monkeypatch.setattr(readers, "FILES", 1 << 18, raising=False)
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        found = readers.transactions(spark, path).select("from_account", "to_account")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert int(spark.conf.get(first)) > 4 and found.count() == n
        spark.conf.set(first, "5000")
        readers.transactions(spark, path)
        assert spark.conf.get(first) == "5000"
    finally:
        spark.conf.unset(first)
        spark.conf.unset(readers.PIECE[0])


def test_triples_by_edges_distinct_by_account(spark):
    """As distinct paths give them, with accounts at several banks on every place and nulls."""
    rng = random.Random(5)
    side = lambda: (rng.choice(["1", "2", "2", None]), rng.choice([*"ABCDE", None]))
    e = spark.createDataFrame([(*side(), *side()) for _ in range(90)], ", ".join(f"{c} string" for c in joins.EDGE)).distinct()
    first = joins.scatter_edges(e, 2).select(*joins.EDGE)
    names = ["a_account", "b_account", "c_account"]
    want = sorted(map(repr, joins.two_hops(first, e, drop_self_loops=False).select(*names).distinct().collect()))
    found = joins.account_triples(first, e)
    assert len(want) > 20 and sorted(map(repr, found.collect())) == want
    # accounts at one bank: no shuffle by all three, but for the branch of those at several
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(a_account#\d+, b_account#\d+, c_account#\d+", plan)) == 1 and "Union" in plan


def test_paths_are_counted_where_their_first_account_is(spark):
    """Paths leave no shuffle as rows; hubs, accounts with many paths and odd bank names come out right, in as many tasks as there are paths for."""
    rng = random.Random(6)
    name = lambda k: (["1", "1:", "", "12"][k % 4], f":{k}")
    pairs = {(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(300)) if a != b} | {(0, k) for k in range(1, 25)} | {(k, 1) for k in range(2, 25)}
    e = spark.createDataFrame([(*name(a), *name(b)) for a, b in sorted(pairs)], ", ".join(f"{c} string" for c in joins.EDGE))
    want = {}
    for a, b in pairs:
        for c in (y for x, y in pairs if x == b and y != a):
            want[name(a) + name(c)] = want.get(name(a) + name(c), 0) + 1
    want = {k: n for k, n in want.items() if n > 2}
    found = joins.pair_counts(e, e, 2, tile=4, paths=100, share=20)
    assert want and {tuple(r)[:4]: r.n_between for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    wide = int(re.search(r"hashpartitioning\(a#\d+, cut#\d+, (\d+)\)", plan)[1])
    assert wide >= 10 and "hashpartitioning(a#" in plan and not re.search(r"hashpartitioning\(a#\d+, cut#\d+, c#", plan)


def test_receivers_are_not_sent_to_all_tasks(spark):
    """Receivers are joined where both sides are shuffled to, however small their files, and accounts with many edges are looked up without a shuffle; a sender's count has its loop and unknown receivers."""
    legs = [(f"a{k}", f"b{m}") for k in range(3) for m in range(4)] + [(f"b{m}", "c") for m in range(4)] + [("x", "x"), ("x", None)] + [("x", f"b{m}") for m in range(3)]
    e = spark.createDataFrame([("1", a, "1", b) for a, b in legs], ", ".join(f"{c} string" for c in joins.EDGE))
    found = joins.scatter_gather_pairs(e, 3, 2, written=True)
    # x sends to five with its loop and the unknown one, so it stays, over three of them
    assert sorted((r.a_account, r.c_account, r.n_between) for r in found.collect()) == [("a0", "c", 4), ("a1", "c", 4), ("a2", "c", 4), ("x", "c", 3)]
    assert joins.scatter_gather_pairs(e, 4, 2, written=True).collect()[0].a_account == "x"
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert re.search(r"SortMergeJoin \[b#\d+, rows_at#\d+, cols_at#\d+\]", plan)
    # legs by middle account, receivers by it, paths by sender
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3
