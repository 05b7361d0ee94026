"""The registered queries: each applies an operator to whole tables; SQL says the same where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom import schemas, scratch
from txloom.functions import scalars
from txloom.operators import aggregates, joins, predicates, rows
from txloom.plans import flagship
from txloom.sources import readers, sinks
from txloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EARLY, LATE = "0000/01/01,1997/12/31", "1998/01/01,9999/12/31"
PERIOD, YEAR = "1995/01/01,2001/12/31", "1996/01/01,1996/12/31"

# Relations that the SQL starts from; they match sources.readers.
WITH = {
    "tx": """tx AS (SELECT strftime(o_orderdate, '%Y/%m/%d %H:%M') AS ts_text, lpad(CAST(o_custkey % 25 AS VARCHAR), 3, '0') AS from_bank, CAST(o_custkey AS VARCHAR) AS from_account, lpad(CAST(l_partkey % 25 AS VARCHAR), 3, '0') AS to_bank, CAST(l_partkey AS VARCHAR) AS to_account, CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(4,2)) AS amount_paid, CASE l_returnflag WHEN 'N' THEN 'US Dollar' WHEN 'A' THEN 'Euro' WHEN 'R' THEN 'Yen' END AS payment_currency, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Wire' WHEN '2' THEN 'ACH' WHEN '3' THEN 'Cheque' WHEN '4' THEN 'Credit Card' WHEN '5' THEN 'Cash' END AS payment_format FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "usd": "usd AS (SELECT * FROM tx WHERE payment_currency = 'US Dollar')",
    "acc": "acc AS (SELECT n_name AS bank_name, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS bank_id FROM nation)",
    "rt": """rt AS (SELECT * FROM (SELECT d AS rate_date, iso, CASE iso WHEN 'USD' THEN CAST(1 AS DOUBLE) WHEN 'EUR' THEN 1 + CAST(dayofyear(d) % 50 AS DOUBLE) / 1000 ELSE CASE WHEN dayofyear(d) % 5 > 0 THEN CAST(100 + dayofyear(d) % 30 AS DOUBLE) END END AS rate FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(o_orderdate) % 7 <> 0) CROSS JOIN (VALUES ('USD'), ('EUR'), ('JPY')) v(iso)) WHERE rate IS NOT NULL)""",
    "rq": """rq AS (SELECT event_id, 'c' || CAST(user_id % 5 AS VARCHAR) AS client_id, CASE WHEN event_id % 11 > 0 THEN 'c' || CAST(user_id % 5 AS VARCHAR) || ':' || CAST(user_id % 17 AS VARCHAR) || ':q1:' || CAST(event_id % 700 AS VARCHAR) END AS request_id, event_type, value, ts, user_id FROM events)""",
    "ids": """ids AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 2 THEN lpad(CAST(event_id AS VARCHAR), 8, '0') WHEN 3 THEN '000' WHEN 4 THEN ' 00AB' WHEN 5 THEN 'x' || CAST(event_id AS VARCHAR) WHEN 6 THEN CAST(event_id AS VARCHAR) || '.5' END AS id FROM events)""",
    "edge": f"edge AS (SELECT DISTINCT from_bank, from_account, to_bank, to_account FROM usd WHERE substr(ts_text, 1, 10) BETWEEN '{PERIOD[:10]}' AND '{PERIOD[11:]}')",
    "big": "big AS (SELECT from_bank, from_account FROM edge GROUP BY from_bank, from_account HAVING count(*) > 5)",
    "path": "path AS (SELECT a.from_bank AS a_bank, a.from_account AS a_account, a.to_bank AS b_bank, a.to_account AS b_account, c.to_bank AS c_bank, c.to_account AS c_account FROM edge a JOIN big USING (from_bank, from_account) JOIN edge c ON a.to_bank = c.from_bank AND a.to_account = c.from_account WHERE NOT (a.from_bank = c.to_bank AND a.from_account = c.to_account))",
}
NEEDS = {"usd": ("tx",), "edge": ("tx", "usd"), "big": ("tx", "usd", "edge"), "path": ("tx", "usd", "edge", "big")}
NO_LOOPS = "NOT (a_bank = b_bank AND a_account = b_account) AND NOT (b_bank = c_bank AND b_account = c_account)"


def over(names: str, select: str) -> str:
    """A statement over the named relations."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    return f"WITH {', '.join(WITH[n] for n in wanted)} {select}" if wanted else select


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that results compare across engines."""
    return df.select(*(F.col(f"`{c}`").cast("double").alias(c) if t.startswith("decimal") else F.col(f"`{c}`").cast("string").alias(c) if t == "date" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def ids(s: SparkSession, d: str) -> DataFrame:
    """Odd identifiers: blank, null, zeros, text."""
    kind = F.col("event_id") % 7
    text = F.col("event_id").cast("string")
    made = F.when(kind == 0, "").when(kind == 2, F.lpad(text, 8, "0")).when(kind == 3, "000").when(kind == 4, " 00AB").when(kind == 5, F.concat(F.lit("x"), text)).when(kind == 6, F.concat(text, F.lit(".5")))
    return readers.read_table(s, d, "events").select("event_id", made.alias("id"))


tx, requests = readers.transactions, readers.requests


def usd(s: SparkSession, d: str) -> DataFrame:
    return flagship.dollars(tx(s, d))


def saved_csv(s: SparkSession, d: str, name: str) -> str:
    """The transactions as a CSV file with the raw headers' columns."""
    path = scratch.folder(s, name)
    t = tx(s, d).withColumn("amount_received", F.col("amount_paid")).withColumn("receiving_currency", F.col("payment_currency")).withColumn("is_laundering", F.lit(0))
    t.select(*schemas.TRANSACTIONS.names).write.option("header", True).csv(path)
    return path


TX_COLUMNS = "from_bank, from_account, to_bank, to_account"
AMOUNT = "CAST(amount_paid AS DOUBLE) AS amount_paid"

# ---- sources and sinks


@query("S1", over("tx", f"SELECT ts_text, {TX_COLUMNS}, {AMOUNT}, payment_currency, payment_format FROM tx"))
def s1(s, d):
    t = readers.read_transactions(s, saved_csv(s, d, "s1"))
    return t.select("ts_text", "from_bank", "from_account", "to_bank", "to_account", scalars.number(F.col("amount_paid")).alias("amount_paid"), "payment_currency", "payment_format")


@query("S2", over("acc", "SELECT bank_name, bank_id, 'A' || bank_id AS account_number FROM acc"))
def s2(s, d):
    path = scratch.folder(s, "s2")
    readers.accounts(s, d).select(*schemas.ACCOUNTS.names).write.option("header", True).csv(path)
    return readers.read_accounts(s, path)


@query("S3", over("tx", 'SELECT from_account AS "Account", to_account AS "Account.1", count(*) AS n FROM tx GROUP BY ALL'))
def s3(s, d):
    path = scratch.folder(s, "s3")
    # a header in each file, with the repeated name; the separator of the writer is not in the lines
    lines = tx(s, d).select(F.concat_ws(",", "from_account", "to_account").alias("Account,Account"))
    lines.write.option("header", True).option("sep", "\x01").csv(path)
    return readers.read_with_header(s, path).groupBy("`Account`", "`Account.1`").agg(F.count("*").alias("n"))


@query("S4", over("tx", f"SELECT from_bank, {AMOUNT} FROM tx WHERE payment_format = 'Wire'"))
def s4(s, d):
    t = readers.read_transactions(s, saved_csv(s, d, "s4"))
    return t.where("payment_format = 'Wire'").select("from_bank", scalars.number(F.col("amount_paid")).alias("amount_paid"))


@query("S5", over("tx", "SELECT from_bank, to_bank, count(*) AS n FROM tx GROUP BY ALL"))
def s5(s, d):
    return readers.read_transactions(s, saved_csv(s, d, "s5")).groupBy("from_bank", "to_bank").agg(F.count("*").alias("n"))


@query("S6", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_returnflag = 'N'")
def s6(s, d):
    return readers.read_table(s, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", F.col("l_linenumber").cast("bigint"))


def envelopes(s, d):
    """Requests as JSON lines of batches of about fifty; every third batch does not announce its count."""
    r = requests(s, d).withColumn("batch", F.floor(F.col("event_id") / 50))
    payload = F.collect_list(F.array(F.col("event_id").cast("string"), "event_type"))
    b = r.groupBy("client_id", "batch").agg(payload.alias("payload"), F.count("*").cast("int").alias("count"))
    header = F.struct(F.array(F.lit("event_id"), F.lit("event_type")).alias("schema"), "client_id", F.when(F.col("batch") % 3 > 0, F.col("count")).alias("count"))
    return b.select(F.to_json(F.struct("client_id", F.concat_ws(":", "client_id", F.col("batch").cast("string")).alias("request_id"), F.array(F.struct(header.alias("header"), "payload")).alias("batches"))).alias("value"))


@query("S7", over("rq", "SELECT client_id, CAST(event_id AS VARCHAR) AS event_id, event_type FROM rq"))
def s7(s, d):
    path = scratch.folder(s, "s7")
    envelopes(s, d).write.text(path)
    r = readers.envelope_rows(s.read.text(path))
    return r.select("client_id", F.col("record")["event_id"].alias("event_id"), F.col("record")["event_type"].alias("event_type"))


@query("S7_stream", over("rq", "SELECT client_id, event_id, event_type FROM (SELECT client_id, CAST(event_id AS VARCHAR) AS event_id, event_type FROM rq UNION ALL SELECT 'bad', 'no envelope', CAST(count(*) AS VARCHAR) FROM events)"))
def s7_stream(s, d):
    """Envelope files as a stream with a stop half-way, bad lines among them: rows and bad lines leave on channels of their own."""
    good = envelopes(s, d)
    bad = readers.read_table(s, d, "events").select(F.concat(F.lit('{"client_id": "c'), F.col("event_id").cast("string")).alias("value"))
    # written once: a line's texts come in the order that the shuffle brings, so a line made twice may fall to both halves or to none
    lines = scratch.saved(good.unionByName(bad), "s7-lines").withColumn("event_id", F.crc32("value"))
    path, places = scratch.folder(s, "s7"), {k: (scratch.folder(s, f"s7-{k}"), scratch.folder(s, f"s7-{k}-table")) for k in ("rows", "bad")}
    for half in (0, 1):
        lines.where(F.col("event_id") % 2 == half).select("value").write.mode("append").text(path)
        stream = readers.envelope_lines(s, path)
        rows_ = jobs.run_to_end(readers.envelope_rows(stream), "append", "s7", *places["rows"])
        wrong = jobs.run_to_end(readers.bad_envelopes(stream), "append", "s7-bad", *places["bad"])
    counted = wrong.groupBy("reason").agg(F.count("*").cast("string").alias("n")).select(F.lit("bad").alias("client_id"), F.col("reason").alias("event_id"), F.col("n").alias("event_type"))
    return rows_.select("client_id", F.col("record")["event_id"].alias("event_id"), F.col("record")["event_type"].alias("event_type")).unionByName(counted)


@query("S8", over("rt", "SELECT strftime(rate_date, '%Y-%m-%d') AS rate_date, iso, rate FROM rt"))
def s8(s, d):
    path = scratch.folder(s, "s8")
    readers.rates(s, d).select(*schemas.RATES.names).write.option("header", True).csv(path)
    return readers.read_rates(s, path)


@query("S9", over("rq", "SELECT client_id, event_type, count(*) AS n FROM rq GROUP BY ALL"))
def s9(s, d):
    path = scratch.folder(s, "s9")
    sinks.write_results(requests(s, d).groupBy("client_id", "event_type").agg(F.count("*").alias("n")), path)
    return s.read.option("header", True).schema("event_type string, n bigint, client_id string").csv(path).select("client_id", "event_type", "n")


@query("S10", "SELECT 'from_bank,amount_paid' AS line, count(*) AS n FROM lineitem WHERE l_discount < 0")
def s10(s, d):
    path = scratch.folder(s, "s10")
    none = tx(s, d).where("amount_paid < 0").select("from_bank", "amount_paid")
    sinks.write_results(none, path)
    n = s.read.option("header", True).schema("from_bank string, amount_paid string").csv(path).agg(F.count("*").alias("n"))
    return s.read.text(path).select(F.col("value").alias("line")).distinct().crossJoin(n)  # a line and a count


@query("S11", over("tx", "SELECT from_bank, CAST(max(amount_paid) AS DOUBLE) AS top FROM tx GROUP BY from_bank"))
def s11(s, d):
    path = scratch.folder(s, "s11")
    sinks.write_table(tx(s, d), path)
    return s.read.parquet(path).groupBy("from_bank").agg(F.max("amount_paid").alias("top"))


@query("S12", over("rq", "SELECT event_id, client_id, event_type FROM rq"))
def s12(s, d):
    return jobs.run_to_end(readers.event_stream(s, d).select("event_id", "client_id", "event_type"), "append", "s12")


# ---- projections, filters, predicates


@query("P1", over("tx", f"SELECT from_bank, {AMOUNT} FROM tx"))
def p1(s, d):
    return rows.project(tx(s, d), ["from_bank", "absent", "amount_paid"])


@query("P2", over("ids", "SELECT event_id, coalesce(CAST(TRY_CAST(CASE WHEN regexp_matches(trim(id), '^[0-9]+$') THEN id END AS BIGINT) AS VARCHAR), id) AS id FROM ids"))
def p2(s, d):
    return rows.project(ids(s, d), ["event_id", "id"], int_fields=("id",))


@query("P3", over("rq", "SELECT event_type, client_id FROM rq"))
def p3(s, d):
    return rows.project(requests(s, d), ["event_type"])


@query("P4", over("tx", "SELECT from_bank AS bank, payment_format AS kind FROM tx"))
def p4(s, d):
    return rows.project(tx(s, d), ["from_bank", "payment_format"], rename={"from_bank": "bank", "payment_format": "kind"})


FILTERS = {
    "F1": ((("igual", "payment_format", "Wire"),), "payment_format = 'Wire'"),
    "F2": ((("menor", "amount_paid", "50"),), "amount_paid < 50"),
    "F3": ((("entre", "ts_text", "1997/03,1998/02/15"),), "substr(ts_text, 1, 7) BETWEEN '1997/03' AND '1998/02/15'"),
    "F4": ((("en", "payment_format", "Wire, ACH"),), "payment_format IN ('Wire', 'ACH')"),
    "F5": ((("ENTRE", "ts_text", "1996/01/01,1996/12/31"), ("Menor", "amount_paid", "500"), ("en", "payment_currency", "Euro,Yen")), "substr(ts_text, 1, 10) BETWEEN '1996/01/01' AND '1996/12/31' AND amount_paid < 500 AND payment_currency IN ('Euro', 'Yen')"),
    "F7": ((flagship.USD,), "payment_currency = 'US Dollar'"),
    "F8": ((flagship.USD, ("entre", "ts_text", YEAR)), "payment_currency = 'US Dollar' AND substr(ts_text, 1, 10) BETWEEN '1996/01/01' AND '1996/12/31'"),
}
for _name, (_rules, _where) in FILTERS.items():
    query(_name, over("tx", f"SELECT ts_text, from_account, to_account, {AMOUNT} FROM tx WHERE {_where}"))(lambda s, d, rules=_rules: predicates.keep(tx(s, d), *rules).select("ts_text", "from_account", "to_account", "amount_paid"))


@query("F8_period", over("tx", f"SELECT ts_text, from_account, to_account, {AMOUNT} FROM tx WHERE {FILTERS['F8'][1]}"))
def f8_period(s, d):
    """The period filter on a table with a folder for each month."""
    path = scratch.folder(s, "f8")
    sinks.write_by_period(tx(s, d), path, 7)
    return flagship.dollars(readers.read_period(s, path, YEAR)).select("ts_text", "from_account", "to_account", "amount_paid")


@query("F6", over("tx", "SELECT count(*) AS count FROM tx WHERE false"))
def f6(s, d):
    return aggregates.total_count(predicates.keep(tx(s, d), ("eq", "no_such_field", "1")))


@query("F9", over("usd", "SELECT from_account, ts_text FROM usd WHERE ts_text >= '1996/01/01' AND ts_text <= '1997/01/01'"))
def f9(s, d):
    return usd(s, d).where("ts_text >= '1996/01/01' AND ts_text <= '1997/01/01'").select("from_account", "ts_text")


@query("F10", over("ids", "SELECT event_id, id FROM ids WHERE id IS NOT NULL"))
def f10(s, d):
    return rows.without_nulls(ids(s, d), "id")


@query("F11", over("tx", "SELECT CASE WHEN substr(ts_text, 1, 10) BETWEEN '1996/01/01' AND '1996/12/31' THEN 'early' ELSE 'late' END AS \"case\", count(*) AS n FROM tx WHERE substr(ts_text, 1, 10) BETWEEN '1996/01/01' AND '1999/06/30' GROUP BY ALL"))
def f11(s, d):
    return rows.split_cases(tx(s, d), "ts_text", [("early", "1996/01/01", "1996/12/31"), ("late", "1996/06/01", "1999/06/30")]).groupBy("case").agg(F.count("*").alias("n"))


@query("F12", over("usd", "SELECT 'n' AS what, CAST(count(*) AS DOUBLE) AS value FROM usd UNION ALL SELECT 'top', CAST(max(amount_paid) AS DOUBLE) FROM usd"))
def f12(s, d):
    one = usd(s, d)
    return one.agg(F.count("*").cast("double").alias("value")).select(F.lit("n").alias("what"), "value").unionByName(one.agg(F.max("amount_paid").cast("double").alias("value")).select(F.lit("top").alias("what"), "value"))


@query("F13", over("edge big", "SELECT edge.* FROM edge JOIN big USING (from_bank, from_account)"))
def f13(s, d):
    return joins.scatter_edges(period_edges(s, d))


def period_edges(s, d):
    return joins.edges(predicates.keep(usd(s, d), ("between", "ts_text", PERIOD)))


# ---- joins


@query("J1", over("usd acc", "SELECT u.from_bank, bank_name, CAST(max(amount_paid) AS DOUBLE) AS top FROM usd u JOIN acc ON u.from_bank = acc.bank_id GROUP BY ALL"))
def j1(s, d):
    best = usd(s, d).groupBy("from_bank").agg(F.max("amount_paid").alias("top"))
    return joins.with_bank_name(best, readers.accounts(s, d)).select("from_bank", "bank_name", "top")


MEAN = "CAST(sum(amount_paid) AS DOUBLE) / count(amount_paid)"


@query("J2", over("tx", f"SELECT from_account, payment_format, {AMOUNT} FROM tx JOIN (SELECT payment_format, {MEAN} AS mean FROM tx WHERE substr(ts_text, 1, 10) <= '1997/12/31' GROUP BY payment_format) USING (payment_format) WHERE substr(ts_text, 1, 10) >= '1998/01/01' AND CAST(amount_paid AS DOUBLE) < mean * 0.01"))
def j2(s, d):
    t = tx(s, d)
    return joins.below_baseline(predicates.keep(t, ("between", "ts_text", LATE)), predicates.keep(t, ("between", "ts_text", EARLY))).select("from_account", "payment_format", "amount_paid")


@query("J3", over("path", "SELECT b_bank, b_account, count(*) AS n FROM path GROUP BY ALL"))
def j3(s, d):
    e = period_edges(s, d)
    return joins.path_counts(joins.scatter_edges(e), e, "b", drop_self_loops=False)


@query("J4", over("edge big", "SELECT edge.* FROM edge JOIN big USING (from_bank, from_account)"))
def j4(s, d):
    e = period_edges(s, d)
    keys = aggregates.having(e, ["from_bank", "from_account"], 5).select("from_bank", "from_account")
    return joins.keyed(e, keys, "from_bank", "from_account", how="inner").select(*joins.EDGE)


@query("J5", over("edge big", "SELECT edge.* FROM edge WHERE (from_bank, from_account) IN (SELECT (from_bank, from_account) FROM big)"))
def j5(s, d):
    e = period_edges(s, d)
    return joins.keyed(e, aggregates.having(e, ["from_bank", "from_account"], 5), "from_bank", "from_account").select(*joins.EDGE)


PRICED = "SELECT tx.*, iso, rate FROM (SELECT *, strptime(substr(ts_text, 1, 10), '%Y/%m/%d')::DATE AS rate_date, CASE payment_currency WHEN 'US Dollar' THEN 'USD' WHEN 'Euro' THEN 'EUR' WHEN 'Yen' THEN 'JPY' END AS iso FROM tx) tx JOIN rt USING (rate_date, iso)"


@query("J6", over("tx rt", f"SELECT from_account, to_account, iso, rate, {AMOUNT} FROM ({PRICED})"))
def j6(s, d):
    return flagship.converted(tx(s, d), readers.rates(s, d)).select("from_account", "to_account", "iso", "rate", "amount_paid")


@query("J7", over("tx", f"SELECT from_account, to_account, mean FROM tx JOIN (SELECT payment_format, {MEAN} AS mean FROM tx WHERE substr(ts_text, 1, 10) <= '1995/01/31' GROUP BY payment_format) USING (payment_format)"))
def j7(s, d):
    t = tx(s, d)
    means = aggregates.mean_by(predicates.keep(t, ("between", "ts_text", "0000/01/01,1995/01/31")), "payment_format", "amount_paid")
    return joins.mapped(t, means, "payment_format", "mean").select("from_account", "to_account", "mean")


@query("J8", over("tx usd", "SELECT u.from_account, u.to_account, (SELECT count(*) FROM tx WHERE tx.from_account = u.from_account AND tx.to_account = u.to_account) AS n_source FROM usd u WHERE amount_paid < 50"))
def j8(s, d):
    found = flagship.small_transfers(tx(s, d)).select("from_account", "to_account")
    return joins.found_in(found, tx(s, d), "from_account", "to_account")


@query("J9", over("path", f"SELECT a_bank, a_account, count(*) AS n FROM path WHERE {NO_LOOPS} GROUP BY ALL"))
def j9(s, d):
    e = period_edges(s, d)
    return joins.path_counts(joins.scatter_edges(e), e, "a")


@query("J10", over("path", "SELECT a_bank, a_account, count(*) AS n FROM path GROUP BY ALL"))
def j10(s, d):
    e = period_edges(s, d)
    return joins.path_counts(joins.scatter_edges(e), e, "a", drop_self_loops=False)


def cancelled(s, d):
    r = requests(s, d).where("event_type = 'error' AND value > 100 AND request_id IS NOT NULL")
    return r.select("client_id", scalars.session_of(F.col("request_id")).alias("session"))


LIVE = "SELECT * FROM (SELECT *, split_part(request_id, ':', 2) AS session FROM rq) r WHERE NOT EXISTS (SELECT 1 FROM (SELECT client_id, split_part(request_id, ':', 2) AS session FROM rq WHERE event_type = 'error' AND value > 100 AND request_id IS NOT NULL) c WHERE c.client_id = r.client_id AND c.session = r.session)"


@query("J11", over("rq", f"SELECT event_id, client_id, request_id FROM ({LIVE})"))
def j11(s, d):
    return joins.without_cancelled(requests(s, d), cancelled(s, d)).select("event_id", "client_id", "request_id")


# ---- aggregations


@query("A1", over("rq", "SELECT client_id, count(*) AS count FROM rq GROUP BY client_id"))
def a1(s, d):
    return aggregates.total_count(requests(s, d), "client_id")


@query("A2", "SELECT count(*) AS count FROM events")
def a2(s, d):
    return aggregates.envelope_count(envelopes(s, d).select(F.from_json("value", schemas.ENVELOPE).alias("e")).select("e.*"))


BEST = f"SELECT from_bank, {AMOUNT}, ts_text, from_account, to_account FROM (SELECT *, row_number() OVER (PARTITION BY from_bank ORDER BY amount_paid DESC, ts_text, from_account, to_account) AS k FROM usd) WHERE k = 1"
for _name in ("A3", "A4", "A5", "W2"):

    @query(_name, over("usd", BEST))
    def best_of(s, d):
        t = usd(s, d).select("from_bank", "amount_paid", "ts_text", "from_account", "to_account")
        return aggregates.largest(t, "from_bank", "amount_paid", "ts_text", "from_account", "to_account")


CENTS = "CAST(sum(CAST(round_even(CAST(amount_paid * 100 AS DOUBLE), 0) AS BIGINT)) AS DOUBLE) / count(*) / 100"


@query("A6", over("tx", f"SELECT payment_format, {CENTS} AS mean FROM tx GROUP BY payment_format"))
def a6(s, d):
    return aggregates.mean_by(tx(s, d), "payment_format", "amount_paid", in_cents=True)


@query("A7", over("tx", f"SELECT payment_format, {MEAN} AS mean FROM tx GROUP BY payment_format"))
def a7(s, d):
    return aggregates.mean_by(tx(s, d), "payment_format", "amount_paid")


@query("A8", over("tx", "SELECT payment_format, CAST(sum(amount_paid) AS DOUBLE) AS total, count(*) AS n FROM tx GROUP BY payment_format"))
def a8(s, d):
    return aggregates.sum_and_count(tx(s, d), "payment_format", "amount_paid")


@query("A9", over("tx", "SELECT from_bank, from_account, count(*) AS n_values FROM (SELECT DISTINCT from_bank, from_account, to_bank, to_account FROM tx) GROUP BY ALL HAVING count(*) > 5"))
def a9(s, d):
    return aggregates.distinct_values(tx(s, d), ["from_bank", "from_account"], ["to_bank", "to_account"], 5)


@query("A10", over("edge big", "SELECT edge.* FROM edge JOIN big USING (from_bank, from_account)"))
def a10(s, d):
    kept = predicates.keep(usd(s, d), ("between", "ts_text", PERIOD))
    return aggregates.distinct_values(kept, ["from_bank", "from_account"], ["to_bank", "to_account"], 5, explode=True).select(*joins.EDGE)


@query("A11", over("tx", "SELECT from_account, count(*) AS n FROM (SELECT from_account, to_account, count(*) FROM tx GROUP BY ALL) GROUP BY from_account"))
def a11(s, d):
    return tx(s, d).groupBy("from_account", "to_account").count().groupBy("from_account").agg(F.count("*").alias("n"))


@query("A12", over("tx", "SELECT DISTINCT from_bank, to_bank, payment_format FROM tx"))
def a12(s, d):
    return tx(s, d).select("from_bank", "to_bank", "payment_format").distinct()


@query("A13", over("path", "SELECT DISTINCT a_account, b_account, c_account FROM path"))
def a13(s, d):
    e = scratch.saved(period_edges(s, d), "edges")
    return joins.account_triples(joins.scatter_edges(e).select(*joins.EDGE), e)


@query("A14", over("tx", "SELECT from_account, count(*) AS n FROM tx GROUP BY from_account HAVING count(*) > 5"))
def a14(s, d):
    return aggregates.having(tx(s, d), ["from_account"], 5)


@query("A15", over("tx", "SELECT min(ts_text) AS first, max(ts_text) AS last FROM tx"))
def a15(s, d):
    return aggregates.extent(tx(s, d), "ts_text")


@query("A16", over("tx", "SELECT account, count(DISTINCT bank) AS n_banks FROM (SELECT from_bank AS bank, from_account AS account FROM tx UNION ALL SELECT payment_format, to_account FROM tx) GROUP BY account HAVING count(DISTINCT bank) > 1"))
def a16(s, d):
    # a receiver's bank follows from its number, so the format stands in for a second bank
    return aggregates.accounts_at_several_banks(tx(s, d).withColumn("to_bank", F.col("payment_format")))


@query("A17", over("tx", "SELECT payment_format, count(*) AS n FROM tx GROUP BY payment_format"))
def a17(s, d):
    return tx(s, d).groupBy("payment_format").agg(F.count("*").alias("n"))


for _name in ("A18", "O4"):

    @query(_name, over("tx", "SELECT from_account, count(DISTINCT to_account) AS n_values FROM tx GROUP BY from_account ORDER BY n_values DESC, from_account LIMIT 5"))
    def connected(s, d):
        return aggregates.most_connected(tx(s, d), ["from_account"], ["to_account"])


@query("A19", over("tx", "SELECT from_bank, count(*) AS n FROM tx GROUP BY from_bank"))
def a19(s, d):
    return tx(s, d).groupBy("from_bank").agg(F.count("*").alias("n"))


ONCE = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY client_id, request_id ORDER BY event_id) AS k FROM rq) WHERE k = 1 OR request_id IS NULL"


@query("A20", over("rq", f"SELECT client_id, n_sent, n_got, n_sent = n_got AS matches FROM (SELECT client_id, count(*) AS n_sent FROM rq GROUP BY client_id) JOIN (SELECT client_id, count(*) AS n_got FROM ({ONCE}) GROUP BY client_id) USING (client_id)"))
def a20(s, d):
    r = requests(s, d)
    return aggregates.reconciled(r, joins.once_by_id(r, "client_id", "request_id", order=["event_id"]), "client_id")


# ---- windows, sorts, sets


@query("W1", over("rt", "SELECT strftime(day, '%Y-%m-%d') AS rate_date, rt.iso, rt.rate FROM (SELECT CAST(r.d AS DATE) AS day, (SELECT max(rate_date) FROM rt WHERE rate_date <= CAST(r.d AS DATE)) AS p FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31 12:00:00', INTERVAL 1 DAY) r(d)) JOIN rt ON rt.rate_date = p"))
def w1(s, d):
    return joins.filled_rates(readers.rates(s, d), "1995-01-01", "2001-12-31")


@query("O1", over("path", f"SELECT a_bank AS bank, a_account AS account FROM (SELECT a_bank, a_account, c_bank, c_account FROM path WHERE {NO_LOOPS} GROUP BY ALL HAVING count(*) > 2) UNION SELECT c_bank, c_account FROM (SELECT a_bank, a_account, c_bank, c_account FROM path WHERE {NO_LOOPS} GROUP BY ALL HAVING count(*) > 2)"))
def o1(s, d):
    return flagship.scatter_gather_accounts(flagship.scatter_gather(tx(s, d), PERIOD, gather_over=2, drop_self_loops=True, written=True))


@query("O2", over("tx", "SELECT from_bank, count(*) AS n FROM tx GROUP BY from_bank ORDER BY from_bank"))
def o2(s, d):
    return tx(s, d).groupBy("from_bank").agg(F.count("*").alias("n")).orderBy("from_bank")


@query("O3", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 5")
def o3(s, d):
    return rows.top(readers.read_table(s, d, "events").select("event_id", "event_type"), 5, "event_id")


@query("U1", over("tx", "SELECT from_bank AS bank, from_account AS account FROM tx UNION SELECT to_bank, to_account FROM tx"))
def u1(s, d):
    pairs = tx(s, d).select(F.col("from_bank").alias("a_bank"), F.col("from_account").alias("a_account"), F.col("to_bank").alias("c_bank"), F.col("to_account").alias("c_account"))
    return joins.ends(pairs)


@query("U2", over("tx", "SELECT from_bank AS bank, from_account AS account FROM tx UNION ALL SELECT to_bank, to_account FROM tx"))
def u2(s, d):
    t = tx(s, d)
    return t.select(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")).unionByName(t.select(F.col("to_bank").alias("bank"), F.col("to_account").alias("account")))


@query("U3", over("rq", f"SELECT client_id, event_type, count(*) - sum(CASE WHEN kept THEN 1 ELSE 0 END) AS surplus FROM (SELECT client_id, event_type, request_id IS NULL OR row_number() OVER (PARTITION BY client_id, request_id ORDER BY event_id) = 1 AS kept FROM rq) GROUP BY ALL HAVING count(*) <> sum(CASE WHEN kept THEN 1 ELSE 0 END)"))
def u3(s, d):
    r = requests(s, d)
    columns = ["client_id", "event_type"]
    return joins.differences(r.select(*columns), joins.once_by_id(r, "client_id", "request_id", order=["event_id"]).select(*columns))


@query("U4", over("rq", f"SELECT client_id, n_a, n_b, n_a = n_b AS equal FROM (SELECT client_id, count(*) AS n_a FROM rq GROUP BY client_id) JOIN (SELECT client_id, count(*) AS n_b FROM ({ONCE}) GROUP BY client_id) USING (client_id)"))
def u4(s, d):
    r = requests(s, d).select("client_id", "event_id", "request_id")
    return joins.compared(r, joins.once_by_id(r, "client_id", "request_id", order=["event_id"]), "client_id")


# ---- scalar functions

DIGIT_ID = "CASE WHEN id IS NULL OR trim(id) = '' THEN 'N/A' WHEN regexp_matches(trim(id), '^[0-9]+$') THEN regexp_replace(trim(id), '^0+(.)', '\\1') ELSE trim(id) END"
HORNER = "(" + "(" * 4 + "CAST(0 AS BIGINT)" + "".join(f" * (4294967296 % {{n}}) + CAST('0x' || substr(md5({{k}}), {at}, 8) AS BIGINT)) % {{n}}" for at in (1, 9, 17, 25)) + " + 1)"


def horner(key: str, n: int) -> str:
    return HORNER.replace("{n}", str(n)).replace("{k}", key)


SCALARS = {
    "N1": (lambda: scalars.digits_id(F.col("id")), DIGIT_ID),
    "N2": (lambda: scalars.plain_id(F.col("id")), "CASE WHEN trim(id) = '' THEN '0' ELSE regexp_replace(trim(id), '^0+(.)', '\\1') END"),
    "N3": (lambda: scalars.bank_id(F.col("id")), "CASE WHEN regexp_matches(id, '^[0-9]+$') THEN regexp_replace(id, '^0+(.)', '\\1') ELSE id END"),
    "N4": (lambda: scalars.number(F.col("id")), "TRY_CAST(id AS DOUBLE)"),
    "N9": (lambda: scalars.md5_bucket(scalars.key_part(F.col("id")), 7), horner("CASE WHEN id IS NULL OR trim(id) = '' THEN 'N/A' ELSE trim(id) END", 7)),
    "N10": (lambda: scalars.composite_key(F.col("id"), F.col("event_id")), f"{DIGIT_ID} || '|' || CAST(event_id AS VARCHAR)"),
    "N11": (lambda: scalars.composite_key(F.col("id"), tenant=F.lit("c1")), f"'c1|' || {DIGIT_ID}"),
    "N12": (lambda: scalars.content_hash(F.coalesce("id", F.lit(""))), "substr(md5(coalesce(id, '')), 1, 16)"),
    "N14": (lambda: scalars.query_number(F.concat(F.lit("out_q"), F.col("event_id").cast("string"), F.lit(".csv"))), "CAST(event_id AS INTEGER)"),
    "N15": (lambda: F.get_json_object(F.to_json(F.struct("event_id", "id")), "$.id"), "id"),
}
for _name, (_made, _sql) in SCALARS.items():
    query(_name, over("ids", f"SELECT event_id, {_sql} AS out FROM ids"))(lambda s, d, made=_made: ids(s, d).select("event_id", made().alias("out")))


@query("N5", over("tx", "SELECT from_account, strftime(strptime(substr(ts_text, 1, 10), '%Y/%m/%d'), '%Y-%m-%d') AS day FROM tx"))
def n5(s, d):
    return tx(s, d).select("from_account", scalars.day(F.col("ts_text")).alias("day"))


@query("N6", over("tx", "SELECT payment_currency, CASE payment_currency WHEN 'US Dollar' THEN 'USD' WHEN 'Euro' THEN 'EUR' WHEN 'Yen' THEN 'JPY' END AS iso, count(*) AS n FROM tx GROUP BY ALL"))
def n6(s, d):
    return tx(s, d).groupBy("payment_currency", scalars.iso_code(F.col("payment_currency")).alias("iso")).agg(F.count("*").alias("n"))


@query("N7", over("tx rt", f"SELECT from_account, to_account, CASE iso WHEN 'USD' THEN CAST(amount_paid AS DOUBLE) ELSE CAST(amount_paid AS DOUBLE) / rate END AS usd FROM ({PRICED})"))
def n7(s, d):
    return flagship.converted(tx(s, d), readers.rates(s, d)).select("from_account", "to_account", "usd")


@query("N8", over("tx rt", f"SELECT from_account, to_account FROM ({PRICED}) WHERE CASE iso WHEN 'USD' THEN CAST(amount_paid AS DOUBLE) ELSE CAST(amount_paid AS DOUBLE) / rate END < 1"))
def n8(s, d):
    return flagship.converted(tx(s, d), readers.rates(s, d)).where("usd < 1").select("from_account", "to_account")


@query("N13", over("rq", "SELECT event_id, split_part(request_id, ':', 2) AS session FROM rq"))
def n13(s, d):
    return requests(s, d).select("event_id", scalars.session_of(F.col("request_id")).alias("session"))


@query("N16", "SELECT DISTINCT strftime(unnest(range(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 3 DAY, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM orders")
def n16(s, d):
    day = F.to_date("o_orderdate")
    return readers.read_table(s, d, "orders").select(F.explode(scalars.days_between(day, F.date_add(day, 2))).alias("day")).distinct()


@query("N17", over("tx", "SELECT from_account, CAST(round_even(CAST(amount_paid * 100 AS DOUBLE), 0) AS BIGINT) AS cents FROM tx"))
def n17(s, d):
    return tx(s, d).select("from_account", scalars.cents(F.col("amount_paid")).alias("cents"))


# ---- layout


@query("R1", over("tx", "SELECT bucket, count(*) AS n FROM (SELECT CAST(" + horner("regexp_replace(from_bank, '^0+(.)', '\\1') || '|' || from_account", 4) + " AS INTEGER) AS bucket FROM tx) GROUP BY bucket"))
def r1(s, d):
    return rows.partitioned(tx(s, d), 4, "from_bank", "from_account").groupBy("bucket").agg(F.count("*").alias("n"))


@query("R2", over("acc", "SELECT bank_id, CAST(" + horner("regexp_replace(bank_id, '^0+(.)', '\\1')", 4) + " AS INTEGER) AS bucket FROM acc"))
def r2(s, d):
    return rows.partitioned(readers.accounts(s, d), 4, "bank_id").select("bank_id", "bucket")


# ---- streams and state


@query("T1", over("rq", f"SELECT event_id, client_id, request_id FROM ({ONCE})"))
def t1(s, d):
    return joins.once_by_id(requests(s, d).select("event_id", "client_id", "request_id"), "client_id", "request_id", order=["event_id"])


@query("T1_stream", over("rq", f"SELECT client_id, request_id, count(*) AS n FROM ({ONCE}) GROUP BY ALL"))
def t1_stream(s, d):
    twice = readers.event_stream(s, d).select("client_id", "request_id", "ts")
    return jobs.once(twice, ["client_id", "request_id"]).groupBy("client_id", "request_id").agg(F.count("*").alias("n"))


def in_two_parts(s, rows, name, run, first="event_id % 2 = 0"):
    """Run a job on one part of the rows and, from the same checkpoint, on the rest when it has arrived."""
    path, checkpoint, table = (scratch.folder(s, f"{name}-{x}") for x in ("events", "checkpoint", "table"))
    for part in (first, f"NOT ({first})"):
        rows.where(part).write.mode("append").parquet(path)
        out = run(s.readStream.schema(rows.schema).parquet(path), checkpoint, table)
    return out


@query("T1_restart", over("rq", f"SELECT client_id, request_id, count(*) AS n FROM ({ONCE}) GROUP BY ALL"))
def t1_restart(s, d):
    job = lambda e, checkpoint, table: jobs.once(e.select("client_id", "request_id", "ts"), ["client_id", "request_id"], checkpoint=checkpoint, table=table)
    return in_two_parts(s, requests(s, d), "t1", job).groupBy("client_id", "request_id").agg(F.count("*").alias("n"))


@query("T2", over("rq", "SELECT event_id, request_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY event_id) AS k FROM rq) WHERE k = 1 OR request_id IS NULL"))
def t2(s, d):
    return joins.once_by_id(requests(s, d).select("event_id", "request_id", "event_type"), "request_id", order=["event_id"])


@query("T3", over("rq", "SELECT client_id, count(*) AS count FROM rq GROUP BY client_id"))
def t3(s, d):
    return jobs.count_by_client(readers.event_stream(s, d))


@query("T3_restart", over("rq", "SELECT client_id, count(*) AS count FROM rq GROUP BY client_id"))
def t3_restart(s, d):
    return in_two_parts(s, requests(s, d), "t3", jobs.count_by_client)


T4_SQL = over("rq", "SELECT client_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY value DESC, event_id) AS k FROM rq WHERE value IS NOT NULL) WHERE k = 1")


@query("T4", T4_SQL)
def t4(s, d):
    return jobs.largest_by_client(readers.event_stream(s, d))


@query("T4_restart", T4_SQL)
def t4_restart(s, d):
    return in_two_parts(s, requests(s, d), "t4", jobs.largest_by_client)


T5_GROUPS = "SELECT client_id, event_type, count(DISTINCT user_id) AS n_values FROM rq GROUP BY ALL HAVING count(DISTINCT user_id) > 2"


@query("T5", over("rq", T5_GROUPS))
def t5(s, d):
    return jobs.distinct_by_group(readers.event_stream(s, d), ["client_id", "event_type"], ["user_id"], 2)


@query("T5_explode", over("rq", f"SELECT DISTINCT client_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM rq SEMI JOIN ({T5_GROUPS}) USING (client_id, event_type)"))
def t5_explode(s, d):
    """The values of the groups that pass, each sent once, over a stop half-way."""
    job = lambda e, checkpoint, table: jobs.distinct_by_group(e, ["client_id", "event_type"], ["user_id"], 2, explode=True, checkpoint=checkpoint, table=table)
    return in_two_parts(s, requests(s, d), "t5", job)


@query("T6", over("rq", "SELECT client_id, n_buys, n_views FROM (SELECT client_id, count(*) AS n_buys FROM rq WHERE event_type = 'purchase' GROUP BY client_id) JOIN (SELECT client_id, count(*) AS n_views FROM rq WHERE event_type = 'view' GROUP BY client_id) USING (client_id)"))
def t6(s, d):
    def finish(buys, views):
        return buys.groupBy("client_id").agg(F.count("*").alias("n_buys")).join(views.groupBy("client_id").agg(F.count("*").alias("n_views")), "client_id")

    e = readers.event_stream(s, d).select("client_id", "event_id", "event_type")
    return jobs.two_inputs(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), finish)


@query("T6_means", over("tx", f"SELECT from_account, payment_format, {AMOUNT} FROM tx JOIN (SELECT payment_format, {MEAN} AS mean FROM tx WHERE substr(ts_text, 1, 10) <= '1997/12/31' GROUP BY payment_format) USING (payment_format) WHERE substr(ts_text, 1, 10) >= '1998/01/01' AND CAST(amount_paid AS DOUBLE) < mean * 0.01"))
def t6_means(s, d):
    """Late rows wait in keyed state until the early period is over; the stream stops between the two."""

    def job(t, checkpoint, table):
        stream = t.withColumn("ts", F.to_timestamp("ts_text", "yyyy/MM/dd HH:mm"))
        early, late = (predicates.predicate(t, "between", "ts_text", period) for period in (EARLY, LATE))
        return jobs.run_to_end(jobs.below_baseline(stream, early, late, "1998-01-01", ["from_account"]), "append", "t6", checkpoint, table)

    return in_two_parts(s, tx(s, d), "t6", job, "ts_text < '1996/06/01'")


AS_OF, TIMEOUT = "2024-01-28 00:00:00", 2 * 86400


@query("T7", f"SELECT c_custkey AS user_id, CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) - CAST(floor(epoch(last_ts)) AS BIGINT) AS silent_s FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN (SELECT user_id, max(ts) AS last_ts FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id) ON user_id = c_custkey WHERE last_ts IS NULL OR CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) - CAST(floor(epoch(last_ts)) AS BIGINT) > {TIMEOUT}")
def t7(s, d):
    roster = readers.read_table(s, d, "customer").select(F.col("c_custkey").alias("user_id")).distinct()
    return joins.silent(requests(s, d), roster, "user_id", AS_OF, TIMEOUT).select("user_id", "silent_s")


@query("T7_gaps", f"SELECT user_id, alerts FROM (SELECT user_id, floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)))::BIGINT AS pause, CAST(floor((floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) - 1) / {TIMEOUT // 2}) AS BIGINT) AS alerts FROM events) WHERE pause > {TIMEOUT // 2}")
def t7_gaps(s, d):
    return joins.gaps(requests(s, d), "user_id", TIMEOUT // 2).select("user_id", "alerts")


WATCHED = 86400
ALERTS = f"""SELECT user_id, from_s, count(*) AS alerts, bool_and(reported) AS reported FROM (SELECT user_id, from_s, reported, unnest(range(1, CAST(greatest(1, ceil((until_s - from_s) / {WATCHED})) AS BIGINT))) AS k FROM (
SELECT user_id, from_s, reported, least(coalesce(lead(from_s) OVER (PARTITION BY user_id ORDER BY from_s, reported), 1e18), (SELECT epoch_ms(max(ts)) / 1000 - 3600 FROM events)) AS until_s FROM (
SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS from_s, true AS reported FROM events UNION ALL SELECT DISTINCT c_custkey, CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT), false FROM customer))) GROUP BY user_id, from_s"""


@query("T7_stream", ALERTS)
def t7_stream(s, d):
    """Alerts of silent entities as the watermark passes them, over a stop half-way; customers are watched from the start."""
    roster = readers.read_table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("2024-01-01").cast("timestamp").alias("since")).distinct()

    def job(e, checkpoint, table):
        return jobs.run_to_end(jobs.silent_alerts(e.select("user_id", "ts"), "user_id", WATCHED, roster=roster), "append", "t7", checkpoint, table)

    alerts = in_two_parts(s, requests(s, d).select("user_id", "ts"), "t7", job, "ts < timestamp'2024-01-15'")
    return alerts.groupBy("user_id", "from_s").agg(F.count("*").alias("alerts"), F.every("reported").alias("reported"))


@query("T8", over("rq", f"SELECT client_id, count(*) AS count FROM ({LIVE}) GROUP BY client_id"))
def t8(s, d):
    return aggregates.total_count(joins.without_cancelled(requests(s, d), cancelled(s, d)), "client_id")


@query("T8_stream", over("rq", f"SELECT client_id, count(*) AS count FROM ({LIVE}) GROUP BY client_id"))
def t8_stream(s, d):
    def job(e, checkpoint, table):
        discard = F.expr("event_type = 'error' AND value > 100 AND request_id IS NOT NULL")
        return jobs.count_after_discard(e.withColumn("session", scalars.session_of(F.col("request_id"))), "session", discard, checkpoint, table)

    return in_two_parts(s, requests(s, d), "t8", job)


# ---- data preparation


EVENT = "event_id, user_id, event_type, value"


@query("D1", f"SELECT {EVENT} FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM events) WHERE floor(CAST(i * 30 AS DOUBLE) / 100) > floor(CAST((i - 1) * 30 AS DOUBLE) / 100)")
def d1(s, d):
    return rows.systematic_sample(readers.read_table(s, d, "events"), 30, "event_id").select("event_id", "user_id", "event_type", "value")


@query("D1_rank", f"SELECT {EVENT}, row_number() OVER (ORDER BY event_type, value, event_id) AS rank FROM events")
def d1_rank(s, d):
    """The order that samples are drawn from, with many ties in its first column."""
    return rows.with_rank(readers.read_table(s, d, "events").select("event_id", "user_id", "event_type", "value"), "event_type", "value", "event_id")


@query("D2", "SELECT event_id FROM events WHERE " + horner("CAST(event_id AS VARCHAR)", 10_000) + " <= 2500")
def d2(s, d):
    return rows.hash_sample(readers.read_table(s, d, "events").select("event_id"), 25, "event_id")


@query("D2_draws", "SELECT CAST(0 AS BIGINT) AS strangers, true AS size_fits, count(*) AS n FROM events")
def d2_draws(s, d):
    """The draws differ with the layout, so what must hold is compared: a subset, about a quarter of the rows, the same for one seed."""
    e = readers.read_table(s, d, "events").select("event_id")
    drawn = rows.bernoulli_sample(e, 25, 7)
    strangers = drawn.join(e, "event_id", "left_anti").agg(F.count("*").alias("strangers"))
    again = rows.bernoulli_sample(e, 25, 7).agg(F.count("*").alias("again"))
    sizes = e.agg(F.count("*").alias("n")).crossJoin(drawn.agg(F.count("*").alias("k"))).crossJoin(again)  # a row each
    fits = (F.abs(F.col("k") - F.col("n") * 0.25) <= 6 * F.sqrt(F.col("n") * 0.1875)) & (F.col("k") == F.col("again"))
    return strangers.crossJoin(sizes.select(fits.alias("size_fits"), "n"))


@query("D3", f"SELECT {EVENT} FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM events) WHERE i <= floor(n * 0.1)")
def d3(s, d):
    return rows.head_sample(readers.read_table(s, d, "events"), 10, "event_id").select("event_id", "user_id", "event_type", "value")


PLANTED = "SELECT '777' AS from_bank, 'SRC' AS from_account, lpad(CAST(900 + i % 50 AS VARCHAR), 3, '0') AS to_bank, 'MID' || lpad(CAST(i AS VARCHAR), 3, '0') AS to_account FROM range(8) r(i) UNION ALL SELECT lpad(CAST(900 + i % 50 AS VARCHAR), 3, '0'), 'MID' || lpad(CAST(i AS VARCHAR), 3, '0'), '888', 'DST' FROM range(8) r(i)"


@query(
    "D4",
    over(
        "usd",
        f", ed AS (SELECT DISTINCT * FROM (SELECT from_bank, from_account, to_bank, to_account FROM usd WHERE substr(ts_text, 1, 10) BETWEEN '1995/01/01' AND '2001/12/31' UNION ALL {PLANTED}) WHERE NOT (from_bank = to_bank AND from_account = to_account)), "
        "bg AS (SELECT from_bank, from_account FROM (SELECT DISTINCT * FROM (SELECT from_bank, from_account, to_bank, to_account FROM usd WHERE substr(ts_text, 1, 10) BETWEEN '1995/01/01' AND '2001/12/31' UNION ALL "
        + PLANTED
        + ")) GROUP BY ALL HAVING count(*) > 5) SELECT a.from_bank AS a_bank, a.from_account AS a_account, c.to_bank AS c_bank, c.to_account AS c_account, count(*) AS n_between FROM ed a JOIN bg USING (from_bank, from_account) JOIN ed c ON a.to_bank = c.from_bank AND a.to_account = c.from_account WHERE NOT (a.from_bank = c.to_bank AND a.from_account = c.to_account) GROUP BY ALL HAVING count(*) > 5",
    ).replace("') , ed", "'), ed"),
)
def d4(s, d):
    planted = rows.plant_scatter_gather(tx(s, d), ("777", "SRC"), ("888", "DST"), 8, "1996/05/01 10:00", 120.0, "US Dollar")
    return flagship.scatter_gather(planted, PERIOD, drop_self_loops=True, written=True)


FORMATS = "['" + "', '".join(rows.PAYMENT_FORMATS) + "'][1 + i % 6]"
PLANTED_ROWS = " UNION ALL ".join(f"SELECT strftime(TIMESTAMP '1996-05-01 10:00' + to_minutes(CAST({step} AS INTEGER)), '%Y/%m/%d %H:%M') AS ts_text, {FORMATS} AS payment_format, 120 + {step} AS amount_paid FROM range(8) r(i)" for step in ("i", "8 + i"))


@query("D4_rows", over("tx", f"SELECT ts_text, payment_format, count(*) AS n, CAST(sum(amount_paid) AS DOUBLE) AS total FROM (SELECT ts_text, payment_format, amount_paid FROM tx UNION ALL {PLANTED_ROWS}) GROUP BY ALL"))
def d4_rows(s, d):
    planted = rows.plant_scatter_gather(tx(s, d), ("777", "SRC"), ("888", "DST"), 8, "1996/05/01 10:00", 120.0, "US Dollar")
    return planted.groupBy("ts_text", "payment_format").agg(F.count("*").alias("n"), F.sum("amount_paid").alias("total"))


@query("D5", over("tx", "SELECT count(*) AS count FROM tx"))
def d5(s, d):
    return aggregates.total_count(schemas.require(tx(s, d), *joins.EDGE, "amount_paid"))


@query("D6", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type FROM events")
def d6(s, d):
    path = scratch.folder(s, "d6")
    e = readers.read_table(s, d, "events")
    kind = F.col("event_id") % 3
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.when(kind > 0, F.col("event_type")), F.when(kind == 2, F.lit("cut off")))
    e.select(line.alias("value")).write.text(path)
    return s.read.schema("event_id bigint, event_type string").option("mode", "PERMISSIVE").csv(path)


# ---- the five questions

Q3_SQL = f"SELECT from_bank, from_account, payment_format, {AMOUNT} FROM usd JOIN (SELECT payment_format, {MEAN} AS mean FROM usd WHERE substr(ts_text, 1, 10) <= '1997/12/31' GROUP BY payment_format) USING (payment_format) WHERE substr(ts_text, 1, 10) >= '1998/01/01' AND CAST(amount_paid AS DOUBLE) < mean * 0.01"


@query("Q1", over("usd", f"SELECT {TX_COLUMNS}, {AMOUNT} FROM usd WHERE amount_paid < 50"))
def q1(s, d):
    return flagship.small_transfers(tx(s, d))


@query("Q2", over("usd acc", f"SELECT b.from_bank, from_account, bank_name, amount_paid FROM ({BEST}) b JOIN acc ON bank_id = b.from_bank"))
def q2(s, d):
    return flagship.largest_by_bank(tx(s, d), readers.accounts(s, d))


@query("Q3", over("usd", Q3_SQL))
def q3(s, d):
    return flagship.below_baseline(tx(s, d), EARLY, LATE)


@query("Q4", over("path", "SELECT DISTINCT bank, account FROM (SELECT a_bank AS bank, a_account AS account FROM p UNION ALL SELECT c_bank, c_account FROM p)").replace("SELECT DISTINCT bank", ", p AS (SELECT a_bank, a_account, c_bank, c_account FROM path GROUP BY ALL HAVING count(*) > 2) SELECT DISTINCT bank"))
def q4(s, d):
    return flagship.scatter_gather_accounts(flagship.scatter_gather(tx(s, d), PERIOD, gather_over=2, written=True))


@query("Q4p", over("path", f"SELECT a_bank, a_account, c_bank, c_account, count(*) AS n_between FROM path WHERE {NO_LOOPS} GROUP BY ALL HAVING count(*) > 2"))
def q4p(s, d):
    return flagship.scatter_gather(tx(s, d), PERIOD, gather_over=2, drop_self_loops=True, written=True)


@query("Q5", over("tx rt", f"SELECT count(*) AS count FROM ({PRICED}) WHERE substr(ts_text, 1, 10) BETWEEN '1996/01/01' AND '1996/12/31' AND payment_format IN ('Wire', 'ACH') AND CASE iso WHEN 'USD' THEN CAST(amount_paid AS DOUBLE) ELSE CAST(amount_paid AS DOUBLE) / rate END < 1"))
def q5(s, d):
    return flagship.tiny_transfers(tx(s, d), readers.rates(s, d), YEAR)
