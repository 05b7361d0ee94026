"""Joins, sets, fills and the transfer graph.

Dimension sides (banks, formats, rates) are left to Spark: adaptive execution
broadcasts them below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txloom import schemas, scratch
from txloom.functions import scalars
from txloom.operators import aggregates

EDGE = ["from_bank", "from_account", "to_bank", "to_account"]


def bank_names(accounts: DataFrame) -> DataFrame:
    """One name for each normalised bank id, the first by text."""
    return accounts.groupBy(scalars.digits_id(F.col("bank_id")).alias("bank_key")).agg(F.min("bank_name").alias("bank_name"))


def with_bank_name(rows: DataFrame, accounts: DataFrame, bank: str = "from_bank") -> DataFrame:
    """Inner join on the normalised bank id; rows of unknown banks go."""
    schemas.free(rows, "bank_name")
    names = bank_names(accounts)
    return rows.join(names, scalars.digits_id(rows[bank]) == names["bank_key"]).drop(names["bank_key"])


def below_baseline(late: DataFrame, early: DataFrame, key: str = "payment_format", amount: str = "amount_paid", ratio: float = 0.01, in_cents: bool = False) -> DataFrame:
    """Late rows under ``ratio`` times the early mean of their key; keys without an early row go."""
    means = aggregates.mean_by(early, key, amount, in_cents)
    return late.join(means, key).where(F.col(amount) < F.col("mean") * ratio)


def keyed(rows: DataFrame, keys: DataFrame, *on: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is among ``keys``: semi join, or inner with unique keys."""
    return rows.join(keys, list(on), how)


def with_rate(rows: DataFrame, rates: DataFrame, usd_needs_rate: bool = True) -> DataFrame:
    """Add ``rate`` by day and currency. Rows without one go, but dollars need none unless ``usd_needs_rate``."""
    if usd_needs_rate:
        return rows.join(rates, ["rate_date", "iso"])
    return rows.join(rates, ["rate_date", "iso"], "left").where(F.col("rate").isNotNull() | (F.col("iso") == "USD"))


def mapped(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Look a key up in a two-column table; rows without a value go."""
    return rows.join(table.select(key, value), key, "left").where(F.col(value).isNotNull())


def found_in(rows: DataFrame, source: DataFrame, *on: str) -> DataFrame:
    """Left join of results back to their source: ``n_source`` rows of it have the key."""
    schemas.free(rows, "n_source")
    counts = source.groupBy(*on).agg(F.count("*").alias("n_source"))
    return rows.join(counts, list(on), "left").withColumn("n_source", F.coalesce("n_source", F.lit(0)))


def without_cancelled(rows: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Drop rows whose (client_id, session of request_id) was cancelled; rows without a session stay."""
    gone = cancelled.select(F.col("client_id").alias("gone_client"), F.col("session").alias("gone_session")).distinct()
    return rows.join(gone, (rows["client_id"] == gone["gone_client"]) & (scalars.session_of(rows["request_id"]) == gone["gone_session"]), "left_anti")


def edges(rows: DataFrame, normalise=None) -> DataFrame:
    """Distinct transfers (bank, account) to (bank, account)."""
    ids = rows.select(*((normalise(F.col(c)) if normalise else F.col(c)).alias(c) for c in EDGE))
    return ids.distinct()


def scatter_edges(links: DataFrame, over: int = 5) -> DataFrame:
    """Edges of senders with more than ``over`` receivers. The edges are distinct, so a count suffices."""
    senders = links.groupBy("from_bank", "from_account").agg(F.count("*").alias("n")).where(F.col("n") > over)
    return links.join(senders, ["from_bank", "from_account"], "left_semi")


def _no_loops(links: DataFrame) -> DataFrame:
    return links.where("NOT (from_bank = to_bank AND from_account = to_account)")


def path_counts(first: DataFrame, second: DataFrame, end: str, drop_self_loops: bool = True) -> DataFrame:
    """The number ``n`` of the paths of ``two_hops`` by their first (``a``) or middle (``b``) account, without making them.

    An edge A-B goes on as many ways as B has edges, less one if B leads back to A.
    """
    if drop_self_loops:
        first, second = _no_loops(first), _no_loops(second)
    ways = second.groupBy(F.col("from_bank").alias("b_bank"), F.col("from_account").alias("b_account")).agg(F.count("*").alias("ways"))
    back = second.toDF("b_bank", "b_account", "a_bank", "a_account").withColumn("back", F.lit(1))
    legs = first.toDF("a_bank", "a_account", "b_bank", "b_account").join(ways, ["b_bank", "b_account"]).join(back, ["a_bank", "a_account", "b_bank", "b_account"], "left")
    counts = legs.groupBy(f"{end}_bank", f"{end}_account").agg(F.sum(F.col("ways") - F.coalesce("back", F.lit(0))).alias("n"))
    return counts.where("n > 0")


#: Edges on each side of a middle account that are joined in one piece: a piece has at most the square of it in paths.
TILE = 4096


def _tiled(edges: DataFrame, heavy: DataFrame, own: str, other: str, key: list[str]) -> DataFrame:
    """Edges with the number of their tile: dealt over the tiles of their own side, copied to those of the other."""
    known = edges.join(heavy, key, "left").withColumns({x: F.coalesce(x, F.lit(1)) for x in (own, other)})
    place = F.pmod(F.xxhash64(*(c for c in edges.columns if c not in key)), F.col(own)).cast("int")
    return known.withColumn(f"{own}_at", place).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)


def _tiles(first: DataFrame, second: DataFrame, tile: int, key: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with their tiles, and the columns that they meet by; see ``tiled_hops``."""
    ins = first.groupBy(*key).agg(F.count("*").alias("n_in"))
    outs = second.groupBy(*key).agg(F.count("*").alias("n_out"))
    cuts = lambda n: F.ceil(F.col(n) / tile).cast("int")
    heavy = ins.join(outs, key).where((F.col("n_in") > tile) | (F.col("n_out") > tile)).select(*key, cuts("n_in").alias("rows"), cuts("n_out").alias("cols"))
    return _tiled(first, heavy, "rows", "cols", key), _tiled(second, heavy, "cols", "rows", key), [*key, "rows_at", "cols_at"]


def tiled_hops(first: DataFrame, second: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of edges (a, b) and (b, c) that meet in b, with the tile that each pair is made in.

    A middle account with more than ``tile`` edges on a side is split by degree into tiles of
    about ``tile`` by ``tile`` edges, each a join key of its own, so that no task has a hub
    alone. Other accounts are one tile. Few accounts are that heavy, so their table is small.
    """
    left, right, on = _tiles(first, second, tile, ["b_bank", "b_account"])
    return left.join(right, on)


def two_hops(first: DataFrame, second: DataFrame, drop_self_loops: bool = True, tile: int = TILE) -> DataFrame:
    """Paths A-B-C of distinct edges; A=C always goes, A=B and B=C too with ``drop_self_loops``.

    Hubs are the danger: self-loops go before the join, both sides are distinct, and
    accounts with many edges are joined in tiles.
    """
    if drop_self_loops:
        first, second = _no_loops(first), _no_loops(second)
    a = first.toDF("a_bank", "a_account", "b_bank", "b_account")
    c = second.toDF("b_bank", "b_account", "c_bank", "c_account")
    return tiled_hops(a, c, tile).where("NOT (a_bank = c_bank AND a_account = c_account)").select("a_bank", "a_account", "b_bank", "b_account", "c_bank", "c_account")


def account_triples(first: DataFrame, second: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct (a_account, b_account, c_account) of the paths of ``two_hops`` with self-loops.

    Edges are made distinct by account before they meet, with the least and the greatest bank of the outer
    account: that tells whether some path has A and C apart. A triple then comes once for each bank of
    B, so only those over accounts at several banks are made distinct afterwards.
    """
    b = ["b_bank", "b_account"]
    banks = lambda x: (F.min(f"{x}_bank").alias(f"{x}_low"), F.max(f"{x}_bank").alias(f"{x}_high"))
    a = scratch.saved(first.toDF("a_bank", "a_account", *b).groupBy("a_account", *b).agg(*banks("a")), "legs")
    c = scratch.saved(second.toDF(*b, "c_bank", "c_account").groupBy(*b, "c_account").agg(*banks("c")), "legs")
    several = a.groupBy("b_account").agg(F.min("b_bank").alias("low"), F.max("b_bank").alias("high")).where("low < high").select("b_account")
    apart = "a_account <> c_account OR (c_low IS NOT NULL AND (a_low <> a_high OR c_low <> c_high OR a_low <> c_low))"
    once, again = (tiled_hops(a.join(several, "b_account", how).select(*a.columns), c, tile).where(apart).select("a_account", "b_account", "c_account") for how in ("left_anti", "left_semi"))
    return once.unionByName(again.distinct())


#: Paths that are counted in one task, about, and those of one first account that stay together.
PATHS, SHARE = 1 << 20, 1 << 18


def _one_text(bank: str, account: str) -> Column:
    """Bank and account as one text, with the bank's length so that no two accounts share one; null if either is."""
    return F.concat(F.length(bank).cast("string"), F.lit(":"), bank, account)


def _two_texts(text: str) -> tuple[Column, Column]:
    length = F.substring_index(text, ":", 1)
    start = F.length(length) + 2
    n = length.cast("int")
    return F.substring(F.col(text), start, n), F.substring(F.col(text), start + n, F.length(text))


def _legs(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Edges as two texts: half as many columns to sort, compare and shuffle."""
    return edges.select(_one_text("from_bank", "from_account").alias(start), _one_text("to_bank", "to_account").alias(end))


def _reaching(links: DataFrame, second: DataFrame, scatter_over: int, gather_over: int, drop_self_loops: bool, keep) -> DataFrame:
    """First legs (a, b, ways, reach): B has ``ways`` onward legs, and A ``reach`` paths in all.

    Senders with no more than ``scatter_over`` receivers go, and those of whose receivers no more than
    ``gather_over`` have an onward leg. One aggregate by sender tells both, so self-loops stay up to there.
    """
    ways = second.groupBy("b").agg(F.count("*").alias("ways"))
    onward = F.when(F.col("a") != F.col("b"), F.col("ways")) if drop_self_loops else F.col("ways")
    legs = keep(links.join(ways, "b", "left").select("a", "b", onward.alias("ways")), "legs")
    senders = legs.groupBy("a").agg(F.count("*").alias("n"), F.count("ways").alias("n_onward"), F.sum("ways").alias("reach"))
    senders = senders.where((F.col("n") > scatter_over) & (F.col("n_onward") > gather_over)).select("a", "reach")
    return keep(legs.where("ways IS NOT NULL").join(senders, "a"), "first")


def pair_counts(first: DataFrame, second: DataFrame, over: int, tile: int = TILE, paths: int = PATHS, share: int = SHARE) -> DataFrame:
    """(A, C, n_between) of the paths A-B-C of distinct edges, A and C apart, where more than ``over`` lead from A to C."""
    second = _legs(second, "b", "c")
    return _counted(_reaching(_legs(first, "a", "b"), second, 0, over, False, lambda e, name: e), second, over, tile, paths, share)


def _counted(first: DataFrame, second: DataFrame, over: int, tile: int = TILE, paths: int = PATHS, share: int = SHARE) -> DataFrame:
    """``pair_counts`` of the first legs of ``_reaching`` and second legs (b, c).

    Paths far outnumber edges, so none is shuffled as a row: each first leg takes B's receivers
    along as an array, legs are shuffled by A, and only there paths become rows, which are
    counted where they are. There are as many tasks as the number of paths asks for, and the
    receivers of an A with more than ``share`` paths are dealt to several of them.
    """
    total = first.agg(F.sum("ways")).first()[0] or 0
    cuts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    heavy = first.groupBy("b").agg(F.count("*").alias("n_in"), F.max("ways").alias("n_out")).where((F.col("n_in") > tile) | (F.col("n_out") > tile))
    # few if any: written first, so that neither side is shuffled to look them up
    heavy = scratch.saved(heavy.select("b", cuts("n_in", tile).alias("rows"), cuts("n_out", tile).alias("cols")), "heavy")
    legs = _tiled(first.select("a", "b", cuts("reach", share).alias("cuts")), heavy, "rows", "cols", ["b"])
    on = ["b", "rows_at", "cols_at"]
    # a tile's side of receivers, about, in an array; never sent to all tasks, as the files that Spark goes by are far smaller
    onward = _tiled(second, heavy, "cols", "rows", ["b"]).repartition(*on).groupBy(*on).agg(F.collect_list("c").alias("receivers"))
    met = legs.join(onward.hint("merge"), on).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    own = F.when(F.col("cuts") == 1, F.col("receivers")).otherwise(F.filter("receivers", lambda c: F.pmod(F.xxhash64(c), F.col("cuts")) == F.col("cut")))
    tasks = max(first.sparkSession.sparkContext.defaultParallelism, -(-total // paths))
    dealt = met.select("a", "cut", own.alias("receivers")).repartition(tasks, "a", "cut").select("a", "cut", F.explode("receivers").alias("c")).where("a <> c")
    # a path occurs once, as its edges are distinct: the count is that of distinct B
    counts = dealt.groupBy("a", "cut", "c").agg(F.count("*").alias("n_between")).where(F.col("n_between") > over)
    return counts.select(*(part.alias(f"{x}_{name}") for x in "ac" for name, part in zip(("bank", "account"), _two_texts(x), strict=True)), "n_between")


def scatter_gather_pairs(rows: DataFrame, scatter_over: int = 5, gather_over: int = 5, drop_self_loops: bool = True, normalise=None, written: bool = False) -> DataFrame:
    """(A, C, n): accounts joined by more than ``gather_over`` intermediaries, A sending to more than ``scatter_over``.

    Edges that can't be on such a path go before paths are made: second legs to receivers
    with too few senders, then first legs to accounts without a second leg, then senders
    with too few of those left. With ``written`` the edges are written at each step: where rows come
    out of joins, that is cheaper than to compute them for each step anew.
    """
    keep = scratch.saved if written else lambda e, name: e
    links = keep(_legs(edges(rows, normalise), "a", "b"), "edges")
    onward = links.where("a <> b") if drop_self_loops else links
    receivers = onward.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > gather_over).select("b")
    second = keep(onward.join(receivers, "b", "left_semi").select(F.col("a").alias("b"), F.col("b").alias("c")), "second")
    return _counted(_reaching(links, second, scatter_over, gather_over, drop_self_loops, keep), second, gather_over)


def ends(pairs: DataFrame) -> DataFrame:
    """Distinct (bank, account) of both ends of pairs."""
    return pairs.select(F.explode(F.array(*(F.struct(F.col(f"{x}_bank").alias("bank"), F.col(f"{x}_account").alias("account")) for x in "ac"))).alias("e")).select("e.*").distinct()


def filled_rates(rates: DataFrame, first: str, last: str) -> DataFrame:
    """A row for every day from first to last and currency: the last published day's rates hold until the next.

    A currency that the published day lacks stays missing, and nothing comes before the first day.
    """
    published = rates.select("rate_date").distinct().withColumn("published", F.col("rate_date"))
    calendar = rates.sparkSession.range(1).select(F.explode(scalars.days_between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("rate_date"))
    # one row a day: the calendar is far smaller than any table of facts
    last_seen = F.last("published", ignorenulls=True).over(Window.orderBy("rate_date").rowsBetween(Window.unboundedPreceding, 0))
    days = calendar.join(published, "rate_date", "full_outer").withColumn("published", last_seen).where(F.col("published").isNotNull() & F.col("rate_date").between(first, last))
    return days.join(rates.withColumnRenamed("rate_date", "published"), "published").select("rate_date", "iso", "rate")


def once_by_id(rows: DataFrame, *ids: str, order: list[str]) -> DataFrame:
    """One row for each id, the first of ``order``; rows with a null id are never duplicates.

    The least struct of all columns is taken, so none of them may be a map.
    """
    last = ids[-1]
    known = rows.where(F.col(last).isNotNull())
    rest = [c for c in rows.columns if c not in ids and c not in order]
    first = known.groupBy(*ids).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*ids, *(F.col(f"r.{c}") for c in (*order, *rest))).select(*rows.columns)
    return first.unionByName(rows.where(F.col(last).isNull()))


def row_hash(columns: list[str], seed: int) -> Column:
    """64 bits of a row. Nulls leave a hash as it is, so their places are hashed too."""
    return F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in columns), F.concat(*(F.col(f"`{c}`").isNull().cast("string") for c in columns)))


def fingerprints(rows: DataFrame, *by: Column | str) -> DataFrame:
    """(by, n, x, y): for each group its number of rows and two sums of 64-bit row hashes.

    Sums don't depend on the order of rows, and they combine before the shuffle, so no row is
    shuffled. Groups with the same three numbers have the same rows, but for odds of 2^-128.
    """
    columns = sorted(rows.columns)
    # sums as decimals: those of 64-bit numbers overflow
    total = lambda seed: F.sum(row_hash(columns, seed).cast("decimal(20,0)"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), total(1).alias("x"), total(2).alias("y"))


#: Buckets of rows that are compared by fingerprint before rows are.
BUCKETS = 4096


def differences(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with other multiplicities on the two sides, whatever the order: none if the tables are equal.

    Both sides are fingerprinted by buckets of their rows' hashes; only the rows of
    buckets that differ are shuffled and compared, so tables that are nearly equal cost a scan each.
    """
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        raise ValueError(f"columns differ: {columns} and {sorted(b.columns)}")
    bucket = F.pmod(row_hash(columns, 3), F.lit(buckets))
    ours, theirs = (fingerprints(t.select(*(F.col(f"`{c}`") for c in columns)), bucket.alias("bucket_of_row")) for t in (a, b))
    same = ours.join(theirs.toDF("bucket_of_row", "n2", "x2", "y2"), "bucket_of_row", "full").where(F.expr("NOT (n <=> n2 AND x <=> x2 AND y <=> y2)")).select("bucket_of_row")
    # a row for each bucket at most
    suspect = lambda t: t.select(*(F.col(f"`{c}`") for c in columns), bucket.alias("bucket_of_row")).join(F.broadcast(same), "bucket_of_row", "left_semi").drop("bucket_of_row")
    signed = suspect(a).withColumn("_n", F.lit(1)).unionByName(suspect(b).withColumn("_n", F.lit(-1)))
    return signed.groupBy(*(f"`{c}`" for c in columns)).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def compared(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """A row for each key (client, query): rows on either side, and whether they are the same rows, by fingerprint."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        raise ValueError(f"columns differ: {columns} and {sorted(b.columns)}")
    ours, theirs = (fingerprints(t, *keys) for t in (a, b))
    theirs = theirs.select(*(F.col(k).alias(f"{k}_2") for k in keys), F.col("n").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    on = reduce(lambda p, q: p & q, (ours[k].eqNullSafe(theirs[f"{k}_2"]) for k in keys))
    both = ours.join(theirs, on, "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(*(F.coalesce(k, f"{k}_2").alias(k) for k in keys), n("n").alias("n_a"), n("n2").alias("n_b"), F.expr("n <=> n2 AND x <=> x2 AND y <=> y2").alias("equal"))


def silent(events: DataFrame, roster: DataFrame, entity: str, as_of: str, timeout_s: int) -> DataFrame:
    """Entities of the roster without an event in the ``timeout_s`` seconds to ``as_of``, those that never had one too."""
    last = events.where(F.col("ts") <= F.lit(as_of).cast("timestamp")).groupBy(entity).agg(F.max("ts").alias("last_ts"))
    away = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_ts")
    return roster.join(last, entity, "left").withColumn("silent_s", away).where(F.col("silent_s").isNull() | (F.col("silent_s") > timeout_s))


def gaps(events: DataFrame, entity: str, timeout_s: int) -> DataFrame:
    """(entity, from_ts, to_ts, alerts): pauses over the timeout, an alert for each full timeout in them."""
    before = F.lag("ts").over(Window.partitionBy(entity).orderBy("ts"))
    pause = F.unix_timestamp("to_ts") - F.unix_timestamp("from_ts")
    rows = events.select(entity, before.alias("from_ts"), F.col("ts").alias("to_ts")).where("from_ts is not null")
    return rows.withColumn("alerts", F.floor((pause - 1) / timeout_s).cast("bigint")).where(pause > timeout_s)
