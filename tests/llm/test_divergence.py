"""The divergence audit against plain sums over all terms and pairs, and against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from txloom.llm import divergence
from txloom.llm.workspace import Workspace

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, lang string, source string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain(docs, least=divergence.LEAST, shown=divergence.SHOWN):
    docs = [(t or "", a or "", s or "") for t, a, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(terms(t), s) for t, a, s in docs if a == lang]
        held = Counter(w for ws, _ in mine for w in set(ws))
        kept = sorted(w for w in held if held[w] >= least)
        counts = defaultdict(Counter)
        for ws, s in mine:
            counts[s].update(w for w in ws if held[w] >= least)
        every = sum(counts.values(), Counter())

        def weights(c, kept=kept):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = {s: weights(counts[s]) for s in counts}, weights(every)
        for s in p:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in p if o != s]
            more = [(q[w] - p[s][w], w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(more)[:shown])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(some, 1)]
    return sorted(out)


def audited(spark, docs, **k):
    df = spark.createDataFrame([(n, *d, "x", 5) for n, d in enumerate(docs)], KIND + ", term string, rank int").repartition(3)
    return sorted(map(tuple, divergence.audit(df, Workspace(spark, "divergence"), **k).collect()))


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_audit_is_that_of_all_terms_and_pairs(spark, least):
    rng = random.Random(least)
    words = ["Wort", "wort", "Ünder", "ünder", "a", "b", "éé", "日本", "x1y", *(f"w{chr(97 + k)}" for k in range(26))]
    docs = [(" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 30]))) + rng.choice(["", ".", "\t9"]), rng.choice(["de", "en", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "S2", "é", None])) for _ in range(150)]
    docs += [(None, "fr", "only"), ("", "xx", "a"), ("one", "xx", "b"), ("1 2 3", "yy", None)] + docs[:20]
    assert audited(spark, docs, least=least, shown=4) == plain(docs, least, 4)


def test_empty_tables_and_long_texts(spark, monkeypatch):
    assert divergence.audit(spark.createDataFrame([], KIND), Workspace(spark, "divergence")).count() == 0
    long = "Word " * 300_000 + "x" * 900_000 + " tail"
    docs = [(long, "en", "a"), ("word tail", "en", "b")]
    assert audited(spark, docs, least=1) == plain(docs, 1)


def test_long_texts_are_split_between_terms(monkeypatch):
    rng = random.Random(2)
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(divergence, "PIECE", size)
        for _ in range(200):
            text = "".join(rng.choices("aB é1 .日", k=rng.randrange(60)))
            got = [w.decode() for some in divergence.terms_of(text.encode()) for w in some]
            assert got == terms(text)


def test_full_tables_are_sent_on(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "ENTRIES", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["s", "s", "t"], "text": ["a b c d a", "a e", "a"]})
    total = Counter()
    for b in divergence._counted(iter([batch, batch])):
        for r in b.to_pylist():
            total[r["source"], r["term"]] += r["count"]
            total[r["source"], r["term"], "docs"] += r["docs"]
    assert total["s", "a"] == 6 and total["s", "a", "docs"] == 4 and total["t", "a", "docs"] == 2


def test_the_tree_shares_paths(monkeypatch):
    """Corrections are those of all pairs in all rows, with one addition for each node and its ancestors."""
    rng = random.Random(4)
    rows = Counter()
    for _ in range(400):
        held = sorted(rng.sample(range(6), rng.randrange(2, 6)))
        rows[tuple((x, 10 + x % 3 + rng.randrange(2), 5 + x % 3) for x in held)] += rng.randrange(1, 5)
    want = Counter()
    for row, n in rows.items():
        for k, (x, p, p0) in enumerate(row):
            for y, r, r0 in row[:k]:
                bar = min(r, p0) if (r0, y) < (p0, x) else min(p, r0)
                want[x, y] += n * (min(p, r) - bar)
    for held in (divergence.HELD, 4):
        monkeypatch.setattr(divergence, "HELD", held)
        tree = divergence.Tree()
        calls = []
        add = tree.sums.add
        tree.sums.add = lambda *a, add=add, calls=calls: (calls.append(1), add(*a))
        for row in sorted(rows):
            tree.insert(list(row), rows[row])
        tree.close()
        keys, values = tree.sums.reduce()
        assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(v) for k, v in zip(keys, values, strict=True)} == want
        assert len(calls) == len({row[: d + 1] for row in rows for d in range(1, len(row))}) < sum(len(r) - 1 for r in rows)


def test_weights_pass_64_bits(spark):
    from pyspark.sql import functions as F

    count, n, v = 10**15, 10**16, 10**7
    assert spark.range(1).select(divergence.weight(F.lit(count), F.lit(n), F.lit(v))).first()[0] == 1 + 10**9 * (count + 5) // (n + 5 * v)


def test_whole_table_and_sql(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, divergence.audit(df, Workspace(spark, "divergence")).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(divergence.SQL).fetchall()) == plain([(r.text, r.lang, r.source) for r in df.collect()]) != []
