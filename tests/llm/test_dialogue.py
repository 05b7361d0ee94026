"""Repair of conversations against a plain search that carries every whole audit."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from txloom.llm import dialogue
from txloom.llm.workspace import Workspace

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
KIND = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def with_insertions(ways):
    for state, (cost, audit, out) in ways.items():
        yield state, (cost, audit, out)
        for _ in range(3):
            state = NEXT[state]
            cost, audit, out = cost + 2, audit + "I", (*out, (NAMES[state], ""))
            yield state, (cost, audit, out)


def repaired(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    turns, seen = [r[1] for r in rows if r[1] is not None], set()
    n = {"blank": 0, "duplicate": 0, "truncated": 0, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0}
    n["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    ways = {"": (0, "", ())}
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            n[fault] += 1
        seen.add((role, text))
        new = {}

        def put(state, way, new=new):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for state, (cost, audit, out) in with_insertions(ways):
            put(state, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                cost += fault is not None
                to, initial = NEXT[state], role[:1]
                put(to, (cost + 2, audit + "R", (*out, (NAMES[to], text))))
                if initial == to or (initial == "s" and not state):
                    put(initial, (cost, audit + "K", (*out, (role, text))))
        ways = new
    cost, audit, out = min((w for s, w in with_insertions(ways) if s in ("", "a")), key=lambda w: w[:2])
    return n | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def plain(rows):
    kept = damaged(rows)
    return {conv: repaired([r for r in kept if r[0] == conv]) for conv in {r[0] for r in rows}}


def odd_rows(seed, lengths, convs):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        for k in range(rng.choice(lengths)):
            role = rng.choice(["user", "assistant", "system", "assistant", "user", None, "", "tool", "usr"])
            text = rng.choice(["Hi.", "x", "", "  \n", "ok!", "a? ", None, f"new {rng.randrange(999)}.", f"cut {rng.randrange(99)}", "é…?"])
            rows.append((conv, rng.choice([None, k, k, k, rng.randrange(20)]), role, text))
    return rows + rng.sample(rows, len(rows) // 20)


def figures(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize(("block", "fan"), [(dialogue.BLOCK, dialogue.FAN), (16, 4), (2, 2)])
def test_repair_is_the_least_of_all(spark, block, fan):
    """Short and long conversations, in one block and over several levels of blocks."""
    rows = odd_rows(3, [0, 1, 2, 5, 9, 30, 120], [None, *range(25)])
    df = spark.createDataFrame([(*r, "x", True) for r in rows], KIND + ", digest string, conv boolean").repartition(5)
    assert figures(dialogue.summary(df, dialogue.damaged(df), Workspace(spark, "dialogue"), block, fan)) == plain(rows)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = figures(dialogue.summary(df, dialogue.damaged(df), Workspace(spark, "dialogue")))
    assert got == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_sql():
    rows = [r for r in odd_rows(4, [0, 1, 2, 5, 12], [None, *range(40)]) if r[2] not in ("", None)]
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.sql(dialogue.SQL)
    assert {r[0]: dict(zip(found.columns[1:], r[1:], strict=True)) for r in found.fetchall()} == plain(rows)


def test_one_conversation_over_many_tasks(spark):
    """A conversation far longer than a block, most of whose rows are one repeated turn."""
    rows = [(7, k, ("user", "assistant")[k % 2], f"turn {k}." if k % 3 else "again.") for k in range(3000)]
    df = spark.createDataFrame(rows, KIND)
    repaired, found = dialogue.repair(df, Workspace(spark, "dialogue"), 64, 8)
    want = repaired_of(rows)
    assert [(r.cost, r.audit) for r in found.collect()] == [(want["cost"], want["audit"])]
    assert [r["count"] for r in repaired.groupBy("edit").count().orderBy("edit").collect()] == [want["audit"].count(x) for x in "IKR" if x in want["audit"]]


def repaired_of(rows):
    return repaired([(c, t, r, x) for c, t, r, x in rows])


def test_edges(spark):
    empty = spark.createDataFrame([], KIND)
    assert dialogue.summary(empty, dialogue.damaged(empty), Workspace(spark, "dialogue")).count() == 0
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "system", "Only this.")]
    df = spark.createDataFrame(rows, KIND)
    _, found = dialogue.repair(df, Workspace(spark, "dialogue"))
    assert {r.conv: (r.cost, r.audit) for r in found.collect()} == {1: (3, "KKD"), 2: (3, "D")}


def test_crossings_take_the_least_audit():
    rng = random.Random(5)
    for _ in range(400):
        signs = [rng.choice([0, 1, 2, 3, 9, 10, 4, 5]) for _ in range(rng.randrange(9))]
        cost, last, states, letters = dialogue.whole(tuple(signs))
        assert dialogue.best_end(dialogue.combined([dialogue.combined([dialogue.row_step(s) for s in signs[:3]]), dialogue.combined([dialogue.row_step(s) for s in signs[3:]])])) == (last, cost)
        found = {"": (0, "")}
        states_of = {"": 0, "s": 1, "u": 2, "a": 3}
        for sign in signs:
            new = {}
            for state, (c, a, _) in with_insertions({k: (*v, ()) for k, v in found.items()}):
                for to, extra, letter in [(t, x, w) for t, x, w in dialogue.row_step(sign)[states_of[state]] if "I" not in w]:
                    name = "_sua"[to].strip("_")
                    new[name] = min(new.get(name, (c + extra, a + letter)), (c + extra, a + letter))
            found = new
        want = min((c, a) for s, (c, a, _) in with_insertions({k: (*v, ()) for k, v in found.items()}) if s in ("", "a"))
        assert (cost, "".join(letters) + dialogue.END[last][0][2]) == want
