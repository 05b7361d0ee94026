"""Conversation structure repair by Hirschberg's divide and conquer (operator 11).

A conversation should read ``(system? (user assistant)+)?`` by the initials of its roles.
Each row is kept (0), reroled to user or assistant (2) or deleted (3); blank rows and
rows whose role and text were seen before must go; empty user and assistant turns can be
inserted anywhere (2); a truncated row that stays adds 1. Four states say what was
written last: nothing, a system, a user, an assistant turn. Of the cheapest edits those
whose audit (their initials, ``D I K R``) is least in ASCII are taken.

A step (a row, or a run of rows) is the cost of the way from each state to each state,
with the order of the least audits that start in the same state. ``crossings`` finds the
states between steps by halves: forward costs meet backward costs in the middle, and of
the cheapest crossings the one with the least audit so far is taken, which the forward
pass knows without the audits: of two ways to a middle neither audit begins with the other
(each ends with the edit of the same last row), so the order is settled there. The halves
recurse; only two vectors of four numbers are kept beside the crossings.

Nothing needs a conversation in one task. Rows that are equal in turn, role and text are
one row with a number of copies. The table is put in global order by range partitions,
without texts, and cut into blocks of ``BLOCK`` rows; a conversation inside one block is
repaired there. Of others each block becomes a step, ``FAN`` steps become one until a
conversation has one; then the crossings are found level by level back to the blocks. Repeated
texts are found by the least turn of each (conversation, digest). Texts meet
their edits by (conversation, turn, digest). Only ``summary`` follows a conversation's order
in one task, row by row, as a SHA-256 must, and its audit is as long as the conversation.

Defined results: null roles and texts are one space, so such a role has to be replaced
and such a text is blank; null turns come first and count in no gap; rows of one turn are
ordered by role, then by a digest of the text; a null ``conv_id`` is a conversation of its own;
repeated rows are duplicates; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ranked
from .workspace import Workspace

BLOCK = FAN = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
FAR = 1 << 60
#: White space, and marks that end a text.
WHITE, MARKS = " \t\n\x0b\x0c\r", ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn that is written next by the rule, user or assistant.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}

#: One step: for each state before it, (state after, cost, order among those of the same state before).
Step = tuple[tuple[tuple[int, int, object], ...], ...]


@functools.cache
def row_step(sign: int) -> Step:
    """The step of a row: 0..3 is the role's initial (system, user, assistant, other), 4 must go, 8 is cut off. Its order is the edits' initials.

    More than one insertion before a row comes back to the states that fewer reach, and one
    before a deletion is never least: after it, it costs the same and the audit is less.
    """
    initial, must, cut = sign & 3, bool(sign & 4), CUT if sign & 8 else 0
    out = []
    for s in range(4):
        best = {s: (DELETE, "D")}
        for inserted in () if must else (0, 1):
            at = NEXT[s] if inserted else s
            ways = [(NEXT[at], REROLE, "R")]
            if (initial == 0 and at == START) or (initial == 1 and NEXT[at] == USER) or (initial == 2 and NEXT[at] == ASSISTANT):
                ways.append(((SYSTEM, USER, ASSISTANT)[initial], KEEP, "K"))
            for t, cost, letter in ways:
                way = (inserted * INSERT + cost + cut, "I" * inserted + letter)
                best[t] = min(best.get(t, way), way)
        out.append(tuple((t, *way) for t, way in sorted(best.items())))
    return tuple(out)


#: After the last row: what has to be inserted so that the conversation may end; all ways lead to state 0.
END: Step = tuple(((START, INSERT * n, "I" * n),) for n in (0, 2, 1, 0))


def forward(costs: list[int], ranks: list[int], step: Step) -> tuple[list[int], list[int]]:
    """Costs of the states after a step, and the order of their least audits."""
    best: dict[int, tuple] = {}
    for s in range(4):
        if costs[s] < FAR:
            for t, cost, order in step[s]:
                way = (costs[s] + cost, ranks[s], order)
                if t not in best or way < best[t]:
                    best[t] = way
    after, places = [FAR] * 4, [0] * 4
    for place, t in enumerate(sorted(best, key=lambda t: best[t][1:])):
        after[t], places[t] = best[t][0], place
    return after, places


def backward(costs: list[int], step: Step) -> list[int]:
    """The cost to go from each state before a step, out of those after it."""
    return [min((cost + costs[t] for t, cost, _ in ways), default=FAR) for ways in step]


def _only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def crossings(steps: Sequence[Step], first: int, last: int) -> list[int]:
    """The states between the steps, ends included, of the cheapest way with the least audit."""
    out = [first] * (len(steps) + 1)
    out[-1] = last
    todo = [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        costs, ranks = _only(out[lo]), [0] * 4
        for k in range(lo, mid):
            costs, ranks = forward(costs, ranks, steps[k])
        rest = _only(out[hi])
        for k in range(hi - 1, mid - 1, -1):
            rest = backward(rest, steps[k])
        out[mid] = min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))
        todo += [(lo, mid), (mid, hi)]
    return out


def combined(steps: Sequence[Step]) -> Step:
    """Several steps as one; its order is a number."""
    out = []
    for s in range(4):
        costs, ranks = _only(s), [0] * 4
        for step in steps:
            costs, ranks = forward(costs, ranks, step)
        out.append(tuple((t, costs[t], ranks[t]) for t in range(4) if costs[t] < FAR))
    return tuple(out)


def best_end(step: Step) -> tuple[int, int]:
    """(state before the end, whole cost) of a conversation that is one step."""
    costs, ranks = forward(_only(START), [0] * 4, step)
    last = min(range(4), key=lambda s: (costs[s] + END[s][0][1], ranks[s]))
    return last, costs[last] + END[last][0][1]


def edits(signs: Sequence[int], first: int, last: int) -> tuple[list[int], list[str]]:
    """The states between the rows, and each row's initials (insertions before it included)."""
    steps = [row_step(sign) for sign in signs]
    states = crossings(steps, first, last)
    return states, [next(order for t, _, order in steps[k][states[k]] if t == states[k + 1]) for k in range(len(steps))]


@functools.lru_cache(1 << 16)
def whole(signs: tuple[int, ...]) -> tuple[int, int, list[int], list[str]]:
    """(cost, last state, states, initials) of a conversation's rows; conversations are much alike."""
    last, cost = best_end(combined([row_step(sign) for sign in signs]))
    return cost, last, *edits(signs, START, last)


# ---- rows


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults that a checksum of ``conv_id:turn`` (nulls: one space) decides: a row is lost, emptied, without marks, doubled, or its role lost."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _keyed(turns: DataFrame) -> DataFrame:
    """Rows with keys that are never null: conversation, turn, role and digest of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    return turns.select(conv.isNotNull().alias("named"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.isNotNull().alias("timed"), F.coalesce(turn, F.lit(0)).alias("turn"), text("role").alias("role"), text("text").alias("text")).withColumn("digest", F.unhex(F.md5("text")))


CONV = ["named", "conv"]
ROW = [*CONV, "timed", "turn", "role", "digest"]


def _bare() -> Column:
    return F.rtrim("text", F.lit(WHITE))


def _signed(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Distinct rows in global order (``rank`` from 0) with their sign and copies, without texts; written."""
    white = _bare() == ""
    cut = ~F.right(_bare(), F.lit(1)).isin(*MARKS)
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    light = rows.select(*ROW, white.alias("blank"), cut.alias("cut"), initial.alias("initial"))
    # equal rows combine before they are shuffled
    once = light.groupBy(*ROW).agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("blank", "cut", "initial")))
    same = [*CONV, "role", "digest"]
    seen = once.groupBy(*same).agg(F.min(F.struct("timed", "turn")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = once.join(seen, same, "left").withColumn("again", F.coalesce(F.struct("timed", "turn") > F.col("least"), F.lit(False)))
    sign = F.col("initial") + F.when(F.col("blank") | F.col("again"), 4).otherwise(0) + F.when(F.col("cut"), 8).otherwise(0)
    lean = marked.select(*ROW, "copies", "blank", sign.cast("int").alias("sign"))
    return ranked(lean, ws, "signed", *ROW)


# ---- blocks

BLOCK_ROWS = "array<struct<rank:long,timed:boolean,turn:long,role:string,digest:binary,copies:long,sign:int>>"
EDITS = pa.schema([("named", pa.bool_()), ("conv", pa.int64()), ("block", pa.int64()), ("cost", pa.int64()), ("audit", pa.large_string()), ("illegal", pa.int64()), ("edits", pa.list_(pa.struct([("rank", pa.int64()), ("timed", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("inserted", pa.string()), ("now", pa.string())])))])
EDITS_DDL = "named boolean, conv long, block long, cost long, audit string, illegal long, edits array<struct<rank:long,timed:boolean,turn:long,role:string,digest:binary,inserted:string,now:string>>"
STEPS = "array<array<struct<t:int,cost:long,place:int>>>"


def _step(value: list[list[dict]]) -> Step:
    return tuple(tuple((w["t"], w["cost"], w["place"]) for w in ways) for ways in value)


def _block(row: dict, cost: int, last: int, ends: bool, states: list[int], letters: list[str]) -> dict:
    """What a block's edits are in audit, rows and pairs of neighbours inside it."""
    audit, out, illegal, before = [], [], 0, None
    for k, r in enumerate(row["rows"]):
        own = letters[k]
        audit += [own, "D" * (r["copies"] - 1)]
        initial = r["sign"] & 3
        illegal += r["copies"] - 1 + (before is not None and (before, initial) not in ((0, 1), (1, 2), (2, 1)))
        before = initial
        if own != "D":
            inserted = NAMES[NEXT[states[k]]] if own[0] == "I" else None
            out.append({x: r[x] for x in ("rank", "timed", "turn", "role", "digest")} | {"inserted": inserted, "now": NAMES[states[k + 1]] if own[-1] == "R" else r["role"]})
    if ends:
        audit.append(END[last][0][2])
    return {"named": row["named"], "conv": row["conv"], "block": row["block"], "cost": cost + sum(DELETE * (r["copies"] - 1) for r in row["rows"]), "audit": "".join(audit), "illegal": illegal, "edits": out}


def _emit(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, EDITS)


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in one block."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            signs = tuple(r["sign"] for r in row["rows"])
            if len(signs) <= 64:
                cost, last, states, letters = whole(signs)
            else:
                last, cost = best_end(combined([row_step(x) for x in signs]))
                states, letters = edits(signs, START, last)
            out.append(_block(row, cost, last, True, states, letters))
        yield _emit(out)


def _solve_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of longer conversations, between states that are known; the cost is the conversation's, in its last block."""
    for b in batches:
        yield _emit([_block(row, row["cost"] if row["ends"] else 0, row["last"], row["ends"], *edits([r["sign"] for r in row["rows"]], row["first"], row["last"])) for row in b.to_pylist()])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pylist([{"named": row["named"], "conv": row["conv"], "block": row["block"], "step": _dicts(combined([row_step(r["sign"]) for r in row["rows"]]))} for row in b.to_pylist()], STEP_SCHEMA)


def _dicts(step: Step) -> list[list[dict]]:
    return [[{"t": t, "cost": cost, "place": place} for t, cost, place in ways] for ways in step]


STEP_SCHEMA = pa.schema([("named", pa.bool_()), ("conv", pa.int64()), ("block", pa.int64()), ("step", pa.list_(pa.list_(pa.struct([("t", pa.int32()), ("cost", pa.int64()), ("place", pa.int32())]))))])
STEP_DDL = f"named boolean, conv long, block long, step {STEPS}"
CROSS_SCHEMA = pa.schema([("named", pa.bool_()), ("conv", pa.int64()), ("block", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("ends", pa.bool_()), ("cost", pa.int64())])
CROSS_DDL = "named boolean, conv long, block long, first int, last int, ends boolean, cost long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pylist([{"named": row["named"], "conv": row["conv"], "block": row["block"], "step": _dicts(combined([_step(c["step"]) for c in row["children"]]))} for row in b.to_pylist()], STEP_SCHEMA)


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row in b.to_pylist():
            last, cost = best_end(_step(row["step"]))
            out.append({"named": row["named"], "conv": row["conv"], "block": row["block"], "first": START, "last": last, "ends": True, "cost": cost})
        yield pa.RecordBatch.from_pylist(out, CROSS_SCHEMA)


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row in b.to_pylist():
            children = row["children"]
            states = crossings([_step(c["step"]) for c in children], row["first"], row["last"])
            out += [{"named": row["named"], "conv": row["conv"], "block": c["block"], "first": states[k], "last": states[k + 1], "ends": row["ends"] and k == len(children) - 1, "cost": row["cost"]} for k, c in enumerate(children)]
        yield pa.RecordBatch.from_pylist(out, CROSS_SCHEMA)


def _crossed(blocks: DataFrame, ws: Workspace, top: int, fan: int) -> DataFrame:
    """(conversation, block, first, last, ends, cost) of the blocks of conversations that have several."""
    levels = [ws.save(blocks.mapInArrow(_steps, STEP_DDL), "steps-0")]
    groups = []
    while top > 0:
        grouped = levels[-1].groupBy(*CONV, F.floor(F.col("block") / fan).alias("above")).agg(F.array_sort(F.collect_list(F.struct("block", "step"))).alias("children")).withColumnRenamed("above", "block")
        groups.append(ws.save(grouped, f"groups-{len(groups)}"))
        levels.append(ws.save(groups[-1].mapInArrow(_merge, STEP_DDL), f"steps-{len(groups)}"))
        top //= fan
    known = levels[-1].mapInArrow(_top, CROSS_DDL)
    for k, group in reversed(list(enumerate(groups))):
        known = ws.save(group.join(known, [*CONV, "block"]).mapInArrow(_descend, CROSS_DDL), f"crossed-{k}")
    return known


def repair(turns: DataFrame, ws: Workspace, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(repaired, found): the repaired turns, and a row of figures for each conversation that has rows.

    ``repaired`` is (named, conv, rank, nth, role, text, edit): the turns that were kept,
    reroled or inserted, in the order of rank and nth. ``found`` has the faults, the cost and
    the audit. A conversation id that is null has ``named`` false.
    """
    rows = _keyed(turns)
    signed = _signed(rows, ws)
    fields = F.struct("rank", "timed", "turn", "role", "digest", "copies", "sign")
    blocks = ws.save(signed.groupBy(*CONV, F.floor(F.col("rank") / block).alias("block")).agg(F.array_sort(F.collect_list(fields)).alias("rows")), "blocks")
    spans = blocks.groupBy(*CONV).agg(F.count("*").alias("n"))
    several = ws.save(spans.where("n > 1").select(*CONV), "several")  # at most one for each edge between blocks
    done = blocks.join(several, CONV, "left_anti").mapInArrow(_solve_whole, EDITS_DDL)
    top = blocks.join(several, CONV, "left_semi").agg(F.max("block")).first()[0]
    if top is not None:
        long = blocks.join(several, CONV, "left_semi")
        crossed = _crossed(long, ws, top, fan)
        done = done.unionByName(long.join(crossed, [*CONV, "block"]).mapInArrow(_solve_part, EDITS_DDL))
    done = ws.save(done, "edits")

    each = done.select(*CONV, F.explode("edits").alias("e")).select(*CONV, "e.*")
    texts = rows.groupBy(*ROW).agg(F.first("text").alias("text"))
    kept = each.join(texts, ROW)
    nothing = F.lit("")
    turn = lambda role, text, edit, nth: F.struct(F.lit(nth).alias("nth"), role.alias("role"), text.alias("text"), edit.alias("edit"))
    inserted = F.when(F.col("inserted").isNotNull(), turn(F.col("inserted"), nothing, F.lit("I"), 0))
    own = turn(F.col("now"), F.col("text"), F.when(F.col("now") == F.col("role"), "K").otherwise("R"), 1)
    turns_of = kept.select(*CONV, "rank", F.explode(F.array_compact(F.array(inserted, own))).alias("t")).select(*CONV, "rank", "t.*")
    tail = F.regexp_extract("audit", "(I*)$", 1)  # only a conversation's last block ends with insertions
    behind = F.when(tail == "II", F.array(F.lit("user"), F.lit("assistant"))).when(tail == "I", F.array(F.lit("assistant")))
    added = done.select(*CONV, F.posexplode(behind).alias("nth", "role")).select(*CONV, F.lit((1 << 62) + 0).alias("rank"), "nth", "role", nothing.alias("text"), F.lit("I").alias("edit"))
    repaired = turns_of.unionByName(added)

    again = ~F.col("blank") & (F.col("sign").bitwiseAND(4) > 0)
    stays = F.col("sign").bitwiseAND(4) == 0
    faults = signed.groupBy(*CONV).agg(
        F.coalesce(F.max(F.when(F.col("timed"), F.col("turn"))) - F.min(F.when(F.col("timed"), F.col("turn"))) + 1 - F.count_distinct(F.when(F.col("timed"), F.col("turn"))), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(again, F.col("copies")).when(stays, F.col("copies") - 1).otherwise(0)).alias("duplicate"),
        F.count_if(stays & (F.col("sign").bitwiseAND(8) > 0)).alias("truncated"),
    )
    initial = F.col("sign").bitwiseAND(3)
    firsts = signed.where(F.col("rank") % block == 0).select(*CONV, (F.col("rank") - 1).alias("rank"), initial.alias("right"))
    lasts = signed.where(F.col("rank") % block == block - 1).select(*CONV, "rank", initial.alias("left"))
    legal = F.concat_ws("-", F.col("left").cast("string"), F.col("right").cast("string")).isin("0-1", "1-2", "2-1")
    between = lasts.join(firsts, [*CONV, "rank"]).where(~legal).groupBy(*CONV).agg(F.count("*").alias("more"))
    pieces = done.groupBy(*CONV).agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    found = faults.join(pieces, CONV).join(between, CONV, "left").withColumn("illegal", F.col("illegal") + F.coalesce("more", F.lit(0))).drop("more")
    return repaired, found


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's SHA-256 over its turns as they pass."""
    now, digest = None, None
    schema = pa.schema([("named", pa.bool_()), ("conv", pa.int64()), ("repaired_sha256", pa.string())])
    for b in batches:
        out = []
        for row in b.to_pylist():
            key = (row["named"], row["conv"])
            if key != now:
                if now is not None:
                    out.append({"named": now[0], "conv": now[1], "repaired_sha256": digest.hexdigest()})
                now, digest, mark = key, hashlib.sha256(), b""
            digest.update(mark + f"{row['role']}:{row['text']}".encode("utf-8", "surrogatepass"))
            mark = b"\n"
        yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"named": now[0], "conv": now[1], "repaired_sha256": digest.hexdigest()}], schema)


NOTHING = hashlib.sha256().hexdigest()


def summary(original: DataFrame, turns: DataFrame, ws: Workspace, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every id of ``original``, repaired from ``turns``."""
    repaired, found = repair(turns, ws, block, fan)
    dealt = repaired.repartition(*CONV).sortWithinPartitions(*CONV, "rank", "nth")
    sums = dealt.select(*CONV, "role", "text").mapInArrow(_sums, "named boolean, conv long, repaired_sha256 string")
    every = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(F.col("conv_id").isNotNull().alias("named"), F.coalesce("conv_id", F.lit(0)).alias("conv"))
    joined = every.join(found, CONV, "left").join(sums, CONV, "left")
    numbers = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return joined.select(F.when(F.col("named"), F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


#: ``summary`` of the damaged table in SQL: a search that carries every state's whole audit from row to row.
SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM m WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, max(i) OVER (PARTITION BY conv_id) AS n FROM o),
nx AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) t(s, t)),
w AS (
SELECT conv_id, n, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS out FROM (SELECT DISTINCT conv_id, n FROM f)
UNION ALL
SELECT conv_id, n, i, s, cost, audit, out FROM (
SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS k FROM (
SELECT b.conv_id, b.n, b.i + 1 AS i, CASE e.e WHEN 'D' THEN b.s WHEN 'R' THEN nx.t ELSE CASE left(f.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS s,
b.cost + CASE e.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.e <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS cost, b.audit || e.e AS audit,
CASE e.e WHEN 'D' THEN b.out WHEN 'R' THEN list_append(b.out, CASE nx.t WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text) ELSE list_append(b.out, f.role || ':' || f.text) END AS out
FROM (SELECT conv_id, n, i, s, cost, audit, out FROM w UNION ALL SELECT conv_id, n, i, nx.t, cost + 2, audit || 'I', list_append(out, CASE nx.t WHEN 2 THEN 'user:' ELSE 'assistant:' END) FROM w JOIN nx ON nx.s = w.s) b
JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN nx ON nx.s = b.s CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(e)
WHERE e.e = 'D' OR (coalesce(f.fault, '') NOT IN ('blank', 'duplicate') AND (e.e = 'R' OR (left(f.role, 1) = 's' AND b.s = 0) OR (left(f.role, 1) = 'u' AND nx.t = 2) OR (left(f.role, 1) = 'a' AND nx.t = 3))))) WHERE k = 1),
z AS (SELECT conv_id, cost + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit, CASE s WHEN 1 THEN out || ['user:', 'assistant:'] WHEN 2 THEN out || ['assistant:'] ELSE out END AS out FROM w WHERE i = n),
r AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""
