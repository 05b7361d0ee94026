"""Chat formatting in budgeted windows (operator 7).

Every turn is framed by the template and its tokens are counted before rows move. Turns
end in a line break, and the tokenizer never merges across white space, so a window
has exactly the sum of its turns' tokens. Prefix sums of the tokens over range
partitions then choose the spans: with ``room`` tokens beside the system turn, a turn
belongs to the window of the half room that its prefix sum falls in, so the turns of a
window are at most room together; a turn over half the room is a window of its own.
A window repeats the system turn, if the conversation starts with one, and as many
whole turns before its own as fit ``HISTORY`` tokens and the budget. Loss spans cover the
text of assistant turns that are new in the window; repeated ones are masked, so every
target is trained on once.

Template: system turns ``<<SYS>>text<</SYS>>``, user turns ``[INST] text [/INST]``,
assistant turns ``text</s>``, other roles ``<s>role<s>text</s>``, each with a line
break behind it. Control strings and backslashes inside texts get a backslash in front;
``parse`` undoes it.

No step needs a conversation's rows in one task: order and sums come from range
partitions, windows are built by (conversation, window). Only ``digests`` follows the
order of a conversation, as a SHA-256 must; its texts are read back before that, in parallel.

Defined results: null texts and roles are empty; equal turn numbers are ordered by role
and a digest of the text; null turns come first; a null ``conv_id`` is a conversation too; a
turn longer than the room is a window of its own, with the system turn, and over the
budget; so is every turn beside a system turn as long as the budget; repeated rows are
turns of their own; other columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoder
from .ordering import range_parted, running_start
from .workspace import Workspace

BUDGET, HISTORY = 1024, 256
#: The template's control strings.
CONTROLS = ("</s>", "<s>", "[/INST]", "[INST]", "<</SYS>>", "<<SYS>>")
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)) + r"|\\")
TOKEN = re.compile(rf"\\(?P<plain>{CONTROL.pattern})|(?P<control>{'|'.join(map(re.escape, CONTROLS))})")
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}
TURNS = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "piece": pa.string(), "begin": pa.int32(), "end": pa.int32(), "tokens": pa.int64()}
WINDOWS = {"conv_id": pa.int64(), "window": pa.int64(), "start": pa.int64(), "n_repeated": pa.int32(), "n_tokens": pa.int64(), "text": pa.string(), "loss_begin": pa.list_(pa.int32()), "loss_end": pa.list_(pa.int32())}
SCHEMA = "conv_id long, window long, start long, n_repeated int, n_tokens long, text string, loss_begin array<int>, loss_end array<int>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return TOKEN.sub(lambda m: m["plain"] or m[0], text)


def framed(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, begin and end of the escaped text in it)."""
    before, after = MARKS.get(role, (f"<s>{escape(role)}<s>", "</s>"))
    body = escape(text)
    return before + body + after + "\n", len(before), len(before) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a formatted window; begin and end are those of the escaped text."""
    out, at = [], 0
    ends = {"<</SYS>>": "system", "[/INST]": "user"}
    name = None  # of a turn of another role, once its mark is read
    for m in TOKEN.finditer(window):
        mark = m["control"]
        if mark is None:
            continue
        if mark in ends:
            stop = m.start() - (mark == "[/INST]")
            out.append((ends[mark], unescape(window[at:stop]), at, stop))
            at = m.end() + 1  # past the line break
        elif mark == "</s>":
            out.append(("assistant" if name is None else unescape(name), unescape(window[at : m.start()]), at, m.start()))
            at, name = m.end() + 1, None
        elif mark == "<s>":
            if m.start() > at or (window[m.start() - 3 : m.start()] == "<s>" and name == ""):
                name = window[at : m.start()]
            else:
                name = ""
            at = m.end()
        else:
            at = m.end() + (mark == "[INST]")
    return out


def _record(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))


def _framed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for b in batches:
            out = []
            for conv, turn, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                piece, begin, end = framed(role or "", text or "")
                out.append({"conv_id": conv, "turn": turn, "role": role or "", "piece": piece, "begin": begin, "end": end, "tokens": len(ids(piece.encode())) // 4})
            yield _record(out, TURNS)

    return run


ORDER = ("conv_id", "turn", "role", "digest")


def _opened(parted: DataFrame) -> DataFrame:
    """Adds ``opening``, (at, system) of the conversation's first turn, to turns with their place ``at`` in the whole order.

    A conversation may begin in an earlier partition; what is carried on is a row for each partition.
    """
    key = F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")  # nulls first
    first = F.struct("at", F.when(F.col("role") == "system", F.col("tokens")).otherwise(0).cast("long").alias("system"))
    own = parted.withColumns({"key": key, "opening": F.min(first).over(Window.partitionBy("_part", "conv_id"))})
    ends = own.groupBy("_part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("opening", "key").alias("opening")).orderBy("_part").collect()
    carried, last, opening = [], None, None
    for r in ends:
        begun = (opening["at"], opening["system"]) if last == r["first"] else None
        if begun:
            carried.append((r["_part"], begun))
        if not (begun and r["last"] == r["first"]):
            opening = r["opening"]
        last = r["last"]
    spark = parted.sparkSession
    before = spark.createDataFrame(carried, "_part int, begun struct<at: long, system: long>")
    firsts = spark.createDataFrame([(r["_part"], tuple(r["first"])) for r in ends], "_part int, lead struct<known: boolean, conv_id: long>")
    joined = own.join(F.broadcast(before), "_part", "left").join(F.broadcast(firsts), "_part")
    return joined.withColumn("opening", F.when(F.col("begun").isNotNull() & (F.col("key") == F.col("lead")), F.col("begun")).otherwise(F.col("opening"))).drop("key", "lead", "begun")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation, window and place to windows; one window is held at a time."""
    names = ("conv_id", "window", "start", "role", "piece", "begin", "end", "tokens", "new")
    now, rows = None, []

    def window() -> dict:
        new = [r for r in rows if r[-1]]
        opens = not new or new[0][2] == 0  # a system turn is new in the first window
        text, begins, ends, repeated, at = [], [], [], 0, 0
        for _, _, _, role, piece, begin, end, _, is_new in rows:
            fresh = opens if is_new is None else is_new
            repeated += not fresh
            if fresh and role == "assistant":
                begins.append(at + begin)
                ends.append(at + end)
            text.append(piece)
            at += len(piece)
        return {"conv_id": now[0], "window": now[1], "start": new[0][2] if new else 0, "n_repeated": repeated, "n_tokens": sum(r[7] for r in rows), "text": "".join(text), "loss_begin": begins, "loss_end": ends}

    for b in batches:
        out = []
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            if now != row[:2]:
                if rows:
                    out.append(window())
                now, rows = row[:2], []
            rows.append(row)
        yield _record(out, WINDOWS)
    if rows:
        yield _record([window()], WINDOWS)


def format_windows(turns: DataFrame, tokenizer: str, ws: Workspace, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Write and give the windows of ``turns`` (conv_id, turn, role, text); ``window`` counts up in each conversation, with gaps."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # written once; until the windows are known, only numbers and digests move
    pieces = rows.mapInArrow(_framed(tokenizer), "conv_id long, turn long, role string, piece string, begin int, end int, tokens long")
    pieces = ws.save(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    parted = range_parted(pieces.select("id", "conv_id", "turn", "role", F.unhex(F.md5("piece")).alias("digest"), "tokens"), ws, "ordered", *ORDER)
    placed = _opened(running_start(parted, "tokens", *ORDER, out="at"))
    # beside the system turn: tokens before this turn, and the half of the room that they fall in
    start = F.col("at") - F.col("opening.at") - F.col("opening.system")
    half = F.greatest(F.floor((F.lit(budget) - F.col("opening.system")) / 2), F.lit(1))
    placed = placed.withColumns({"is_system": (F.col("at") == F.col("opening.at")) & (F.col("role") == "system"), "start": start, "half": half, "system": F.col("opening.system")})
    placed = placed.withColumn("window", 2 * F.floor(F.col("start") / F.col("half")) + (F.col("tokens") > F.col("half")).cast("long"))
    placed = ws.save(placed.select("id", "conv_id", "window", "start", "tokens", "is_system", "half", "system"), "placed")
    ws.drop("ordered")
    new, system = placed.where("not is_system"), placed.where("is_system")
    # free tokens of each window; no more than a half, so that a turn is repeated in the next windows only
    free = F.least(F.lit(history), F.first("half"), F.lit(budget) - F.first("system") - F.sum("tokens"))
    windows = ws.save(new.groupBy(F.col("conv_id").alias("conv"), F.col("window").alias("w")).agg(F.min("start").alias("first"), free.alias("free")), "spans")
    same = F.col("conv_id").eqNullSafe(F.col("conv"))
    # a turn of an even window can precede the odd one of its half and both of the next
    near = (F.col("window") / 2 + 1) * F.col("half") - F.col("start") <= history
    following = F.array(F.col("window") + 1, F.when(near, F.col("window") + 2), F.when(near, F.col("window") + 3))
    candidates = new.where("window % 2 = 0").withColumn("next", F.explode(F.array_compact(following)))
    repeated = candidates.join(windows, same & (F.col("next") == F.col("w"))).where("first > start and first - start <= free").withColumn("window", F.col("next"))
    everywhere = system.join(windows.select("conv", "w"), same, "left").withColumns({"window": F.coalesce("w", F.lit(0).cast("long")), "start": F.lit(-1).cast("long")})
    flagged = lambda rows, new: rows.select("id", "window", "start", F.lit(new).cast("boolean").alias("new"))
    every = flagged(new, True).unionByName(flagged(repeated, False)).unionByName(flagged(everywhere, None))
    whole = every.join(pieces.select("id", "conv_id", "role", "piece", "begin", "end", "tokens"), "id")
    dealt = whole.repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "start")
    out = ws.save(dealt.mapInArrow(_built, SCHEMA), "windows")
    for name in ("pieces", "placed", "spans"):
        ws.drop(name)
    return out


READ = {"conv_id": pa.int64(), "window": pa.int64(), "n_turns": pa.int64(), "turns": pa.binary(), "loss_chars": pa.int64(), "loss": pa.binary(), "formatted_chars": pa.int64()}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is new in each window, out of its text."""
    for b in batches:
        out = []
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "window", "n_repeated", "text", "loss_begin", "loss_end")]
        for conv, window, n_repeated, text, begins, ends in zip(*cols, strict=True):
            new = parse(text)[n_repeated:]
            loss = "".join(unescape(text[begin:end]) for begin, end in zip(begins, ends, strict=True))
            out.append({"conv_id": conv, "window": window, "n_turns": len(new), "turns": "".join(f"{role}\n{body}\n" for role, body, _, _ in new).encode("utf-8", "surrogatepass"), "loss_chars": len(loss), "loss": loss.encode("utf-8", "surrogatepass"), "formatted_chars": len(text)})
        yield _record(out, READ)


class _Digest:
    def __init__(self, conv_id):
        self.row = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_windows": 0}
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, n_turns: int, turns: bytes, loss_chars: int, loss: bytes, formatted_chars: int) -> None:
        self.turns.update(turns)
        self.loss.update(loss)
        for name, n in (("n_turns", n_turns), ("loss_chars", loss_chars), ("formatted_chars", formatted_chars), ("n_windows", 1)):
            self.row[name] += n

    def end(self) -> dict:
        return self.row | {"turns_sha256": self.turns.hexdigest(), "loss_sha256": self.loss.hexdigest()}


DIGESTS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_windows": pa.int64()}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for b in batches:
        out = []
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss_chars", "loss", "formatted_chars")]
        for conv, *row in zip(*cols, strict=True):
            if now is None or now.row["conv_id"] != conv:
                if now is not None:
                    out.append(now.end())
                now = _Digest(conv)
            now.add(*row)
        yield _record(out, DIGESTS)
    if now is not None:
        yield _record([now.end()], DIGESTS)


def digests(windows: DataFrame) -> DataFrame:
    """Read windows back: a row of counts and SHA-256 sums for each conversation."""
    read = windows.select("conv_id", "window", "n_repeated", "text", "loss_begin", "loss_end").mapInArrow(_read, "conv_id long, window long, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long")
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
