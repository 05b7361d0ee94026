"""Keyed state of the streaming jobs: what is remembered for each key, and when it goes.

Every processor keeps whole numbers and texts only, so that its state can be read with the
``statestore`` source. Watermarks are those of Spark: rows that come later than the
stream's delay allows are dropped where event time decides, and nowhere else.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Silence(StatefulProcessor):
    """An alert each time an entity was silent for the timeout, by event time; a key is a bucket of entities.

    Calls between Python and the state cost far more than the work on an entity, so a bucket's
    entities are read and written together, as lists side by side. Events wait until the watermark
    has passed them, so they are taken in the order of time whatever the order they come in. One
    timer stands at the bucket's next waiting event or alert. An alert is due when its time is before both the
    next event and the watermark; an entity of the roster is watched from the time the roster gives.
    """

    def __init__(self, entity: str, timeout_s: int):
        self.entity, self.timeout = entity, timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "who array<string>, at array<long>")
        self.last = handle.getValueState("last", "who array<string>, at array<long>, reported array<boolean>, alerts array<long>")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, ms: int) -> None:
        """The bucket's timer, if it has none before."""
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or ms < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def _last(self) -> dict[str, tuple[int, bool, int]]:
        if not self.last.exists():
            return {}
        who, at, reported, alerts = self.last.get()
        return dict(zip(who, zip(at, reported, alerts, strict=True), strict=True))

    def _keep(self, last: dict[str, tuple[int, bool, int]]) -> None:
        self.last.update((list(last), *(list(x) for x in zip(*last.values(), strict=True))))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        last = self._last()
        for who, since in zip(initialState[self.entity].tolist(), initialState["since"].tolist(), strict=True):
            if who not in last or since < last[who][0]:
                last[who] = (int(since), False, 0)
        self._keep(last)
        self._wake((min(at for at, _, _ in last.values()) + self.timeout) * 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        who, at = self.waiting.get() if self.waiting.exists() else ([], [])
        who, at = list(who), list(at)
        for frame in rows:
            who += frame[self.entity].tolist()
            at += [int(x) for x in frame["at"].tolist()]
        self.waiting.update((who, at))
        self._wake(min(at) * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(zip(*self.waiting.get(), strict=True), key=lambda r: r[1]) if self.waiting.exists() else []
        n = bisect.bisect_right(waiting, now, key=lambda r: r[1] * 1000)
        last, step = self._last(), self.timeout * 1000
        found: list[tuple[str, int, bool, int, int]] = []

        def silent(who: str, until: int) -> None:
            """The alerts of an entity that are due before ``until``."""
            at, reported, alerts = last[who]
            upto = -((at * 1000 - until) // step) - 1
            if upto > alerts:
                found.append((who, at, reported, alerts, upto - alerts))
                last[who] = (at, reported, upto)

        for who, end in waiting[:n]:
            if who in last:
                silent(who, end * 1000)
                at, reported, _ = last[who]
                if end < at and reported:
                    continue
            last[who] = (end, True, 0)
        for who in last:
            silent(who, now)
        if n == len(waiting):
            self.waiting.clear()
        elif n:
            self.waiting.update(tuple(list(x) for x in zip(*waiting[n:], strict=True)))
        # the timer that fires goes afterwards, so one that is set anew must be later
        self.due.clear()
        nexts = [(at + (alerts + 1) * self.timeout) * 1000 + 1 for at, _, alerts in last.values()]
        nexts += [at * 1000 for _, at in waiting[n : n + 1]]
        if last:
            self._keep(last)
        if nexts:
            self._wake(min(nexts))
        yield self._alerts(found)

    def _alerts(self, found: list[tuple[str, int, bool, int, int]]) -> pd.DataFrame:
        if not found:
            return pd.DataFrame()
        who, at, reported, before, n = (list(x) for x in zip(*found, strict=True))
        times = np.array(n)
        place = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
        columns = {self.entity: np.array(who, dtype=object), "from_s": np.array(at), "reported": np.array(reported)}
        return pd.DataFrame({k: np.repeat(v, times) for k, v in columns.items()} | {"alert": np.repeat(np.array(before), times) + place + 1})

    def close(self) -> None:
        pass


#: Distinct values of a group that are a row of the state each; those of larger groups share rows, about ``SHARED`` to ``2 * SHARED`` in one.
SINGLE, SHARED = 16, 256
#: Values of a group that are looked up together.
AT_ONCE = 1 << 16


def n_rows(n: int) -> int:
    """Rows of the state that ``n`` values of a group share, a power of two."""
    return max(16, 1 << (n // (2 * SHARED)).bit_length())


class DistinctValues(StatefulProcessor):
    """A group's distinct values; rows leave when the group passes its threshold, and from then on for each new value.

    Calls between Python and the state cost far more than the work on a value, so the values of a group with
    more than ``SINGLE`` are dealt by a checksum to rows that are read and written as a whole, as lists side by
    side. The number of rows doubles as the group grows, which splits each row in two.
    """

    def __init__(self, group: list[str], value: list[str], passes: int):
        self.group, self.value, self.passes = group, value, passes

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = [f"v{k}" for k in range(len(self.value))]
        self.values = handle.getMapState("values", ", ".join(f"{c} string" for c in names), "seen boolean")
        self.shared = handle.getMapState("shared", "number int", ", ".join(f"{c} array<string>" for c in names))
        self.count = handle.getValueState("count", "n long")

    def _held(self, number: int) -> list[tuple[str, ...]]:
        row = self.shared.getValue((number,))
        return list(zip(*row, strict=True)) if row else []

    def _hold(self, number: int, values: list[tuple[str, ...]]) -> None:
        self.shared.updateValue((number,), tuple(list(x) for x in zip(*values, strict=True)))

    def _dealt(self, values: Iterable[tuple[str, ...]], rows: int) -> dict[int, list[tuple[str, ...]]]:
        found: dict[int, list[tuple[str, ...]]] = {}
        for own in values:
            found.setdefault(zlib.crc32("\0".join(own).encode()) % rows, []).append(own)
        return found

    def _added(self, n: int, values: Iterable[tuple[str, ...]]) -> list[tuple[str, ...]]:
        """Keep the values that a group of ``n`` has not; gives them."""
        if n <= SINGLE or self.values.exists():  # a checkpoint of before had all values in rows of their own
            known = dict.fromkeys(tuple(k) for k in self.values.keys()) if n else {}
            new = list(dict.fromkeys(v for v in values if v not in known))
            if n + len(new) <= SINGLE:
                for own in new:
                    self.values.updateValue(own, (True,))
                return new
            self.values.clear()
            for number, own in self._dealt([*known, *new], n_rows(n + len(new))).items():
                self._hold(number, own)
            return new
        new, rows = [], n_rows(n)
        for number, own in self._dealt(values, rows).items():
            held = self._held(number)
            known = set(held)
            fresh = [v for v in own if v not in known]
            if fresh:
                self._hold(number, held + fresh)
                new += fresh
        after = n_rows(n + len(new))
        for number in range(rows if after > rows else 0):
            # the rest by a larger power of two adds multiples of the smaller one
            parts = self._dealt(self._held(number), after)
            for part, own in parts.items():
                self._hold(part, own)
            if parts and number not in parts:
                self.shared.removeKey((number,))
        return new

    def _all(self, n: int) -> Iterator[list[tuple[str, ...]]]:
        """All values of a group of ``n``, in pieces."""
        if n <= SINGLE:
            yield [tuple(k) for k in self.values.keys()]
            return
        some: list[tuple[str, ...]] = []
        for number in range(n_rows(n)):
            some += self._held(number)
            if len(some) >= AT_ONCE:
                yield some
                some = []
        if some:
            yield some

    def _taken(self, key: Any, values: Iterable[tuple[str, ...]]) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        new = self._added(before, values)
        n = before + len(new)
        if not new:
            return
        self.count.update((n,))
        if n < self.passes:
            return
        for sent in [new] if before >= self.passes else self._all(n):
            out = pd.DataFrame(sent, columns=self.value)
            for name, part in zip(self.group, key, strict=True):
                out[name] = part
            out["n_values"] = n
            yield out[[*self.group, *self.value, "n_values"]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple[str, ...], None] = {}
        for frame in rows:
            waiting |= dict.fromkeys(frame[self.value].drop_duplicates().itertuples(index=False, name=None))
            if len(waiting) >= AT_ONCE:
                yield from self._taken(key, waiting)
                waiting = {}
        if waiting:
            yield from self._taken(key, waiting)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


#: Waiting rows in a row of the state at most; fewer than ``FEW`` of a batch are a row each.
BLOCK, FEW = 1024, 16


class Baseline(StatefulProcessor):
    """Late rows wait until the watermark has passed the end of the early period; then those under the ratio of the early mean leave.

    Early rows come as sums of whole units and counts. After the release the mean stands,
    and late rows are answered as they come. Calls between Python and the state cost far more than
    the work on a row, so rows wait in blocks, as lists side by side, and leave block by block.
    """

    def __init__(self, names: list[str], ratio: float, end_ms: int, units: int):
        self.names, self.ratio, self.end, self.units = names, ratio, end_ms, units

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getValueState("early", "total long, n long")
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} string" for c in self.names) + ", amount long")
        self.blocks = handle.getMapState("blocks", "number long", ", ".join(f"{c} array<string>" for c in self.names) + ", amount array<long>")
        self.full = handle.getValueState("full", "n long")

    def _bound(self) -> float | None:
        if not self.early.exists():
            return None  # a key without early rows has no baseline
        total, n = self.early.get()
        return total / self.units / n * self.ratio

    def _under(self, columns: list[list], bound: float | None) -> pd.DataFrame:
        """Of rows, as lists side by side, those under the bound."""
        kept = [] if bound is None else [k for k, amount in enumerate(columns[-1]) if amount / self.units < bound]
        return pd.DataFrame({c: [own[k] for k in kept] for c, own in zip([*self.names, "amount"], columns, strict=True)}) if kept else pd.DataFrame()

    def _wait(self, columns: list[list]) -> None:
        """Keep rows, as lists side by side."""
        if len(columns[-1]) < FEW:
            self.waiting.appendList(list(zip(*columns, strict=True)))
            return
        number = self.full.get()[0] if self.full.exists() else 0
        for at in range(0, len(columns[-1]), BLOCK):
            self.blocks.updateValue((number,), tuple(own[at : at + BLOCK] for own in columns))
            number += 1
        self.full.update((number,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        released = timerValues.getCurrentWatermarkInMs() > self.end
        late: list[list] = [[] for _ in (*self.names, "amount")]
        waits, total, n = False, 0, 0
        for frame in rows:
            early, own = frame[frame["n"] > 0], frame[frame["n"] == 0]
            total, n = total + int(early["amount"].sum()), n + int(early["n"].sum())
            for column, name in zip(late, self.names, strict=False):
                column += own[name].astype(object).where(own[name].notna(), None).tolist()
            late[-1] += own["amount"].tolist()
            if not released and len(late[-1]) >= BLOCK:
                self._wait(late)
                waits, late = True, [[] for _ in late]
        if n:
            before = self.early.get() if self.early.exists() else (0, 0)
            self.early.update((before[0] + total, before[1] + n))
        if released:
            yield self._under(late, self._bound() if late[-1] else None)
            return
        if late[-1]:
            self._wait(late)
        if waits or late[-1]:
            self.handle.registerTimer(self.end)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        bound = self._bound()
        if self.waiting.exists():
            yield self._under([list(column) for column in zip(*self.waiting.get(), strict=True)], bound)
            self.waiting.clear()
        for number in range(self.full.get()[0] if self.full.exists() else 0):
            yield self._under(list(self.blocks.getValue((number,))), bound)
            self.blocks.removeKey((number,))
        self.full.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class LiveParts(StatefulProcessor):
    """Changes of a count as rows of a part come and when the part is discarded.

    On a discard the part's count goes from the state and is taken back; a mark that the part
    is gone stays for ``remember_ms`` only, so that its stragglers don't count.
    """

    def __init__(self, client: str, remember_ms: int):
        self.client, self.remember = client, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.gone = handle.getValueState("gone", "gone boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, ends, now = 0, False, 0
        for frame in rows:
            n += int(frame["n"].sum())
            ends = ends or bool(frame["discard"].any())
            now = max(now, int(frame["arrived_ms"].max()))
        before = self.count.get()[0] if self.count.exists() else 0
        if ends:
            self.count.clear()
            self.gone.update((True,))
            self.handle.registerTimer(now + self.remember)
            change = -before
        elif self.gone.exists():
            change = 0
        else:
            self.count.update((before + n,))
            change = n
        yield pd.DataFrame({self.client: [key[0]], "change": [change]}) if change else pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.gone.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class FirstOfKey(StatefulProcessor):
    """The first row of each key; the key is remembered for ``remember_ms`` from its arrival."""

    def __init__(self, columns: list[str], remember_ms: int):
        self.columns, self.remember = columns, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = next(rows).head(1)
        for _ in rows:  # replays of the same batch
            pass
        if self.seen.exists():
            yield pd.DataFrame()
            return
        self.seen.update((True,))
        self.handle.registerTimer(int(first["arrived_ms"].iloc[0]) + self.remember)
        yield first[self.columns]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass
