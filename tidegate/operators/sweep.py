"""Sweeps over clocks: what each query sees of a group's events, with no row, cell or loop turn for each pair.

A query sees an event from a moment on, after which its cut must lie, and perhaps no longer than to another moment. With
cut = s - lag every condition (accepted, scheduled before the query, happened) is such a moment, so a group is sorted by it and
queries look up running values, intervals and spans of powers of two. Work is events plus queries times a logarithm, for
each different lag of a group, of which there is one as a rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unknown, and before any time; after any time.
NONE, FAR = -(1 << 62), 1 << 62
KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "date": pa.date32()}


def ints(column) -> np.ndarray:
    if pa.types.is_date32(column.type):
        column = pc.cast(column, pa.int32())
    return pc.fill_null(pc.cast(column, pa.int64()), NONE).to_numpy()


def reals(column) -> np.ndarray:
    """Unknown numbers are NaN."""
    return pc.fill_null(pc.cast(column, pa.float64()), float("nan")).to_numpy()


def texts(column) -> np.ndarray:
    """Codes in the order of bytes; -1 is null."""
    values = pc.fill_null(column, "").to_pylist()
    code = {v: k for k, v in enumerate(sorted(set(values), key=str.encode))}
    return np.where(column.is_null().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.is_null().to_numpy(), -1, np.array([code[v] for v in values], np.int64))


def ordered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of these columns, and each row's place in it."""
    rows = np.lexsort(columns[::-1])
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    return rows, place


def either(at, values, none):
    """values[at], or none where at is -1."""
    return np.where(at >= 0, values[at], none) if len(values) else np.full(len(at), none)


class Timeline:
    """Rows in the order of the moment after which a query sees them."""

    def __init__(self, at: np.ndarray, where: np.ndarray | None = None):
        rows = np.arange(len(at)) if where is None else np.flatnonzero(where)
        self.rows = rows[np.argsort(at[rows], kind="stable")]
        self.at = at[self.rows]

    def count(self, cut: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, cut)

    def latest(self, values: np.ndarray, cut: np.ndarray, none=NONE) -> np.ndarray:
        return np.concatenate([[none], np.maximum.accumulate(values[self.rows])])[self.count(cut)]

    def earliest(self, values: np.ndarray, cut: np.ndarray, none=FAR) -> np.ndarray:
        return np.concatenate([[none], np.minimum.accumulate(values[self.rows])])[self.count(cut)]

    def total(self, values: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(values[self.rows])])[self.count(cut)]

    def best(self, order: tuple[np.ndarray, np.ndarray], cut: np.ndarray, k: int = 1) -> list[np.ndarray]:
        """The k rows seen that are last in an order, the last one first; -1 if there are fewer."""
        by, place = order
        x, out, n = place[self.rows], [], self.count(cut)
        for _ in range(k):
            most = np.concatenate([[-1], np.maximum.accumulate(x)]) if len(x) else np.array([-1])
            out.append(either(most[n], by, -1))
            x = np.minimum(most[:-1], x)  # what the new row, or the one that it displaces, leaves to the next
        return out

    def passes(self, values: np.ndarray, bound: np.ndarray, beyond: bool = False) -> np.ndarray:
        """The moment after which the greatest value seen is at least (or beyond) each bound."""
        most = np.maximum.accumulate(values[self.rows])
        return np.append(self.at, FAR)[np.searchsorted(most, bound, "right" if beyond else "left")]


class Spans:
    """Least values of spans of powers of two: the nearest row whose value lies below a bound."""

    def __init__(self, values: np.ndarray):
        self.n, self.least = len(values), [values]
        while 2 * (w := 1 << (len(self.least) - 1)) <= self.n:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-w], last[w:]))

    def after(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first row from start on whose value is below bound; n if there is none."""
        at = start.astype(np.int64, copy=True)
        for k in range(len(self.least) - 1, -1, -1) if self.n else ():
            fits = at + (1 << k) <= self.n
            at += (fits & (self.least[k][np.where(fits, at, 0)] >= bound)) << k
        return at

    def before(self, stop: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last row before stop whose value is below bound; -1 if there is none."""
        at = stop.astype(np.int64, copy=True)
        for k in range(len(self.least) - 1, -1, -1) if self.n else ():
            low = at - (1 << k)
            at -= ((low >= 0) & (self.least[k][np.maximum(low, 0)] >= bound)) << k
        return at - 1

    def lowest(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The least value of rows start to stop, stop excluded; all ranges have rows."""
        level = np.frexp((stop - start).astype(float))[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][start[at]], self.least[k][stop[at] - (1 << int(k))])
        return out


def seen_in(start: np.ndarray, end: np.ndarray, cut: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """How many rows (or the sum of whole weights) have start < cut <= end."""
    end = np.maximum(start, end)
    if weight is None:
        return np.searchsorted(np.sort(start), cut) - np.searchsorted(np.sort(end), cut)
    return Timeline(start).total(weight, cut) - Timeline(end).total(weight, cut)


def successive(known: Spans, at: np.ndarray, stop: np.ndarray, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of queries that want the last known row before stop and have at (or -1) to begin with: (query, row, from, to), each
    row that is the last known one in its turn and the moments between which it is. Rows get known at the moments of known; after limit nothing is followed."""
    query, out = np.arange(len(at)), []
    limit = np.full(len(at), FAR) if limit is None else limit
    at, since = at.astype(np.int64), np.full(len(at), NONE)
    while len(query):
        more = at + 1 < stop
        nxt, when = np.full(len(at), -1), np.full(len(at), FAR)
        if more.any():
            when[more] = known.lowest(at[more] + 1, stop[more])
            nxt[more] = known.before(stop[more], when[more] + 1)
        out.append((query, at, since, when))
        go = when < limit[query]
        query, at, since, stop = query[go], nxt[go], when[go], stop[go]
    both = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4
    some = both[1] >= 0
    return tuple(x[some] for x in both)


class Stabs:
    """Queries in order of their cuts; rows that hold for cuts in (start, end] meet them as ranges. own and group: codes of
    which a query's own one does not count for it."""

    def __init__(self, cut: np.ndarray, own: np.ndarray):
        self.order = np.argsort(cut, kind="stable")
        self.cut, self.own, self.n = cut[self.order], own[self.order], len(cut)
        self.keys = self.own * (self.n + 1) + np.arange(self.n)
        self.inside = np.argsort(self.keys)
        self.keys = self.keys[self.inside]

    def back(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def total(self, start, end, group, weight=None) -> np.ndarray:
        """For each query the number of rows, or the sum of their weights."""
        low, high = np.searchsorted(self.cut, start, "right"), np.searchsorted(self.cut, end, "right")
        high = np.maximum(low, high)

        def run(a, b):
            kind = np.int64 if weight is None else weight.dtype
            steps = np.zeros(self.n + 1, kind)
            np.add.at(steps, a, 1 if weight is None else weight)
            np.subtract.at(steps, b, 1 if weight is None else weight)
            return np.cumsum(steps)[:-1]

        mine = np.empty(self.n, np.int64 if weight is None else weight.dtype)
        base = group * (self.n + 1)
        mine[self.inside] = run(np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high))
        return self.back(run(low, high) - mine)

    def best(self, start, end, group, order) -> np.ndarray:
        """For each query the row that is last in an order, -1 if there is none. Ranges are two overlapping spans of a power of
        two; a span keeps its best row and the best one of another group, which go down to the single queries."""
        by, place = order
        low, high = np.searchsorted(self.cut, start, "right"), np.searchsorted(self.cut, end, "right")
        rows = np.flatnonzero(high > low)
        group_at = group[by] if len(by) else np.empty(0, np.int64)
        level = np.frexp((high - low)[rows].astype(float))[1] - 1
        first = second = None

        def merged(a, b, c, d):
            """The two best of different groups, of two such pairs."""
            top, low_ = np.maximum(a, c), np.minimum(a, c)
            same = (low_ >= 0) & (group_at[top] == group_at[low_]) if len(group_at) else np.zeros(len(top), bool)
            rest = np.where(a >= c, b, d)  # of the pair with the top, another group than the top's
            other = np.where(a >= c, d, b)
            return top, np.where(same, np.maximum(rest, other), np.maximum(rest, low_))

        for k in range(int(level.max(initial=0)), -1, -1):
            n = self.n - (1 << k) + 1
            one, two = np.full(n, -1), np.full(n, -1)
            if first is not None:  # a span of the level above covers two of this one
                half = 1 << k
                m = len(first)
                one[:m], two[:m] = first, second
                one[half:half + m], two[half:half + m] = merged(one[half:half + m], two[half:half + m], first, second)
            at = rows[level == k]
            if len(at):
                cell = np.concatenate([low[at], high[at] - (1 << k)])
                x = np.concatenate([place[at], place[at]])
                np.maximum.at(top := np.full(n, -1), cell, x)
                other = group_at[x] != group_at[top[cell]]
                np.maximum.at(next_ := np.full(n, -1), cell[other], x[other])
                one, two = merged(one, two, top, next_)
            first, second = one, two
        if first is None or not len(group_at):
            return np.full(self.n, -1)
        x = np.where((first >= 0) & (group_at[first] == self.own), second, first)
        return self.back(either(x, by, -1))

    def least(self, start, end, group, values, ranks: list[np.ndarray]) -> list[np.ndarray]:
        """For each query the values of its rows at each of these places of their order, from 0 on; what lies beyond them means nothing.
        All queries halve the different values at once: a step counts the rows of each query's lower half."""
        kinds, code = np.unique(values, return_inverse=True)
        if not len(kinds):
            return [np.full(self.n, np.nan) for _ in ranks]
        low, high = np.searchsorted(self.cut, start, "right"), np.searchsorted(self.cut, end, "right")
        high, size = np.maximum(low, high), self.n + 1
        groups = int(max(group.max(), self.own.max(initial=0))) + 1
        at, own = np.tile(np.arange(self.n), len(ranks)), np.tile(self.own, len(ranks))
        left, half = np.concatenate([r[self.order] for r in ranks]), np.zeros(len(at), np.int64)

        def seen(rows, wanted):
            rows, wanted = rows * size, wanted * size + at
            return np.searchsorted(np.sort(rows + low), wanted, "right") - np.searchsorted(np.sort(rows + high), wanted, "right")

        for bit in range((len(kinds) - 1).bit_length() - 1, -1, -1):
            part, half = code >> bit, half << 1
            n = seen(part, half) - seen(part * groups + group, half * groups + own)
            up = left >= n
            left, half = left - np.where(up, n, 0), half + up
        found = kinds[np.minimum(half, len(kinds) - 1)]
        return [self.back(x) for x in np.split(found, len(ranks))]


def dominant(at: np.ndarray, key: np.ndarray, values: list[np.ndarray], cut: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """The greatest of each of values over rows with at < cut and key >= least, NONE if there are none; without values the number of such rows. Prefixes in order of at are
    blocks of powers of two, each sorted by key."""
    line = Timeline(at)
    n, size = line.count(cut), len(at)
    key_, facts = key[line.rows], [v[line.rows] for v in values]
    by = np.argsort(key_, kind="stable")
    place = np.empty(size, np.int64)
    place[by] = np.arange(size)
    floor = np.searchsorted(key_[by], least)  # rows with at least this place qualify
    out, total = [np.full(len(cut), NONE) for _ in values], np.zeros(len(cut), np.int64)
    for k in range(size.bit_length()):
        asks = np.flatnonzero((n >> k) & 1)
        if not len(asks):
            continue
        block = np.arange(size) >> k
        inner = np.lexsort((-place, block))  # within a block, greatest key first
        ids = block[inner] * (size + 1) + (size - place[inner])
        which = (n[asks] >> (k + 1)) << 1
        end = np.searchsorted(ids, which * (size + 1) + (size - floor[asks]), "right")
        begin = which << k
        total[asks] += end - begin
        for o, v in zip(out, facts):
            width = 1 << k
            padded = np.full(-(-size // width) * width, NONE)
            padded[:size] = v[inner]
            most = np.maximum.accumulate(padded.reshape(-1, width), axis=1).ravel()
            o[asks] = np.maximum(o[asks], np.where(end > begin, most[np.maximum(end, 1) - 1], NONE))
    return out or [total]


def pack(names: dict[str, str], columns: dict) -> pa.Table:
    """A table of these columns and kinds; a column is an Arrow one, values, or values and which of them are known."""
    out = []
    for name, kind in names.items():
        x = columns[name]
        if isinstance(x, (pa.Array, pa.ChunkedArray)):
            out.append(x)
            continue
        values, known = x if isinstance(x, tuple) else (x, np.ones(len(x), bool))
        kind = KINDS[kind]
        out.append(pa.array(np.where(known, values, 0).astype(kind.to_pandas_dtype()), kind, mask=~known))
    return pa.table(out, names=list(names))


def ddl(names: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in names.items())


class Run:
    """A run's events with the moments after which queries with a lag see them as known, planned, done, usable, and so on."""

    def __init__(self, t: pa.Table, gated: bool = True):
        self.s, self.act, self.acc, self.st, self.ord = (ints(t[c]) for c in ("s", "act", "acc", "st", "ord"))
        self.delay, self.ty = reals(t["delay"]), texts(t["ty"])
        self.arrival, self.departure = (pc.fill_null(pc.equal(t["ty"], kind), False).to_numpy() for kind in ("ARRIVAL", "DEPARTURE"))
        self.stopping, self.n, self.gated = ints(t["stopping"]) == 1, t.num_rows, gated

    def see(self, lag: int) -> None:
        self.known = np.where(self.acc == NONE, FAR, self.acc) if self.gated else np.full(self.n, NONE)
        before = self.s - lag if lag != FAR else np.full(self.n, FAR)
        self.planned, self.reached = np.maximum(self.known, before), np.maximum(self.known, before - 1)
        self.due = np.maximum(self.planned, self.s)
        self.done = np.maximum(self.planned, np.where(self.act == NONE, FAR, self.act))
        self.usable = np.where(np.isnan(self.delay), FAR, self.done)


EVENT = ("st", "ty", "s", "act", "acc", "delay", "ord", "stopping")


def by_run(q: DataFrame, feed: DataFrame, names: dict[str, str], see, gated: bool = True) -> DataFrame:
    """see(own, run, cut, s): columns of a run's queries with one lag; own: their table. Queries without a run meet no events."""
    kinds = {f"e_{c}": feed.schema[c].dataType.simpleString() for c in EVENT}
    e = feed.where("s is not null and d is not null and n is not null").select(*(F.col(c).alias(f"e_{c}") for c in ("d", "n", *EVENT)))
    own = q.select("qid", "d", "n", "st", "ty", "s", "cut")

    def sweep(asked: pa.Table, events: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.schema([(c, KINDS[k]) for c, k in names.items()]).empty_table()
        if not events.num_rows:  # such a side comes without columns
            events = pa.table([pa.array([], KINDS[k]) for k in kinds.values()], names=list(kinds))
        run, out = Run(events.select(list(kinds)).rename_columns(list(EVENT)), gated), []
        cut, s = ints(asked["cut"]), ints(asked["s"])
        lag = np.where((cut == NONE) | (s == NONE), FAR, s - cut)
        for one in np.unique(lag):
            at = np.flatnonzero(lag == one)
            run.see(int(one))
            out.append(pack(names, see(asked.take(at), run, cut[at], s[at])))
        return pa.concat_tables(out)

    return own.groupBy("d", "n").cogroup(e.groupBy("e_d", "e_n")).applyInArrow(sweep, ddl(names))
