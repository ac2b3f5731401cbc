"""What other runs' events at a station show to queries there: observed, waiting and resolved ones, by type and window.

An event counts for the cuts of an interval: seen from when it had happened and was accepted until the window has passed, waiting
from its scheduled time until it happens. Events and queries meet by station in slices of time, in one sweep each; no pair is
a row, and a busy station is as many groups as it has slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import MINUTE
from . import sweep
from .sweep import FAR, NONE

SEEN, WAITING, ANSWERED, OLD = range(4)
#: For each query, station, type and window. told: seen ones with a delay; last_*: the last of them; by_*: of what resolved waiting
#: ones; old: scheduled in the window and seen by now.
SHOWN = {
    "seen": "long", "told": "long", "delay_sum": "double", "delay_max": "double", "last_act": "long", "last_s": "long", "last_ord": "long",
    "last_delay": "double", "pending": "long", "resolved": "long", "pending_from": "long"
}
CLOCKS = {
    "seen_act": "long", "seen_acc": "long", "told_act": "long", "told_acc": "long", "open_acc": "long", "wait_acc": "long", "by_act": "long",
    "by_acc": "long", "old": "long", "old_act": "long", "old_acc": "long"
}


def with_resolution(feed: DataFrame) -> DataFrame:
    """Events with resolved: the first moment after which a later (or equal) event of the run is done and known; null if none ever is."""
    clear = F.when(F.col("act").isNotNull() & F.col("acc").isNotNull() & F.col("d").isNotNull() & F.col("n").isNotNull(), F.greatest("act", "acc"))
    later = W.partitionBy("d", "n").orderBy(F.col("s").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return feed.where("s is not null").withColumn("resolved", F.min(clear).over(later))


def answered(feed: DataFrame, window: int, home: int | None = None) -> DataFrame:
    """(d, n, st, start, end, by_act, by_acc): for cuts in (start, end] the latest clocks of a run's events that resolve any of its
    waiting ones at the station. The earliest waiting event has all that resolve others, so one of each run counts at a time."""
    span = window * MINUTE
    kind = feed.schema["st"].dataType.simpleString()
    names = {"d": "date", "n": "long", "st": kind, "start": "long", "end": "long", "by_act": "long", "by_acc": "long"}

    def clocks(t: pa.Table) -> pa.Table:
        s, act, acc, st = (sweep.ints(t[c]) for c in ("s", "act", "acc", "st"))
        when = np.where((act == NONE) | (acc == NONE), FAR, np.maximum(act, acc))
        begin, end = np.where(acc == NONE, FAR, np.maximum(s, acc)), np.minimum(s + span, np.where(act == NONE, FAR, act))
        some, out = np.flatnonzero(when < FAR), []
        for one in np.unique(st[st > NONE]) if home is None else [home]:
            o = np.flatnonzero((st == one) & (begin < end))
            if not len(o) or not len(some):
                continue
            cut = np.unique(np.concatenate([begin[o], end[o], when[some]]))
            first = sweep.Stabs(cut, np.full(len(cut), -1)).best(begin[o], end[o], np.zeros(len(o), np.int64), sweep.ordered(-s[o]))
            since = np.concatenate([[NONE], cut[:-1]])
            ask = np.flatnonzero(first >= 0)
            by_act, by_acc = sweep.dominant(when[some], s[some], [act[some], acc[some]], cut[ask], s[o][first[ask]])
            ask, by_act, by_acc = (x[by_act > NONE] for x in (ask, by_act, by_acc))
            if len(ask):
                same = (ask[1:] == ask[:-1] + 1) & (by_act[1:] == by_act[:-1]) & (by_acc[1:] == by_acc[:-1])
                head, tail = np.flatnonzero(np.append(True, ~same)), np.flatnonzero(np.append(~same, True))
                out.append((np.full(len(head), one), since[ask[head]], cut[ask[tail]], by_act[head], by_acc[head]))
        if not out:
            return pa.schema([(c, sweep.KINDS[k]) for c, k in names.items()]).empty_table()
        cols = [np.concatenate(x) for x in zip(*out)]
        base = t.select(["d", "n"]).take(np.zeros(len(cols[0]), np.int64))
        return sweep.pack(names, {"d": base["d"], "n": base["n"]} | dict(zip(list(names)[2:], cols)))

    e = feed.where("s is not null and d is not null and n is not null").select("d", F.col("n").cast("long").alias("n"), "st", "s", "act", "acc")
    return e.groupBy("d", "n").applyInArrow(clocks, sweep.ddl(names))


def sliced(rows: DataFrame, width: int) -> DataFrame:
    """Rows that hold for cuts in (start, end], once for each slice of time that these lie in."""
    return rows.where(F.col("start") < F.col("end")).withColumn(
        "slice", F.explode(F.sequence(F.floor((F.col("start") + 1) / F.lit(width)), F.floor(F.col("end") / F.lit(width))))
    )


def codes(*tables: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Each table's runs as whole numbers, equal ones alike."""
    d, n = (np.unique(np.concatenate(x), return_inverse=True)[1].astype(np.int64) for x in zip(*tables))
    both = np.unique(d * (n.max(initial=0) + 1) + n, return_inverse=True)[1].astype(np.int64)
    return np.split(both, np.cumsum([len(x) for x, _ in tables])[:-1])


def shown(q: DataFrame, feed: DataFrame, keys: list[str], station: str, windows: tuple, kinds: tuple = (None,), clocks: bool = False, home: int | None = None, by_ord: bool = True) -> DataFrame:
    """(keys, station, kind, window, SHOWN, and CLOCKS if asked for): other runs' events at each query's station, of each type (None: all)
    in each window. The last one is so by act, then earliest schedule, then earliest input order if by_ord, then greatest delay. Queries have d, n, cut; all stay
    that have a station and a cut. home: the only station there is."""
    longest = max(windows) * MINUTE
    e = with_resolution(feed).where(F.col("st").isNotNull() & F.col("acc").isNotNull())
    if home is not None:
        e = e.where(F.col("st") == home)
    facts = ["d", "n", "st", "ty", "s", "act", "acc", "delay", "ord", "resolved"]
    act = F.coalesce("act", F.lit(FAR))
    seen = e.where("act is not null").select(*facts, F.lit(SEEN).alias("part"), F.greatest("act", "acc").alias("start"), (F.col("act") + longest).alias("end"))
    wait = e.select(*facts, F.lit(WAITING).alias("part"), F.greatest("s", "acc").alias("start"), F.least(F.col("s") + longest, act).alias("end"))
    rows = seen.unionByName(wait)
    if clocks:
        none = lambda *names: [F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in names]
        old = e.where("act is not null").select(*facts, F.lit(OLD).alias("part"), F.greatest("s", "act", "acc").alias("start"), (F.col("s") + longest).alias("end"))
        by = answered(feed, max(windows), home).select(
            "d", F.col("n").cast(feed.schema["n"].dataType).alias("n"), "st", *none("ty", "s"), F.col("by_act").alias("act"), F.col("by_acc").alias("acc"),
            *none("delay", "ord"), F.lit(None).cast("long").alias("resolved"), F.lit(ANSWERED).alias("part"), "start", "end"
        )
        rows = rows.unionByName(old).unionByName(by)
    rows = sliced(rows, longest).select(*(F.col(c).alias(f"o_{c}") for c in (*facts, "part", "start", "end", "slice")))
    at = q.where(F.col(station).isNotNull() & F.col("cut").isNotNull()).select(
        *keys, F.col(station).alias("at"), "d", "n", "cut", F.floor(F.col("cut") / F.lit(longest)).alias("slice")
    )
    names = {c: at.schema[c].dataType.simpleString() for c in (*keys, "at")} | {"kind": "string", "window": "long"} | SHOWN | (CLOCKS if clocks else {})
    there = {f"o_{c}": rows.schema[f"o_{c}"].dataType.simpleString() for c in (*facts, "part", "start", "end")}

    def sight(own: pa.Table, events: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.schema([(c, sweep.KINDS[k]) for c, k in names.items()]).empty_table()
        if not events.num_rows:  # such a side comes without columns
            events = pa.table([pa.array([], sweep.KINDS[k]) for k in there.values()], names=list(there))
        cut = sweep.ints(own["cut"])
        d, n, s, act, acc, ord_, part, start, end, until = (sweep.ints(events[f"o_{c}"]) for c in ("d", "n", "s", "act", "acc", "ord", "part", "start", "end", "resolved"))
        until, delay, ty = np.where(until == NONE, FAR, until), sweep.reals(events["o_delay"]), events["o_ty"].to_numpy()
        mine, run = codes((sweep.ints(own["d"]), sweep.ints(own["n"])), (d, n))
        stabs, out = sweep.Stabs(cut, mine), []
        last = sweep.ordered(act, -s, -ord_ * by_ord, np.nan_to_num(delay, nan=-np.inf))

        def most(at, values, to):
            best = stabs.best(start[at], to[at], run[at], sweep.ordered(values[at]))
            return sweep.either(best, values[at], NONE)

        known = lambda x: (x, x > NONE)
        for kind in kinds:
            of = np.ones(len(s), bool) if kind is None else (ty == kind) | (part == ANSWERED)
            for w in windows:
                to = np.minimum(end, np.where(part == SEEN, act, np.where(part == ANSWERED, FAR, s)) + w * MINUTE)
                seen, wait, old, by = (np.flatnonzero(of & (part == x)) for x in (SEEN, WAITING, OLD, ANSWERED))
                told = seen[~np.isnan(delay[seen])]
                total = lambda at, x=None, to=to: stabs.total(start[at], to[at], run[at], x)
                best = stabs.best(start[told], to[told], run[told], sweep.ordered(last[1][told]))
                best = sweep.either(best, told, -1)
                n_told, waits = total(told), total(wait)
                pending = stabs.total(start[wait], np.minimum(to, until)[wait], run[wait])
                earliest = stabs.best(start[wait], np.minimum(to, until)[wait], run[wait], sweep.ordered(-s[wait]))
                highest = stabs.best(start[told], to[told], run[told], sweep.ordered(delay[told]))
                fact = lambda x, none=NONE, best=best: (sweep.either(best, x, none), best >= 0)
                cols = {c: own[c] for c in (*keys, "at")} | {
                    "kind": pa.array([kind] * len(cut), pa.string()), "window": np.full(len(cut), w), "seen": total(seen), "told": n_told,
                    "delay_sum": (total(told, delay[told]), n_told > 0), "delay_max": (sweep.either(highest, delay[told], 0), highest >= 0),
                    "last_act": fact(act), "last_s": fact(s), "last_ord": fact(ord_), "last_delay": fact(delay, 0), "pending": pending,
                    "resolved": waits - pending, "pending_from": known(sweep.either(earliest, s[wait], NONE))
                }
                if clocks:
                    cols |= {
                        "seen_act": known(most(seen, act, to)), "seen_acc": known(most(seen, acc, to)), "told_act": known(most(told, act, to)),
                        "told_acc": known(most(told, acc, to)), "open_acc": known(most(wait, acc, np.minimum(to, until))),
                        "wait_acc": known(most(wait, acc, to)), "by_act": known(most(by, act, to)), "by_acc": known(most(by, acc, to)),
                        "old": total(old), "old_act": known(most(old, act, to)), "old_acc": known(most(old, acc, to))
                    }
                out.append(sweep.pack(names, cols))
        return pa.concat_tables(out)

    return at.groupBy("at", "slice").cogroup(rows.groupBy("o_st", "o_slice")).applyInArrow(sight, sweep.ddl(names))
