"""Adjustment of predictions: baselines, caps and floors, blends, an ordered policy; provenance checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import MINUTE, yes


@dataclass(frozen=True)
class Rule:
    """cap: most that a departure without history may get. Above threshold minutes pending, a row with history gets at least multiplier times that."""

    cap: float | None = None
    threshold: float | None = None
    multiplier: float | None = None

    def __post_init__(self):
        if self.cap is not None and not math.isfinite(self.cap):
            raise ValueError("the cap must be finite or none")
        if self.threshold is not None and not (
            math.isfinite(self.threshold) and self.threshold >= 0 and self.multiplier is not None and math.isfinite(self.multiplier) and self.multiplier > 0
        ):
            raise ValueError("a floor needs a finite threshold of 0 or more and a positive multiplier")

    def __call__(self, p: Column) -> Column:
        history, pending = F.col("history_count") > 0, F.col("oldest_pending_minutes")
        if self.cap is not None:
            p = F.when(~history & yes(F.col("is_departure") == 1), F.least(p, F.lit(float(self.cap)))).otherwise(p)
        if self.threshold is not None:
            p = F.when(history & yes(pending > self.threshold), F.greatest(p, F.lit(float(self.multiplier)) * pending)).otherwise(p)
        return p


def baseline(multiplier: float | None = None, threshold: float | None = None) -> Column:
    """The last known delay or 0; with history and a pending event older than the threshold, at least multiplier times its age."""
    p, pending = F.coalesce(F.col("previous_delay"), F.lit(0.0)), F.col("oldest_pending_minutes")
    if multiplier is None:
        return p
    return F.when((F.col("history_count") > 0) & yes(pending > threshold), F.greatest(p, pending * F.lit(multiplier))).otherwise(p)


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    if not weights or any(not math.isfinite(w) or w <= 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-12:
        raise ValueError("weights must be positive, finite and sum to one")
    return weights


def blend(weights: dict[str, float]) -> Column:
    """The weighted sum of prediction columns."""
    out = F.lit(0.0)
    for name, w in checked_weights(weights).items():
        out = out + F.lit(float(w)) * F.col(name)
    return out


@dataclass(frozen=True)
class Policy:
    """Mixture by event type, bias, scale after early runs, blend in calm context, tail scale, cap and floor, exception; always in that order."""

    arrival: dict[str, float]
    departure: dict[str, float]
    auxiliary: str
    auxiliary_weight: float
    bias: float = 0.0
    early_scale: float = 1.0
    calm: float = 60.0
    tail: float = 240.0
    tail_scale: float = 1.0
    exception: float = 120.0
    rule: Rule = field(default_factory=Rule)

    def __post_init__(self):
        checked_weights(self.arrival), checked_weights(self.departure)
        if not 0 < self.auxiliary_weight < 1:
            raise ValueError("the auxiliary weight lies between zero and one")
        for name in ("bias", "early_scale", "tail", "tail_scale"):
            if not math.isfinite(getattr(self, name)):
                raise ValueError(f"{name} must be finite")
        if self.early_scale <= 0 or self.tail_scale <= 0 or self.tail < 0:
            raise ValueError("scales are positive, the tail threshold is not negative")

    def apply(self, df: DataFrame) -> DataFrame:
        """df with raw, transformed and final. What is missing satisfies no gate; a masked event type is no departure."""
        leaves, early = yes(F.col("is_departure") == 1), yes(F.col("previous_delay") <= 0)
        df = df.withColumn("raw", F.when(leaves, blend(self.departure)).otherwise(blend(self.arrival)))
        t = F.col("raw") + F.lit(self.bias)
        t = F.when(early, t * F.lit(self.early_scale)).otherwise(t)
        df = df.withColumn("_t", t)
        calm = yes(F.col("context_arrival_180m_max_delay") <= self.calm)
        df = df.withColumn(
            "_t",
            F.when(
                calm, F.lit(1 - self.auxiliary_weight) * F.col("_t") + F.lit(self.auxiliary_weight) * F.col(self.auxiliary)
            ).otherwise(F.col("_t"))
        )
        df = df.withColumn("transformed", F.when(early & (F.col("_t") > self.tail), F.col("_t") * F.lit(self.tail_scale)).otherwise(F.col("_t"))).drop("_t")
        back = ~(F.col("history_count") > 0) & leaves & (F.col("origin_actual_presence_count") > 0) & yes(F.col("origin_720m_max_last_delay") > self.exception)
        return df.withColumn("final", F.when(back, F.col("transformed")).otherwise(self.rule(F.col("transformed"))))


def rule_grid(caps=(10.0, 20.0, 30.0), thresholds=(120.0, 180.0, 240.0, 300.0), multipliers=(1.0, 1.25, 1.5, 1.75, 2.0)) -> list[Rule]:
    return [Rule(c, t, m) for c in caps for t in thresholds for m in multipliers]


def grid_scores(df: DataFrame, rules: list[Rule], p: str = "p", y: str = "y", fold: str = "fold") -> DataFrame:
    """(cap, threshold, multiplier, mean_rmse) of each rule on one column of predictions."""
    return rule_search(df, {p: p}, rules, y, fold).drop("configuration", "rule", "rank")


def rule_search(df: DataFrame, configurations: dict[str, str], rules: list[Rule], y: str = "y", fold: str = "fold") -> DataFrame:
    """(configuration, rule, cap, threshold, multiplier, mean_rmse, rank) of every rule, by its place in rules, on every column of predictions.

    Caps, thresholds and multipliers cut the rows' order into cells: how many caps lie below a prediction, how many thresholds
    below the minutes pending, how many multiples of these reach the prediction. Of a cell a rule needs to know only sums, of
    y, its square and its products with the minutes, or of the squared error as it is. So a row is read once for each
    configuration, whatever the number of rules, sums are combined before they move, and rules meet cells, not rows. The
    scores are means over folds of each fold's rmse. Rows without a label count for nothing; a missing prediction is replaced where a rule
    applies and has no error otherwise.
    """
    if not configurations or not rules:
        raise ValueError("configurations and rules are needed")
    caps = sorted({r.cap for r in rules if r.cap is not None})
    thresholds = sorted({r.threshold for r in rules if r.threshold is not None})
    multipliers = sorted({r.multiplier for r in rules if r.threshold is not None})
    how_many = lambda tests: sum((yes(t).cast("int") for t in tests), F.lit(0))
    each = F.array(*(F.struct(F.lit(name).alias("configuration"), F.col(c).cast("double").alias("p")) for name, c in configurations.items()))
    rows = df.where(F.col(y).isNotNull()).select(
        F.col(fold).alias("fold"), F.col(y).cast("double").alias("y"), F.col("oldest_pending_minutes").cast("double").alias("q"),
        (F.col("history_count") > 0).alias("history"), yes(F.col("is_departure") == 1).alias("departure"), F.inline(each)
    )
    capped, floored = yes(~F.col("history")) & F.col("departure"), yes(F.col("history")) & F.col("q").isNotNull()
    p, q, v = F.col("p"), F.col("q"), F.col("y")
    error = (v - p) * (v - p)
    cells = rows.groupBy(
        "configuration", "fold", F.when(capped, how_many((p > c) | p.isNull() for c in caps)).otherwise(0).alias("caps"),
        F.when(floored, how_many(q > t for t in thresholds)).otherwise(0).alias("thresholds"),
        F.when(floored, how_many(q * m <= p for m in multipliers)).otherwise(0).alias("multipliers")
    ).agg(
        F.count("*").alias("n"), F.count(error).alias("ne"), F.sum(error).alias("e2"), F.sum("y").alias("y1"), F.sum(v * v).alias("y2"),
        F.sum(v * q).alias("yq"), F.sum(q * q).alias("q2")
    )
    at = lambda values, x: values.index(x) if x is not None else len(values)
    spec = F.array(
        *(
            F.struct(
                F.lit(k).cast("long").alias("rule"), F.lit(r.cap).cast("double").alias("cap"), F.lit(r.threshold).cast("double").alias("threshold"),
                F.lit(r.multiplier).cast("double").alias("multiplier"), F.lit(at(caps, r.cap)).alias("cap_at"), F.lit(at(thresholds, r.threshold)).alias("threshold_at"),
                F.lit(at(multipliers, r.multiplier) if r.threshold is not None else 0).alias("multiplier_at")
            ) for k, r in enumerate(rules)
        )
    )
    met = cells.select("*", F.inline(spec))
    cap = F.col("cap_at") < F.col("caps")
    floor = (F.col("threshold_at") < F.col("thresholds")) & (F.col("multiplier_at") >= F.col("multipliers"))
    c, m = F.col("cap"), F.col("multiplier")
    sse = F.when(cap, F.col("y2") - 2 * c * F.col("y1") + c * c * F.col("n")).when(floor, F.col("y2") - 2 * m * F.col("yq") + m * m * F.col("q2")).otherwise(F.col("e2"))
    names = ["configuration", "rule", "cap", "threshold", "multiplier"]
    scores = met.groupBy(*names, "fold").agg(F.sum(sse).alias("e2"), F.sum(F.when(cap | floor, F.col("n")).otherwise(F.col("ne"))).alias("n"))
    # Differences of sums may fall a little below nothing.
    scores = scores.groupBy(*names).agg(F.avg(F.sqrt(F.greatest(F.col("e2"), F.lit(0.0)) / F.nullif(F.col("n"), F.lit(0)))).alias("mean_rmse"))
    # As many rows as rules and configurations.
    ranked = scores.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("mean_rmse"), "configuration", "rule")).cast("long"))
    return ranked


def provenance_violations(df: DataFrame, cut: str, stamps: dict[str, int], counts: dict[str, list[str]] | None = None) -> DataFrame:
    """(stamp, late, missing): rows whose input clock is not strictly before the cut less its lag (minutes), and rows whose counts say that
    inputs were used without a clock. counts of a stamp that is not declared are an error."""
    counts = counts or {}
    if set(counts) - set(stamps):
        raise ValueError(f"undeclared clocks: {sorted(set(counts) - set(stamps))}")
    if missing := (set(stamps) | {c for x in counts.values() for c in x}) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if bad := {n: lag for n, lag in stamps.items() if not math.isfinite(lag) or lag < 0}:
        raise ValueError(f"lags must be finite and not negative: {bad}")

    def found(name, lag):
        used = F.lit(False)
        for c in counts.get(name, []):
            used = used | yes(F.col(c) > 0)
        late = F.count_if(F.col(name) >= F.col(cut) - F.lit(int(lag * MINUTE)))
        return F.struct(F.lit(name).alias("stamp"), late.alias("late"), F.count_if(used & F.col(name).isNull()).alias("missing"))

    # One scan for all clocks.
    return df.agg(F.array(*(found(*x) for x in stamps.items())).alias("_s")).select(F.inline("_s"))


def require_provenance(df: DataFrame, cut: str, stamps: dict[str, int], counts: dict[str, list[str]] | None = None) -> None:
    bad = [r.stamp for r in provenance_violations(df, cut, stamps, counts).where("late > 0 or missing > 0").collect()]
    if bad:
        raise ValueError(f"inputs too new or without a clock: {bad}")


def presence_counts(df: DataFrame, counted: list[str], present: list[str], name: str) -> DataFrame:
    """How many inputs a row shows: counts added up, plus one for each column that is not null."""
    n = F.lit(0.0)
    for c in counted:
        n = n + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    for c in present:
        n = n + F.col(c).isNotNull().cast("double")
    return df.withColumn(name, n)


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(name, differing): in how many keys two profiles differ in a column, or only one has the key (name: the key)."""
    x = a.select(key, F.struct(*columns).alias("_a"))
    y = b.select(key, F.struct(*columns).alias("_b"))
    j = x.join(y, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    e = [F.struct(F.lit(c).alias("name"), F.count_if(both & ~F.col("_a")[c].eqNullSafe(F.col("_b")[c])).alias("differing")) for c in columns]
    e.append(F.struct(F.lit(key).alias("name"), F.count_if(~both).alias("differing")))
    return j.agg(F.array(*e).alias("_e")).select(F.inline("_e"))


def require_aligned(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> None:
    """Refuses two profiles that do not have the same keys with the same values."""
    if bad := {r.name: r.differing for r in mismatches(a, b, key, columns).where("differing > 0").collect()}:
        raise ValueError(f"profiles differ: {bad}")


def deployable(df: DataFrame, prediction: str, cut: str, not_before: int, lag: int = 30) -> DataFrame:
    """(young, early): rows whose snapshot is less than lag minutes old, and rows before the model existed. An unknown time is both."""
    old = yes(F.col(prediction) - F.col(cut) >= lag * MINUTE)
    return df.agg(F.count_if(~old).alias("young"), F.count_if(~yes(F.col(prediction) >= F.lit(not_before))).alias("early"))


def require_deployable(
    df: DataFrame, prediction: str, cut: str, not_before: int, stamps: dict[str, int] | None = None,
    counts: dict[str, list[str]] | None = None, lag: int = 30
) -> DataFrame:
    """df, or an error: before a model may predict, its inputs must be old enough, later than the model, and of declared clocks."""
    r = deployable(df, prediction, cut, not_before, lag).first()
    if r.young:
        raise ValueError(f"{r.young} rows come from a snapshot that is less than {lag} minutes old")
    if r.early:
        raise ValueError(f"{r.early} rows are from before the model was available")
    if stamps:
        require_provenance(df, cut, stamps, counts)
    return df


@dataclass(frozen=True)
class Invariants:
    """What a table of queries must keep. Times are micros; columns that a table lacks are not judged unless they are required."""

    rows: int | None = None
    lag: int = 30
    #: Clocks that must be before the cut where they are known, and those that must be known where there is history.
    clocks: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    #: Timetable facts, all unknown where the plan was not known.
    masked: tuple[str, ...] = ()
    #: Pairs (source's column, query's column) that are equal where there is history.
    same_run: tuple[tuple[str, str], ...] = ()

    def violations(self, df: DataFrame) -> DataFrame:
        """(invariant, rows) in one scan, beside one count by row_id; 0 where it holds."""
        have = set(df.columns)
        if missing := {"row_id", "prediction", "cut"} - have:
            raise ValueError(f"missing columns: {sorted(missing)}")
        history = yes(F.col("history_count") > 0) if "history_count" in have else F.lit(False)
        tests = {
            "row_id_known": F.col("row_id").isNull(),
            "row_id_in_range": yes(F.col("row_id") < 0) | (F.lit(False) if self.rows is None else yes(F.col("row_id") >= self.rows)),
            "snapshot_age": ~yes(F.col("prediction") - F.col("cut") >= self.lag * MINUTE),
        }
        if "s" in have:
            tests["prediction_is_schedule"] = ~F.col("prediction").eqNullSafe(F.col("s"))
        if "prediction_cut" in have:
            tests["cuts_agree"] = ~F.col("prediction_cut").eqNullSafe(F.col("cut"))
        tests |= {f"before_cut:{c}": yes(F.col(c) >= F.col("cut")) for c in self.clocks if c in have}
        tests |= {f"history_has:{c}": history & F.col(c).isNull() for c in self.sources}
        if self.masked:
            shown = F.lit(False)
            for c in self.masked:
                shown = shown | F.col(c).isNotNull()
            tests["masked_plan"] = ~yes(F.col("known")) & shown
        tests |= {f"same_run:{a}": history & ~F.col(a).eqNullSafe(F.col(b)) for a, b in self.same_run}
        each = F.array(*(F.struct(F.lit(k).alias("invariant"), F.count_if(v).alias("rows")) for k, v in tests.items()))
        repeats = df.where("row_id is not null").groupBy("row_id").count().where("count > 1").agg(
            F.lit("row_id_unique").alias("invariant"), F.count("*").alias("rows")
        )
        return df.agg(each.alias("_e")).select(F.inline("_e")).unionByName(repeats)

    def require(self, df: DataFrame) -> DataFrame:
        """df, or an error that names what is broken."""
        if bad := {r.invariant: r.rows for r in self.violations(df).where("rows > 0").collect()}:
            raise ValueError(f"invariants broken: {bad}")
        return df


def unordered(df: DataFrame, order: str = "row_id", time: str = "prediction") -> DataFrame:
    """(rows): how many rows are earlier than one before them in order. Ranges are compared by their extremes, then inside, so no task sorts all."""
    from pyspark.sql import Window as W

    from ..operators.ingest import row_ids

    width = 1 << 16
    rows = row_ids(df.select(order, time), [order], "_at").withColumn("_range", F.floor(F.col("_at") / width))
    tops = rows.groupBy("_range").agg(F.max(time).alias("_top"))
    before = tops.select("_range", F.max("_top").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = F.max(time).over(W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_inside", inside).join(before, "_range").agg(F.count_if(yes(F.col(time) < F.greatest("_inside", "_before"))).alias("rows"))


@dataclass(frozen=True)
class Recipe:
    """A tracked recipe: what was selected, bound to its files by their hashes. It loads only as it was written."""

    name: str
    features: tuple[str, ...]
    policy: dict
    files: dict[str, str]

    def digest(self) -> str:
        return _digest({"name": self.name, "features": list(self.features), "policy": self.policy, "files": self.files})

    def write(self, path: str) -> str:
        import json

        from ..sources.shared import put_whole

        body = {"name": self.name, "features": list(self.features), "policy": self.policy, "files": self.files}
        put_whole(path, json.dumps(body | {"digest": _digest(body)}, indent=1, sort_keys=True).encode())
        return _digest(body)

    @classmethod
    def load(cls, path: str, directory: str, digest: str | None = None) -> Recipe:
        """The recipe at path, or an error if it, or a file that it names in the directory, is not as it was; both may be on shared storage.

        digest: the one that is expected from elsewhere; the file's own only shows accidents.
        """
        import hashlib
        import json
        import os

        from ..sources.shared import read_bytes, storage

        found = read_bytes(path)
        if found is None:
            raise ValueError(f"no recipe at {path}")
        body = json.loads(found)
        own = body.pop("digest", None)
        if set(body) != {"name", "features", "policy", "files"}:
            raise ValueError(f"not a recipe: {sorted(body)}")
        if own != _digest(body) or digest is not None and digest != own:
            raise ValueError("the recipe was changed")
        if len(set(body["features"])) != len(body["features"]):
            raise ValueError("features repeat")
        for name, want in body["files"].items():
            if os.path.basename(name) != name:
                raise ValueError(f"not a file of the directory: {name}")
            h = hashlib.sha256()
            files, at = storage(f"{directory.rstrip('/')}/{name}")
            with files.open_input_stream(at, compression=None) as f:
                while piece := f.read(1 << 20):
                    h.update(piece)
            if h.hexdigest() != want:
                raise ValueError(f"changed since the recipe was written: {name}")
        policy_of(body["policy"])
        return cls(body["name"], tuple(body["features"]), body["policy"], body["files"])

    def applied(self, df: DataFrame) -> DataFrame:
        return policy_of(self.policy).apply(df)


def _digest(body: dict) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def policy_of(settings: dict) -> Policy:
    """A policy from plain values; unknown or missing names are an error, and so are values that Policy and Rule refuse."""
    values = dict(settings)
    rule = Rule(**values.pop("rule", {}))
    try:
        return Policy(**values, rule=rule)
    except TypeError as e:
        raise ValueError(f"not a policy: {e}") from None


def replayed(df: DataFrame, policy: Policy, saved: str = "saved", key: str = "row_id", tolerance: float = 1e-9) -> DataFrame:
    """Rows whose saved prediction the policy does not give again: key, saved, final. A missing one differs from a known one."""
    out = policy.apply(df)
    near = F.abs(F.col(saved) - F.col("final")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col("final")))
    same = F.when(F.col(saved).isNull() | F.col("final").isNull(), F.col(saved).isNull() & F.col("final").isNull()).otherwise(near)
    return out.where(~same).select(key, saved, "final")


def require_replay(df: DataFrame, policy: Policy, saved: str = "saved", key: str = "row_id") -> None:
    """Refuses saved predictions that were not made by the policy."""
    if bad := replayed(df, policy, saved, key).limit(5).collect():
        raise ValueError(f"saved predictions differ from the policy's: {[r[key] for r in bad]}")
