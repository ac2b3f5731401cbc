"""Quality rules with adaptive thresholds, in DataFrame functions only.

Counts of every text come from array and string functions. Thresholds are not fixed cutoffs: each (lang, source) group
gets its own, from mergeable quantile sketches of the group, of its language and of all documents, and every row is judged
by its group's thresholds through a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, dropped, stored

#: Characters that count as symbols; those that part words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\f\r"
#: Rates (per thousand) that are judged, and the step between neighbouring LEVELS that parts a group's clean mass from its noise.
GAPS = {"symbol_rate": 10.0, "dup_line_rate": 100.0, "repeat_rate": 100.0}
#: Quantiles walked to the end of the clean mass. A threshold is SLACK times the value there, or for a group that has
#: the like in a quarter of its documents SLACK times its upper quartile plus REACH times the distance from the median
#: to it; at most SLACK times the CAP quantile of all documents.
LEVELS, SLACK, REACH, CAP = [0.5, 0.75, 0.8, 0.85, 0.9, 0.92, 0.94, 0.96, 0.98, 0.99, 0.995], 2.0, 6.0, 0.999
#: Steps of a sketch for one per thousand.
STEPS = 100
#: A group's quantiles count as its rows, its language's as so many.
BACKING = 100.0
#: Every text counts as if it had so many more occurrences in so much more text (characters, lines, words): two symbols, a repeated
#: line, a repeated window. So a text without any has a rate that falls with its length, and a clean group's limits are above
#: nothing: they allow a few occurrences, more in longer texts. A text without any passes, however short.
PRIOR = {"n_symbols": (2, 200), "n_dup_lines": (1, 10), "n_repeat_words": (3, 50)}
#: What each rate counts.
OF = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words"}
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text) -> list:
    """Columns of METRICS of a text column; a null text has no words.

    n_repeat_words: windows of three words are hashed with their positions and sorted once; windows
    equal to a neighbour give the covered positions, of which overlaps count once.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    bare = F.btrim(t, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS, -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.length(t)
    word_chars = F.length(F.translate(t, BLANKS, "")).cast("long")
    n_symbols = (n_chars - F.length(F.translate(t, SYMBOLS, ""))).cast("long")

    def repeated(w):
        windows = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        )

        def covered(h):
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return let(
                pairs,
                lambda s: let(
                    F.sort_array(
                        F.transform(
                            F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"]
                        )
                    ),
                    lambda p: total(p)
                )
            )

        def total(p):
            return F.aggregate(
                p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a,
                i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
            )["n"]

        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    lines_n = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return [
        F.size(words).cast("long").alias("n_words"), word_chars.alias("word_chars"), n_symbols.alias("n_symbols"),
        lines_n.alias("n_dup_lines"), let(words, repeated).alias("n_repeat_words")
    ]


def let(value, body):
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_rates(df: DataFrame) -> DataFrame:
    rate = lambda m, size: F.lit(1000.0) * (F.col(f"_{m}") + F.lit(PRIOR[m][0])) / (F.col(size) + F.lit(PRIOR[m][1]))
    return df.withColumns(
        {
            "_symbol_rate": rate("n_symbols", "_word_chars"), "_dup_line_rate": rate("n_dup_lines", "_n_lines"),
            "_repeat_rate": rate("n_repeat_words", "_n_words"),
            "_base_failed": (F.col("_n_words") < 50) | (F.lit(100) * F.col("_n_repeat_words") > F.lit(50) * F.col("_n_words")),
        }
    )


def quantile(sketch, p: float):
    """The least rate of a sketch (sorted array of _at, _n) that a share p of its rows does not exceed; null if it has none."""
    need = let(F.aggregate(sketch, F.lit(0).cast("long"), lambda a, x: a + x["_n"]), lambda total: F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(p) * total)))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))

    def step(a, x, least):
        seen = a["seen"] + x["_n"]
        return F.struct(seen.alias("seen"), F.coalesce(a["at"], F.when(seen >= least, x["_at"])).alias("at"))

    return let(need, lambda least: F.aggregate(sketch, start, lambda a, x: step(a, x, least))["at"] / F.lit(float(STEPS)))


def thresholds(rated: DataFrame) -> DataFrame:
    """One row for each (lang, source), stored: what each rate may reach there.

    A sketch counts rows by their rate, rounded up to one in STEPS: whatever the order in which tasks' sketches merge, it is
    the same, so reruns agree. The clean mass is that of rows that pass the base rules; a group's median and upper quartile
    are of all its rows. rated is read once.
    """
    each = F.inline(F.array(*(F.struct(F.lit(m).alias("_metric"), F.ceil(F.col(f"_{m}") * F.lit(float(STEPS))).cast("long").alias("_at")) for m in GAPS)))
    counts_ = rated.select("_lang", "_source", (~F.col("_base_failed")).alias("_passed"), each)
    counts_ = stored(counts_.groupBy("_lang", "_source", "_metric", "_passed", "_at").agg(F.count("*").alias("_n")))
    clean = counts_.where("_passed")
    entry = F.struct("_at", "_n")
    groups = counts_.groupBy("_lang", "_source", "_metric").agg(
        F.sort_array(F.collect_list(F.when(F.col("_passed"), entry))).alias("_clean"), F.sort_array(F.collect_list(entry)).alias("_own"),
        F.sum(F.when(F.col("_passed"), F.col("_n")).otherwise(0)).alias("_rows"),
    )
    langs = clean.groupBy(F.col("_lang").alias("_of"), F.col("_metric").alias("_named"), "_at").agg(F.sum("_n").alias("_n"))
    langs = langs.groupBy("_of", "_named").agg(F.sort_array(F.collect_list(entry)).alias("_like"))
    every = clean.groupBy("_metric", "_at").agg(F.sum("_n").alias("_n")).groupBy("_metric").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    # One value for each rate.
    caps = {m: None for m in GAPS} | dict(every.select("_metric", quantile(F.col("_all"), CAP)).collect())
    joined = groups.join(langs, F.col("_lang").eqNullSafe(F.col("_of")) & (F.col("_metric") == F.col("_named")), "left")

    def backed(p):
        n = F.col("_rows")
        return (quantile(F.col("_clean"), p) * n + quantile(F.col("_like"), p) * F.lit(BACKING)) / (n + F.lit(BACKING))

    gap, cap = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m in GAPS:
        gap = F.when(F.col("_metric") == m, F.lit(GAPS[m])).otherwise(gap)
        cap = F.when(F.col("_metric") == m, F.lit(SLACK) * F.lit(caps[m]).cast("double")).otherwise(cap)

    def walk(levels):
        start = F.struct(F.get(levels, F.lit(0)).alias("end"), F.lit(True).alias("on"))

        def step(a, x):
            on = a["on"] & (x - a["end"] <= F.col("_gap"))
            return F.struct(F.when(on, x).otherwise(a["end"]).alias("end"), on.alias("on"))

        return F.aggregate(levels, start, step)["end"]

    half, quarter = F.get("_quarters", F.lit(0)), F.get("_quarters", F.lit(1))
    rows = joined.withColumns(
        {
            "_gap": gap, "_cap": cap, "_levels": F.array(*map(backed, LEVELS)),
            "_quarters": F.array(*(quantile(F.col("_own"), p) for p in (0.5, 0.75)))
        }
    )
    rows = rows.withColumn(
        "_most",
        F.least(F.greatest(F.lit(SLACK) * walk(F.col("_levels")), F.lit(SLACK) * quarter + F.lit(REACH) * (quarter - half)), F.col("_cap"))
    )
    out = stored(rows.groupBy("_lang", "_source").agg(*(F.max(F.when(F.col("_metric") == m, F.col("_most"))).alias(f"_max_{m}") for m in GAPS)))
    dropped(counts_)
    return out


def measured(docs: DataFrame, keep: list | None = None) -> DataFrame:
    """docs' columns in keep with all measures, under names that begin with an underscore."""
    lines = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    cols = [c.alias(f"_{m}") for m, c in zip(METRICS, counts(F.col("text")))]
    base = [F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), lines.cast("long").alias("_n_lines")]
    return docs.select(*(keep or []), *base, *cols)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with _kept: not base_failed and no rate above its group's threshold."""
    r, t = rows.alias("r"), limits.alias("t")
    joined = r.join(t, F.col("r._lang").eqNullSafe(F.col("t._lang")) & F.col("r._source").eqNullSafe(F.col("t._source")), "left")
    ok = F.lit(True)
    for m, counted in OF.items():
        ok = ok & ((F.col(f"_{counted}") == 0) | (F.col(f"_{m}") <= F.col(f"_max_{m}")))
    return joined.select("r.*", (~F.col("_base_failed") & F.coalesce(ok, F.lit(False))).alias("_kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    Null or empty text: all counts 0, base_failed, not kept. Null lang or source: a group of its own.
    Repeated rows are judged one by one. Other columns are ignored.
    """
    rows = stored(with_rates(measured(docs, [F.col("doc_id").cast("long").alias("doc_id")])))
    out = judged(rows, thresholds(rows))
    return out.select("doc_id", *(F.col(f"_{m}").alias(m) for m in METRICS), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns.

    A first pass gives the thresholds, a second judges each row by them, so no text is shuffled. Rows with a null or
    empty text go, as they fail the base rules; repeated rows stay or go alike; an empty table stays empty.
    """
    names = docs.columns
    rates = stored(with_rates(measured(docs)).select("_lang", "_source", "_base_failed", *(f"_{m}" for m in GAPS)))
    limits = thresholds(rates)
    dropped(rates)
    own = with_rates(measured(docs, [F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")]))
    return judged(own, limits).where("_kept").select(*(F.col("_row").getField(c).alias(c) for c in names))
