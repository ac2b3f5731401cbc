"""Each stage of the pipeline against brute force over its own input, and run() against the stages."""

import hashlib
import math
import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidegate.llm import mixing, quality

from .test_jaccard_join import brute as brute_near
from .test_quality_mixing import WORD
from .test_quality_mixing import brute as brute_counts


def corpus():
    r = random.Random(5)
    word = lambda: r.choice("abcdefghij") + "".join(r.choice("aeioué") for _ in range(r.randint(1, 5)))
    passage = " ".join(word() for _ in range(25))
    texts = []
    for k in range(40):
        kind = k % 8
        if kind == 1 and texts:
            w = texts[-1].split(" ")
            w[3] = "changed"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append("junk### " * 60)
        elif kind == 3:
            texts.append(" ".join("#$%" + word() for _ in range(70)))
        elif kind == 4:
            texts.append("short text")
        else:
            texts.append(" ".join(word() for _ in range(r.randint(55, 160))) + (" " + passage if kind > 5 else ""))
    return [(i, t, r.choice(("en", "fr", None)), r.choice(("s1", "s2", None)), len(t)) for i, t in enumerate(texts)] + [(99, None, "en", "s1", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_quality(rows):
    """Limits from sorted lists: the walk up the group's quantiles, backed by its language's, or its own quartiles, at most the cap."""
    rates, clean, own = {}, defaultdict(lambda: ([], [], [])), defaultdict(lambda: ([], [], []))
    for row in rows:
        n, chars, sym, dup, rep = brute_counts(row[1])
        lines = sum(1 for x in (row[1] or "").split("\n") if WORD.search(x))
        found, sizes = (sym, dup, rep), (chars, lines, n)
        rate = tuple(1000 * (x + more) / (size + extra) for x, size, (more, extra) in zip(found, sizes, quality.PRIOR.values()))
        failed = n < 50 or 100 * rep > 50 * n
        rates[id(row)] = (rate, found, failed)
        for k, v in enumerate(math.ceil(x * quality.STEPS) / quality.STEPS for x in rate):
            own[row[2], row[3]][k].append(v)
            if not failed:
                for name in ((row[2], row[3]), ("lang", row[2]), "all"):
                    clean[name][k].append(v)
    at = lambda values, p: sorted(values)[max(0, math.ceil(p * len(values)) - 1)]

    def limit(row, k, gap):
        group, lang = clean[row[2], row[3]][k], clean["lang", row[2]][k]
        q50, q75 = (at(own[row[2], row[3]][k], p) for p in (0.5, 0.75))
        best = quality.SLACK * q75 + quality.REACH * (q75 - q50)
        if group:
            n = len(group)
            levels = [(at(group, p) * n + at(lang, p) * quality.BACKING) / (n + quality.BACKING) for p in quality.LEVELS]
            end = levels[0]
            for x in levels:
                if x - end > gap:
                    break
                end = x
            best = max(best, quality.SLACK * end)
        return min(best, quality.SLACK * at(clean["all"][k], quality.CAP))

    kept = []
    for row in rows:
        rate, found, failed = rates[id(row)]
        if not failed and all(not found[k] or rate[k] <= limit(row, k, gap) for k, gap in enumerate(quality.GAPS.values())):
            kept.append(row)
    return kept


def brute_cut(rows):
    least = {}
    data = {r[0]: (r[1] or "").encode() for r in rows}
    for i, t in data.items():
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(i, least.get(t[k : k + 50], i))
    out = []
    for r in rows:
        t = data[r[0]]
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < r[0]:
                gone[k : k + 50] = b"\1" * 50
        text = bytes(c for c, x in zip(t, gone) if not x).decode("utf-8", "ignore")
        out.append((*r[:1], text if r[1] is not None else None, *r[2:4], len(text)))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_against_brute_force(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    quality_, near, cut, mix, bpe = (f for _, f in cp.STAGES)
    rows = brute_quality(corpus())
    a = quality_(spark, docs, "")
    assert rows_of(a) == sorted(rows, key=str) and a.columns == docs.columns and 10 < len(rows) < 35
    roots = brute_near([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if roots[r[0]][1] == r[0]]
    b = near(spark, a, "")
    assert rows_of(b) == sorted(rows, key=str) and b.columns == docs.columns
    rows = brute_cut(rows)
    c = cut(spark, b, "")
    assert rows_of(c) == sorted(rows, key=str) and c.columns == docs.columns
    d = mix(spark, c, "")
    taken = {r.doc_id: r for r in mixing.mix_plan(c).collect()}
    got = defaultdict(list)
    for r in d.collect():
        got[r.doc_id].append(r.text)
    for r in rows:
        words = WORD.findall(r[1] or "")
        assert sum(len(WORD.findall(t)) for t in got[r[0]]) == taken[r[0]].taken <= 2 * len(words)
        assert all(t == r[1] or WORD.findall(t) == words[: len(WORD.findall(t))] for t in got[r[0]])
    assert d.columns == docs.columns
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, texts in got.items():
        for t in texts:
            ids = lib.encode(t, add_special_tokens=False).ids
            want.append(
                (
                    i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(),
                    hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
                )
            )
    assert rows_of(bpe(spark, d, "")) == sorted(want, key=str)


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert rows_of(out) == rows_of(docs)
    assert out.count() > 0


def test_edges_of_every_stage(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names and an empty table, stage by stage."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    long = " ".join(word() for _ in range(60_000))
    plain = [" ".join(word() for _ in range(80)) for _ in range(4)]
    rows = [
        (1, plain[0], "en", "s"), (1, plain[0], "en", "s"), (2, plain[0], None, None), (None, plain[1], "en", None),
        (None, None, None, None), (3, "", "en", "s"), (4, " \n", "en", "s"), (5, long, "fr", "s"), (6, plain[2] + "\n\t é", "en", "t"),
        (7, plain[3], "en", "t")
    ]
    names = ["_row", "_k", "marks", "key", "size", "taken", "node", "kept", "source_size", "n_shingles"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame([(*x, len(x[1] or ""), *(f"{c}!" for c in names)) for x in rows], schema)
    ids = lambda df: sorted(x.doc_id or 0 for x in df.collect())
    quality_, near, cut, mix, bpe = (f for _, f in cp.STAGES)
    assert ids(quality_(spark, docs, "")) == [0, 1, 1, 2, 5, 6, 7]
    assert ids(near(spark, docs, "")) == [0, 0, 1, 3, 4, 5, 6, 7]
    got = {x.doc_id: x for x in cut(spark, docs, "").where("doc_id is not null").collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[5].text == long and got[1].text == plain[0]
    assert cut(spark, docs, "").where("doc_id is null and text is null").count() == 1
    mixed = mix(spark, docs, "")
    assert set(ids(mixed)) == {0, 1, 2, 5, 6, 7} and all(x.n_chars == len(x.text) for x in mixed.collect())
    assert all((plain[2] + "\n\t é").startswith(x.text) for x in mixed.where("doc_id = 6").collect())
    assert bpe(spark, docs, "").count() == len(rows)
    for f in (quality_, near, cut, mix):
        out = f(spark, docs, "")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert all(x[c] == f"{c}!" for x in out.collect() for c in names)
        assert f(spark, docs.limit(0), "").count() == 0
    assert bpe(spark, docs.limit(0), "").count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
