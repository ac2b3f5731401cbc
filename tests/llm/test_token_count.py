import public_tokenizers
import pytest
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegate.llm import token_count
from tidegate.llm.token_count import Counts, merges, pretokens, proved, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SPECIAL = re.compile(r"(<\|endoftext\|>)")
OURS = Counts(PATH, proved(PATH))

CASES = [
    "", " ", "Hello, World's 12345!!", "don't 've 'LL'll we'd", "a<|endoftext|>B<|endoftext|><|endoftext|", "<|endoftext|> x \n\n\t  y",
    "x" * 5000, "ab" * 30000, "   " * 2000, "1" * 700, "你好世界 \U0001f600\U0001f600", "\x00\x1c\x85  z", "　﻿q", "É" * 300, "a  b\r\n \n"
]


def library(texts):
    return [len(e.ids) for e in LIB.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", CASES)
def test_same_as_library(text):
    assert [OURS.of(text, SPECIAL)[0]] == library([text])
    assert "".join(pretokens(text)) == text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_same_as_library_any(text):
    assert [OURS.of(text, SPECIAL)[0]] == library([text])


def test_every_code_point():
    """Letters, digits, spaces and symbols are told apart as the library does, for one code point in 17 and all of the first planes' starts."""
    names = token_count.byte_names()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 17 == 0 or 0xA7C0 <= c < 0xA800)]
    for lo in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)}!" for c in points[lo : lo + 4000])
        want = [x for x, _ in LIB.pre_tokenizer.pre_tokenize_str(text)]
        assert ["".join(names[b] for b in x.encode()) for x in pretokens(text)] == want


def test_proof():
    """Every string of the vocabulary, and no other text, is proved if the library gives one token for it as a pre-token of its own."""
    m = merges(PATH)
    texts = {}
    for token, i in m.vocab.items():
        try:
            texts[bytes(m.names.index(c) for c in token).decode()] = i
        except UnicodeDecodeError:
            pass
    whole = proved(PATH)
    assert whole <= texts.keys() and len(whole) > 45_000
    alone = [t for t in texts if pretokens(t) == [t]]
    found = LIB.encode_batch(alone, add_special_tokens=False)
    assert {t for t, e in zip(alone, found) if e.ids == [texts[t]]} == {t for t in alone if t in whole}


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_PIECES", 50)
    counts = Counts(PATH, proved(PATH))
    texts = [f"zq{i}xv zq{i * 7}kk" for i in range(300)] * 2
    assert [counts.of(t, SPECIAL)[0] for t in texts] == library(texts)
    assert len(counts) <= len(counts.whole) + 50 and counts.whole <= counts.keys()


def test_query(spark):
    rows = [(1, "Hello there", 5), (1, "Hello there", 6), (2, None, 7), (None, "", 8), (3, "w " * 20000, 9), (4, "é zzqx" * 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(docs, PATH).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    n = library([t or "" for _, t, _ in rows])
    assert got == sorted([(i, len((t or "").encode()), k, k > 512) for (i, t, _), k in zip(rows, n)], key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0
    ways = token_counts(docs, PATH).where("doc_id = 4").first()
    assert ways.n_whole + ways.n_merged == len(pretokens("é zzqx" * 3)) and ways.n_merged


def test_query_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()}
    assert got == dict(zip(texts, library(list(texts.values()))))
