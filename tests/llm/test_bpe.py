import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegate.llm.bpe import LATER_ASSIGNED, bpe_digests, encoded, load

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OURS = load(PATH)

CASES = [
    "", " ", "Hello, World's 12345!!", "it's WE'LL 'd", "ΣΑΣ İstanbul ǅ", "école ÉCOLE", "a<|endoftext|>B<|startoftext|>",
    "<|ENDOFTEXT|><|endoftext|", "x" * 500, "ab" * 3000, "你好世界 \U0001f600\U0001f600", "\x00\x1c\x85  z", "　﻿q",
    "thntblere of then, edtioner" * 50, "###$$$%%%éé"
]


@pytest.mark.parametrize("text", CASES)
def test_same_as_library(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == want
    assert OURS.decode(want) == LIB.decode(want, skip_special_tokens=False)
    ids, decoded = OURS.both(text)
    assert decoded.decode() == OURS.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_as_library_any(text):
    assert OURS.encode(text) == LIB.encode(text, add_special_tokens=False).ids


def test_every_code_point():
    """Code points between letters: classes of the two pattern libraries agree."""
    bad = []
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x800 or c % 41 == 0 or LATER_ASSIGNED.match(chr(c)) and c % 5 == 0)]
    for lo in range(0, len(points), 4096):
        texts = [f"a{chr(c)}b" for c in points[lo : lo + 4096]]
        for c, t, e in zip(points[lo:], texts, LIB.encode_batch(texts, add_special_tokens=False)):
            if OURS.encode(t) != e.ids:
                bad.append(hex(c))
    assert not bad, (len(bad), bad[:40])


def test_cuts_never_split_a_token():
    for token in list(OURS.vocab)[::97]:
        body = token.removesuffix("</w>")
        raw = bytes(OURS.names.index(c) for c in body)
        assert OURS.cuts(raw) == [0, len(raw)]


def test_query(spark):
    rows = [(1, "Hello there", 5), (1, "Hello there", 6), (2, None, 7), (None, "", 8), (3, "w " * 20000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe_digests(docs, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        e = LIB.encode(t or "", add_special_tokens=False).ids
        d = LIB.decode(e, skip_special_tokens=False)
        want.append((i, len(e), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest(), hashlib.sha256(d.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_digests(docs.limit(0), PATH).count() == 0
    assert sorted(encoded(docs, PATH).collect()[0].ids) == sorted(LIB.encode("Hello there", add_special_tokens=False).ids)
