import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "  two  spaces\n\n\nlines \t tab\r\n end ", "don't we'll I'd 's", "naïve Straße 你好 😀👍🏽", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\x00\x1c\x85\xa0 x　 y", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "²½٣ Ⅷ", "­​﻿ é"]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def test_automaton_equals_the_library(theirs):
    ours, rng = bpe.load(PATH), random.Random(5)
    texts = [t for t in ODD if t is not None]
    alphabet = "etaoinshrdlu  ETHA.,'-\n\täöüßéèñ0123456789$#%&|!你\U0001f600"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(1500)]
    texts += ["".join(rng.choice(["ab", "a", "b", "abab", "ing", "in", "the", "he", " "]) for _ in range(40)) for _ in range(500)]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = list(memoryview(ours.encode(t)).cast("I"))
        assert got == want, t
        assert ours.decode(ours.encode(t)) == theirs.decode(want, skip_special_tokens=False) == t


def test_every_arc_agrees_with_merging_the_pair(theirs):
    ours, rng = bpe.load(PATH), random.Random(6)
    ids = [i for i in ours.labels if i < 50256]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        joined = ours.labels[a] + ours.labels[b]
        assert ours.automaton.arc(a, b) == (ours.word(joined) == [a, b] )


def test_invalid_bytes_decode_as_the_library_does(theirs):
    ours, rng = bpe.load(PATH), random.Random(7)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(8))]
        from array import array

        assert ours.decode(array("I", ids).tobytes()) == theirs.decode(ids, skip_special_tokens=False)


def test_round_trip_and_tables(spark, theirs):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "one", None), (3, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.round_trip(df, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
