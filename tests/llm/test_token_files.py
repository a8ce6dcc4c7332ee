import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymill.llm import token_files as K

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 100, 257):
        for high in (2, 50257, 2**32):
            ids = rng.integers(0, high, n, np.uint64).astype(np.uint32)
            for block in (8, 100, 1 << 16):
                assert (K.unpack(K.pack(ids, block, bits)) == ids).all() and len(K.unpack(K.pack(ids, block, bits))) == n
    with pytest.raises(ValueError):
        K.unpack(b"x" * 40)


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a \n b", "a\n\n\nb", "a\tb c\td", "<|endoftext|>", "x <|endoftext|>y", "x\r\ny", "a\xa0b \xa0c", "it's 'tis 's"]
    for _ in range(400):
        out.append("".join(rng.choice(["word", "Foo,", "don't", "éß", "99", "\n", " ", " ", " ", ". ", "\t", "$$"]) for _ in range(rng.randrange(40))))
        out.append(" ".join(rng.choice(["word", "Foo,", "don't", "éß", "99\n7", "x.\nThe"]) for _ in range(rng.randrange(40))))
    return out


def test_encoder_equals_the_library_on_whole_texts():
    library, ours = Tokenizer.from_file(PATH), K.Encoder(PATH)
    rng = random.Random(5)
    signs = ["".join(rng.choice("aBéñß×÷ſɏɐÖ's.,!#-_`~[\\1٣中 \n") for _ in range(rng.randrange(30))) for _ in range(2000)]
    for _ in range(2):  # again, from the table
        for t in [t or "" for t in texts()] + signs:
            assert list(memoryview(ours.encode(t)).cast("I")) == library.encode(t, add_special_tokens=False).ids, t


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(K, "TABLE", 3)
    ours = K.Encoder(PATH)
    for t in ("one two, three four!", "five two,", "one"):
        assert list(memoryview(ours.encode(t)).cast("I")) == ours.pieces.library.encode(t, add_special_tokens=False).ids
    assert len(ours.pieces) < 5


@pytest.mark.parametrize(("block", "bits"), [(64, False), (1 << 16, True)])
def test_files(spark, tmp_path, block, bits):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 1009, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(6)
    K.write(df, PATH, str(tmp_path / "f"), block=block, bits=bits)
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in K.read(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    assert got == want
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in K.digests(spark, str(tmp_path / "f")).collect()}
    assert crc == {(i, s): zlib.crc32(np.array(ids, "<u4").tobytes()) for i, s, _, ids in want}
    index = spark.read.parquet(str(tmp_path / "f/index"))
    assert index.selectExpr("sum(n_docs)", "sum(n_ids)").first() == (len(rows), start)


def test_empty_and_repeated(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    K.write(df, PATH, str(tmp_path / "r"))
    assert sorted(r.start for r in K.digests(spark, str(tmp_path / "r")).collect()) == [0, 2, 4]
    K.write(df.limit(0), PATH, str(tmp_path / "e"))
    assert K.digests(spark, str(tmp_path / "e")).count() == 0
