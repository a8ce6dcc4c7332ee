import random
import re
import zlib
from collections import Counter

import pytest

from tallymill.llm import spelling

SCHEMA = "doc_id long, text string"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(rows, every=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out, forms = {}, {}
    for w in n:
        others = sorted((-n[o], o) for o in n if near(w, o))
        form = others[0][1] if others and -others[0][0] >= 2 * n[w] else None
        forms[w] = form
        out[w] = [form, None, n[w], len(others), n[form] if form else None]
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def found(spark, rows, schema=SCHEMA, **settings):
    got = spelling.variants(spark.createDataFrame(rows, schema).repartition(3), **settings).collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("symbols", [2, 6, 9])
def test_variants_are_those_of_brute_force(spark, symbols):
    rng = random.Random(symbols)
    base = ["".join(rng.choices("abeést", k=rng.randrange(5, 9))) for _ in range(25)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = list(base[min(rng.randrange(25), rng.randrange(25))])
            if rng.random() < 0.5:
                k, c = rng.randrange(len(w) + 1), rng.choice("abeÉSt")
                w[k : k + rng.randrange(2)] = [c] * rng.randrange(2)
            words.append("".join(w))
        rows.append((i, rng.choice([" ", "-", "7"]).join(words)))
    expected = plain(rows, every=5)
    assert found(spark, rows, every=5, symbols=symbols) == expected
    assert any(v[0] and v[1] != v[0] for v in expected.values())  # a form of a form


def test_odd_inputs(spark):
    long, longer = "ab" * 3000, "ab" * 2999 + "b"
    at = "x" * (spelling.LONG + 1)
    rows = [(1, None), (None, "Other other OTHER othre othre othre"), (1, ""), (2, "1 2 é ...")]
    rows += [(3, f"{long} {longer} {at} {at[1:]} {at}y {at[2:]}")] * 4 + [(4, "Ünder ünder under " * 3), (5, "straße strasse " * 3), (6, "tied1 tieda tiedb tiedc " * 3)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows)[long][3] == 1
    assert found(spark, []) == {}
    clash = [(*r, "a", 1, None) for r in rows]
    assert found(spark, clash, SCHEMA + ", word string, n int, key string") == plain(rows)


def test_edits_are_each_reduced_neighbour_once():
    for word in ("abcab", "aaaaa", "b"):
        symbols = [ord(c) % 3 + 1 for c in word]
        value = lambda v: sum(x * pow(spelling.BASE, i, 2**64) for i, x in enumerate(v)) % 2**64
        full = {tuple(symbols)} | {tuple(symbols[:i] + symbols[i + 1 :]) for i in range(len(word))}
        full |= {tuple(symbols[:i] + [c] + symbols[i + k :]) for i in range(len(word) + 1) for k in (0, 1) for c in (1, 2, 3)}
        made = [int(h) for _, key in spelling.edits([word], 3) for h in key]
        assert sorted(made) == sorted(map(value, full))
