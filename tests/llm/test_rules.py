import random
import re

from tallymill.llm import rules


def plain(text):
    text = text or ""
    w = [x for x in re.split(r"[ \t\n\v\f\r]", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\v\f\r]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(i, i + 3)}
    m = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep), "n_lines": len(lines), "n_capitals": sum("A" <= c <= "Z" for c in text),
    }
    bits = sum(1 << k for k, (_, r) in enumerate(rules.RULES) if eval(r.replace("AND", "and"), {}, dict(m)))
    return m, bits


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a a a " * 12, "x\n\nx\n x\ny", "Ä😀é $$ <|>\x1c\x0b w", "one two\tthree\rone two three"]
    for _ in range(120):
        out.append("".join(rng.choice(["a", "bb", "C", "é", "$$"]) + rng.choice([" ", " ", "\n", ". ", "\t"]) for _ in range(rng.randrange(120))))
    out.append(" ".join(rng.choice("abcdefghij") for _ in range(3000)))
    return out


def test_ledger_is_the_plain_one(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, failed int")
    for r in rules.ledger(df).collect():
        m, bits = plain(rows[r.doc_id][1])
        assert {k: r[k] for k in m} == m, rows[r.doc_id][1]
        assert r.failed == bits
    for r in rules.judged(df).collect():
        m, bits = plain(rows[r.doc_id][1])
        assert r.base_failed == bool(bits & 3) and r.kept == (not bits) and r.failed_bits == bits


def test_ablation_and_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert rules.judged(df).count() == 3 and rules.judged(df.limit(0)).count() == 0
    led = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,)], "failed long")
    got = {r.rule: (r.n_failed, r.n_only) for r in rules.ablation(led, "v1").collect()}
    assert got == {"too_few_words": (3, 2), "repeated_words": (1, 0), "symbols": (1, 1), "duplicate_lines": (0, 0)}
    assert all((r.n_failed, r.n_only) == (0, 0) for r in rules.ablation(led.limit(0), "v2").collect())


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = rules.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
