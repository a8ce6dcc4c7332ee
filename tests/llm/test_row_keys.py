from tallymill.llm.decontaminate import without_leaks
from tallymill.llm.simhash import keep_one


def words(name, n=30):
    return " ".join(f"{name}{k}" for k in range(n))


def test_rows_with_null_or_repeated_ids_stay_if_their_texts_differ(spark):
    rows = [(None, words("a")), (None, words("b")), (None, words("c")), (5, words("d")), (5, words("e")), (5, words("e")), (None, words("e").upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[:5], key=str)


def test_a_leak_takes_its_own_row_only(spark):
    rows = [(None, words("a")), (None, words("b")), (5, words("b")), (5, words("c")), (6, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = without_leaks(df, spark.createDataFrame([(1, words("b"))], "item_id long, text string"))
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], *rows[3:]], key=str)
