from pyspark.sql import functions as F

from tallymill.operators import audit
from tallymill.sources import files


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "q.jsonl").write_bytes(b'\xef\xbb\xbf{"a":1}\r\n\n{"b":2}\n')
    got = sorted((r.line, r.value) for r in files.read_questions_jsonl(spark, str(tmp_path / "q.jsonl")).collect())
    assert got == [(1, '{"a":1}'), (2, ""), (3, '{"b":2}')]
    assert files.read_manifests(spark, str(tmp_path / "q.jsonl")).count() == 1


def test_lines_of_a_file_that_many_tasks_read(spark, tmp_path):
    """Splits of a few hundred bytes cut lines, CRLF and letters of several bytes anywhere."""
    lines = [f'{{"n":{k},"t":"{"é" * (k % 40)}"}}' if k % 7 else "" for k in range(3000)] + ["a\rb"]
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(lines).encode() + b"\n")
    (tmp_path / "b.jsonl").write_bytes("\n".join(lines[::-1]).encode() + b"\n\n")
    (tmp_path / "c.jsonl").write_bytes(b"")
    conf = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = files.read_questions_jsonl(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
        got = sorted((r.file[-7:], r.line, r.value) for r in found.collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == [("a.jsonl", k, v) for k, v in enumerate(lines, 1)] + [("b.jsonl", k, v) for k, v in enumerate([*lines[::-1], ""], 1)]


def test_csv_source(spark, tmp_path):
    head = ",".join(f'"{c}"' for c in [*files.GPQA_COLUMNS, "Question Writer"])
    (tmp_path / "g.csv").write_text("﻿" + head + '\n"What, ""really""?\nyes",a,b,c,d,s,r1,dom,someone\n', encoding="utf-8")
    row = files.read_gpqa_csv(spark, str(tmp_path / "g.csv")).collect()
    assert len(row) == 1 and row[0]["Question"] == 'What, "really"?\nyes' and "Question Writer" not in row[0]


def test_dataset_and_reports(spark, tmp_path):
    q = spark.range(100).selectExpr("id % 2 AS dataset_id", "id AS position", "concat('{\"p\":', id, '}') AS json").repartition(5)
    files.write_dataset(q, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).count() == 100
    text = [line for f in sorted((tmp_path / "d" / "dataset_id=1").glob("part-*")) for line in f.read_text().splitlines()]
    assert text == [f'{{"p":{k}}}' for k in range(1, 100, 2)]
    r = spark.createDataFrame([(1, 0, 5), (2, 1, 6)], "run_id LONG, position LONG, response_id LONG")
    g = spark.createDataFrame([(1, "a", 3)], "run_id LONG, group_value STRING, planned LONG")
    files.write_run_reports(r, g, g.drop("group_value"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/responses")).count() == 2
    assert spark.read.csv(str(tmp_path / "r/groups"), header=True).first()["group_value"] == "a"


def test_archive_round_trip(spark, tmp_path):
    e = spark.range(30).selectExpr("id AS event_id", "id % 3 AS archive_id", "id AS place", "concat('k', id) AS event_key")
    line = F.to_json(F.struct("event_id", "event_key"))
    files.write_audit_archive(e, line, str(tmp_path / "a"))
    back = files.read_audit_archive(spark, str(tmp_path / "a"), "event_id LONG, event_key STRING")
    assert sorted((r.event_id, r.event_key, r.archive_id) for r in back.collect()) == [(k, f"k{k}", k % 3) for k in range(30)]
    stored = e.where("event_id <> 4").withColumn("event_key", F.expr("if(event_id = 5, 'other', event_key)"))
    got = {r.event_id: r.status for r in audit.reconcile_archive(back, stored, ["event_key"]).collect()}
    assert (got[4], got[5], got[6]) == ("absent", "conflict", "exact")
