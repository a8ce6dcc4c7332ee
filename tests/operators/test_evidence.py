"""Hand-made runs with hand-computed numbers."""

import pytest

from tallymill.operators import evidence as ev

R = "run_id LONG, question_id LONG, response_id LONG, raw_response STRING, error_type STRING, score DOUBLE, latency_ms DOUBLE, input_tokens LONG, output_tokens LONG, estimated_cost DECIMAL(20,8), created_at TIMESTAMP"


def responses(spark, rows):
    from datetime import datetime
    from decimal import Decimal

    at = datetime(2026, 1, 1)
    full = [(1, q, q * 10, raw, err, s, lat, i, o, None if c is None else Decimal(c), at) for q, raw, err, s, lat, i, o, c in rows]
    return spark.createDataFrame(full, R)


def test_report_of_five(spark):
    q = spark.createDataFrame([(0, 1, 0, "math", None), (1, 1, 1, "math", None), (2, 1, 2, "science", None), (3, 1, 3, None, "reasoning"), (4, 1, 4, " ", None)], "question_id LONG, benchmark_id LONG, position LONG, category STRING, domain STRING")
    runs = spark.createDataFrame([(1, 1, 5, "p", "h"), (2, 1, 5, "p", "h")], "run_id LONG, benchmark_id LONG, total_questions LONG, protocol STRING, dataset_hash STRING")
    rs = responses(spark, [(0, "A", None, 1.0, 10.0, 1, 2, "0.001"), (1, "B", None, 0.0, 20.0, 1, 2, "0.001"), (2, None, "authentication_error", 0.0, 30.0, 1, 2, "0.001"), (3, "A", None, 1.0, 40.0, 1, 2, "0.001"), (4, "", "empty_response", 0.0, 25.0, 1, 2, "0.001")])
    assert ev.choose_group_field(q, ["category", "domain"]).first().field == "category"
    one, none = sorted(ev.run_evidence(runs, rs).collect())
    assert (one.correct_questions, one.error_questions, one.score, one.completion_rate, one.average_latency_ms, one.input_tokens, one.output_tokens) == (2, 2, 40.0, 60.0, 25.0, 5, 10)
    assert one.answered_accuracy == pytest.approx(66.6666667) and float(one.estimated_cost) == 0.005
    assert (none.completed_questions, none.score, none.answered_accuracy, none.input_tokens, none.average_latency_ms) == (0, 0.0, None, None, None)
    groups = {r.group_value: (r.planned, r.responses, r.correct_questions) for r in ev.report_groups(runs, rs, q, "category").where("run_id = 1").collect()}
    assert groups == {"math": (2, 2, 1), "science": (1, 1, 0), ev.UNGROUPED: (2, 2, 1)}
    total = ev.report_summary(runs, rs, q, "category").where("group_value IS NULL").first()
    assert (total.responses, total.correct, total.errors) == (5, 2, 2)


def test_blocks_of_515(spark):
    q = spark.createDataFrame([(k, 1, k) for k in range(515)], "question_id LONG, benchmark_id LONG, position LONG")
    runs = spark.createDataFrame([(1, 1, 515), (2, 1, 515)], "run_id LONG, benchmark_id LONG, total_questions LONG")
    rs = responses(spark, [(0, "x", None, 0.0, 100.0, 10, 5, "0.0005"), (511, "x", None, 1.0, 200.0, 10, 5, "0.0005"), (512, "x", "parse_error", 1.0, 300.0, 10, 5, None), (514, "", None, 0.0, None, None, None, None)])
    index = {r.run_id: r for r in ev.progress_index(runs, rs, q).collect()}
    one = index[1]
    assert list(one.block_counts) == [2, 2] and list(index[2].block_counts) == [0, 0]
    assert (one.correct_questions, one.error_questions, one.average_latency_ms) == (2, 1, 200.0)
    assert one.score == pytest.approx(2 / 515 * 100) and one.completion_rate == pytest.approx(3 / 515 * 100) and one.answered_accuracy == 100.0
    assert (one.input_tokens, one.output_tokens, one.estimated_cost) == (None, None, None)
    cells = {r.position: r.outcome for r in ev.progress_cells(runs, rs, q).collect()}
    assert cells == {0: "wrong", 511: "passed", 512: "error", 514: "wrong"}
    assert ev.plan_violations(runs, rs, q.where("question_id <> 514")).collect()[0].code == "response_mapping_missing"


def test_empty_tables(spark):
    rs = responses(spark, [(0, "A", None, 1.0, 1.0, 1, 1, "1")]).limit(0)
    runs = spark.createDataFrame([], "run_id LONG, total_questions LONG")
    assert ev.run_evidence(runs, rs).count() == 0 and ev.first_response_wins(rs).count() == 0
