from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymill.functions import text as tx
from tallymill.functions.numbering import dealt_by_ranges, number_rows, with_latest, with_previous
from tallymill.operators import audit, datasets, integrity, ledger, ops
from tallymill.operators.evidence import effective, estimate_cost


def test_redaction_masks_tokens(spark):
    t = ["sk-abcdefghij and ghp_" + "a" * 22, 'api_key = "x1y2"', "Authorization: Bearer abc.def", "my own pass", "plain text", None]
    df = spark.createDataFrame([(x,) for x in t], "t STRING")
    got = [r[0] for r in df.select(tx.redact(F.col("t"), ("pass", "own pass"))).collect()]
    assert got[:2] == ["[REDACTED] and [REDACTED]", '[REDACTED]"'] and got[3:] == ["my [REDACTED]", "plain text", None] and "abc" not in got[2]
    m = spark.createDataFrame([({"Api-Key": "1", "x": "bearer abc"},)], "m MAP<STRING,STRING>")
    assert m.select(tx.redact_map(F.col("m"))).first()[0] == {"x": "[REDACTED]"}
    n = spark.range(1).select(tx.attempt_count(F.lit(0)), tx.attempt_count(F.lit(5)), tx.safe_token(F.lit("a b"), 9), tx.safe_token(F.lit("a-b"), 9), tx.safe_csv_cell(F.lit("+1"))).first()
    assert tuple(n) == (None, 5, None, "a-b", "'+1")


def test_money_keeps_its_digits(spark):
    price = F.lit(Decimal("1.5")).cast("decimal(20,8)")
    row = spark.range(1).select(estimate_cost(F.lit(5), F.lit(0), price, price), estimate_cost(F.lit(None).cast("long"), F.lit(0), price, price)).first()
    assert tuple(row) == (Decimal("0.00000750"), None)
    up = spark.range(1).select(estimate_cost(F.lit(1), F.lit(0), F.lit(Decimal("0.00000001")).cast("decimal(20,8)"), price, ceiling=True)).first()[0]
    assert up == Decimal("0.00000001")
    asked = F.create_map(F.lit("t"), F.lit(None).cast("double"))
    assert tuple(spark.range(1).select(effective(asked, "t", F.lit(1.0), F.lit(2.0)), effective(asked, "u", F.lit(None).cast("double"), F.lit(2.0))).first()) == (None, 2.0)


def test_numbering_is_the_global_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS a").repartition(9)
    assert all(r.a == r.row_number for r in number_rows(df, ["a"]).collect())
    assert number_rows(df.limit(0), ["a"]).count() == 0


def test_digest_ignores_order_and_form_only(spark):
    rows = [("a", Decimal("1.23"), -0.0, datetime(2026, 1, 1)), ("b", None, 2.5, None), ("b", None, 2.5, None)]
    kinds = "id STRING, amount DECIMAL({}), ratio DOUBLE, at TIMESTAMP"
    one = spark.createDataFrame(rows, kinds.format("20,8"))
    two = spark.createDataFrame([("b", None, 2.5, None), ("a", Decimal("1.23"), 0.0, datetime(2026, 1, 1)), ("b", None, 2.5, None)], kinds.format("10,2")).repartition(3)
    digest = lambda df: tuple(integrity.table_digest(df, ["id"], df.columns).first())
    assert digest(one) == digest(two)
    other = digest(one.withColumn("ratio", F.col("ratio") + 1))
    assert other[:2] == digest(one)[:2] and other[2] != digest(one)[2]
    assert digest(one.dropDuplicates())[0] == 2 and digest(one.limit(0))[0] == 0
    with pytest.raises(ValueError):
        integrity.require_empty(one, "rows")
    integrity.require_empty(one.limit(0), "rows")


def test_policies(spark):
    p = spark.createDataFrame([("a", "h", True), ("b", "x", True)], "policy_id STRING, policy_hash STRING, is_active BOOLEAN")
    assert sorted((r.policy_id or "", r.code) for r in integrity.policy_issues(p, F.lit("h")).collect()) == [("", "active_policy_count"), ("b", "policy_hash_mismatch")]


def test_overdraw_rules(spark):
    kinds = "operation_id LONG, run_id LONG, policy_id STRING, state STRING, window_start TIMESTAMP, global_scope_id STRING, provider_scope_id STRING, model_scope_id STRING, run_scope_id STRING, reserved_input_tokens LONG, reserved_output_tokens LONG, reserved_cost_usd DECIMAL(20,8), actual_input_tokens LONG, actual_output_tokens LONG, actual_cost_usd DECIMAL(20,8)"
    at, d = datetime(2026, 1, 1), Decimal
    row = lambda k, run, state, a_in, a_out, cost: (k, run, "p", state, at, f"g{k}", "pr", "m", None if run is None else f"r{run}", 10, 10, d(1), a_in, a_out, None if cost is None else d(cost))
    led = spark.createDataFrame([row(1, 1, "settled_actual", 11, 5, "1"), row(2, 2, "settled_actual", 11, 5, "2"), row(3, 2, "settled_conservative", 1, 11, None), row(4, None, "settled_actual", 11, 1, None), row(5, 1, "released", 99, 99, "9"), row(6, 1, "send_started", None, None, None)], kinds)
    runs = spark.createDataFrame([(1, 100), (2, None)], "run_id LONG, input_token_reservation LONG")
    got = {r.scope_id: r for r in ledger.scope_rollup(ledger.scope_facts(led, runs)).where("scope_type = 'global'").collect()}
    assert {k: r.overdrawn for k, r in got.items()} == {"g1": True, "g2": False, "g3": True, "g4": True, "g5": False, "g6": False}
    assert (got["g6"].active_reservations, got["g6"].consumed_requests, got["g6"].reserved_input_tokens, got["g5"].consumed_requests) == (1, 1, 10, 0)
    drift = ledger.ledger_drift(ledger.scope_rollup(ledger.scope_facts(led.limit(0), runs)), ledger.scope_rollup(ledger.scope_facts(led, runs)), ["scope_type", "scope_id"], ["reserved_requests", "consumed_requests"], extra_as_zero=True)
    assert {r.kind for r in drift.collect()} == {"differs"}
    v = spark.createDataFrame([("rpm",), ("concurrency",), ("ok",)], "v STRING").select("v", F.unix_seconds(ledger.not_before(F.col("v"), F.lit(datetime(2026, 1, 1, 0, 0, 30)))).alias("t")).collect()
    assert v[0].t - v[1].t == 29 and v[2].t is None


def test_expiry_is_strict_and_liveness_inclusive(spark):
    now = datetime(2026, 1, 1)
    e = spark.createDataFrame([(1, now), (2, datetime(2025, 12, 31))], "event_id LONG, expires_at TIMESTAMP")
    assert [r.event_id for r in audit.expired_events(e, F.lit(now)).collect()] == [2]
    w = spark.createDataFrame([(1, datetime(2025, 12, 31, 23, 59), None, None, None), (2, datetime(2025, 12, 31, 23, 58, 59), None, None, None), (3, now, None, None, now)], "worker_id LONG, last_seen_at TIMESTAMP, last_claim_at TIMESTAMP, last_progress_at TIMESTAMP, stopped_at TIMESTAMP")
    row = ops.worker_liveness(w, F.lit(now), 60, 3).first()
    assert (row.registered, row.live, row.stalled, row.shortfall) == (2, 1, 1, 2)


def test_line_errors_and_hash(spark):
    lines = ['{"a":1}', "", "{", '{"a":1,"a":2}', '{"a":NaN}', "[1]", '{"a":"\\ud800"}', '{"a":"' + "x" * 300_000 + '"}', "[" * 100_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "v STRING").select(datasets.jsonl_error("v")).collect()]
    assert got == [None, "empty_line", "invalid_json", "duplicate_json_key", "non_finite_number", "object_required", "invalid_unicode", "line_too_large", "json_nesting_too_deep"]
    m = spark.createDataFrame([(1, '{"b": 1.50, "a": "é"}')], "dataset_id INT, value STRING")
    q = spark.createDataFrame([(1, k, f'{{"id": {k}}}') for k in range(50)], "dataset_id INT, line INT, value STRING").repartition(7)
    import hashlib

    want = hashlib.sha256(('{"a":"é","b":1.5}\n' + "".join(f'{{"id":{k}}}\n' for k in range(50))).encode()).hexdigest()
    assert datasets.dataset_hash(m, q).first().dataset_hash == want


def test_snapshot_issues(spark):
    policies = spark.createDataFrame([("p", 5, None)], "policy_id string, rpm long, tpm long")
    scope = "a" * 64
    good = (5, None, scope, True, (7,))
    cases = [("p", True, 7, good), ("p", False, 7, None), ("p", True, 7, None), ("q", True, 7, good), (None, True, 7, good), ("p", True, 8, good), ("p", True, 7, (5, 1, scope, True, (7,))), ("p", True, 7, (5, None, "x", True, (7,))), ("p", True, 7, (5, None, scope, None, (7,)))]
    runs = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "run_id int, policy_id string, managed boolean, tokens long, snapshot struct<rpm:long,tpm:long,provider_scope_key:string,local_admission_only:boolean,run_overrides:struct<tokens:long>>")
    got = integrity.snapshot_issues(runs, policies, ["rpm", "tpm"], ["tokens"]).collect()
    assert sorted(r.run_id for r in got) == [2, 3, 4, 5, 6, 7, 8]


def test_nested_json_loses_its_secrets_and_stays_json(spark):
    import json

    rows = [
        ('{"a":{"api_key":"zzz","note":"x"}}', {"a": {"note": "x"}}),
        ('{"l":[{"Client-Secret":{"deep":[1]},"n":1.0},["Bearer abc","own pass"]],"own pass":2}', {"l": [{"n": 1.0}, ["[REDACTED]", "[REDACTED]"]], "[REDACTED]": 2}),
        ('["secret=abc",null,true,-0.10e5,"\\u00e9\\n\\"q\\""]', ["[REDACTED]", None, True, -0.10e5, 'é\n"q"']),
        ('{"sk-aaaaaaaaaa":1,"sk-bbbbbbbbbb":2}', {"[REDACTED]": 2}),
        ("[" * 30 + '{"cookie":1,"k":"sk-abcdefgh1"}' + "]" * 30, None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + [(10, None), (11, "no json api_key=abc"), (12, "")], "k INT, t STRING")
    got = {r.k: r.t for r in df.select("k", tx.redact_json(F.col("t"), ("own pass",)).alias("t")).collect()}
    for k, (_, want) in enumerate(rows[:4]):
        assert json.loads(got[k]) == want
    assert "-0.10e5" in got[2] and got[4] == "[" * 30 + '{"k":"[REDACTED]"}' + "]" * 30
    assert got[10] is None and got[11] == "no json [REDACTED]" and got[12] == ""


def test_records_are_json_and_ids_end_with_their_text(spark):
    import json

    df = spark.createDataFrame([('a"b\\\n', None), ("x", 'y","w":"z')], "w STRING, v STRING")
    got = [json.loads(r[0]) for r in df.select(audit.record(["w", "v"])).collect()]
    assert got == [{"v": None, "w": 'a"b\\\n'}, {"v": 'y","w":"z', "w": "x"}]
    ids = spark.createDataFrame([("abc",), ("abc\n",), ("-a",), ("a" * 129,)], "id STRING")
    assert [r[0] for r in ids.select(F.col("id").rlike(audit.SAFE_ID)).collect()] == [True, False, False, False]


def test_archives_go_and_come_back_whole_or_not_at_all(spark):
    archived = spark.createDataFrame([(k, f"k{k}", k // 3, 1, 5) for k in range(12)], "event_id INT, event_key STRING, archive_id INT, w INT, expires_at INT")
    # 0: exact; 1: one absent; 2: one in conflict and one absent; 3: absent, but for a key that another event has
    stored = spark.createDataFrame([(k, f"k{k}", 9 if k == 6 else 1, 5) for k in (0, 1, 2, 4, 5, 6, 8)] + [(99, "k9", 1, 5)], "event_id INT, event_key STRING, w INT, expires_at INT")
    verdicts = {r.archive_id: (r.status, r.may_delete, r.may_restore) for r in audit.archive_verdicts(archived, stored, ["event_key", "w"], F.lit(6)).collect()}
    assert verdicts == {0: ("exact", True, True), 1: ("partial", False, True), 2: ("conflict", False, False), 3: ("conflict", False, False)}
    assert sorted(r.event_id for r in audit.restore_set(archived, stored, ["event_key", "w"], F.lit(6)).collect()) == [3]
    assert sorted(r.event_id for r in audit.after_delete(stored, archived, ["event_key", "w"], F.lit(6)).collect()) == [4, 5, 6, 8, 99]
    assert audit.after_delete(stored, archived, ["event_key", "w"], F.lit(5)).count() == 8


def test_percentiles_of_hot_groups_are_those_of_the_engine(spark):
    from tallymill.functions.numbering import exact_percentiles

    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 3 = 2 AND id < 30 THEN null ELSE concat('k', id % 50) END AS g", "CASE WHEN id % 11 = 0 THEN null WHEN id % 7 < 3 THEN 1.5D ELSE pmod(hash(id), 5000) / 8D END AS x", "1 AS n")
    fractions = (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)
    want = {r.g: (r.n, r.p) for r in df.where("x IS NOT NULL").groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, fractions))).alias("p")).collect()}
    got = {r.g: (r.n, r.p) for r in exact_percentiles(df, ["g"], "x", fractions).collect()}
    assert {k: (n, [round(x, 9) for x in p]) for k, (n, p) in got.items()} == {k: (n, [round(x, 9) for x in p]) for k, (n, p) in want.items()}
    assert exact_percentiles(df, [], "x", (0.5,)).first().n == sum(n for n, _ in want.values())
    assert exact_percentiles(df.where("false"), ["g"], "x", (0.5,)).count() == 0


def test_neighbours_are_found_over_the_borders_of_ranges(spark):
    """One key with most rows, null keys and values, and a range's first rows, against a walk."""
    rows = [("hot", k, None if k % 5 else k) for k in range(300)] + [(None, k, k if k == 1 else None) for k in range(4)] + [("one", 7, None)]
    df = spark.createDataFrame(rows, "key STRING, at INT, value INT").repartition(5)
    dealt = dealt_by_ranges(df, ["key"], ["at"])
    assert dealt.where("key = 'hot'").select("__range").distinct().count() > 1
    got = with_latest(with_previous(dealt, ["key"], ["at"], "value", "before"), ["key"], ["at"], "value", "latest").collect()
    want, before, latest = {}, {}, {}
    for key, at, value in rows:
        latest[key] = latest.get(key) if value is None else value
        want[key, at] = (before.get(key), latest[key])
        before[key] = value
    assert {(r.key, r.at): (r.before, r.latest) for r in got} == want and len(got) == len(rows)


def test_alerts_and_gaps_of_one_key_are_many_tasks_work(spark):
    """All samples belong to one alert, all events to one run; no range has most of them."""
    from datetime import timedelta

    start = datetime(2026, 1, 1)
    samples = spark.createDataFrame([("a", start + timedelta(minutes=k), None if k % 50 == 0 else k % 50 != 20) for k in range(400)], "alert STRING, at TIMESTAMP, value BOOLEAN")
    got = sorted((int((r.since - start).total_seconds()) // 60, int((r.fired_at - start).total_seconds()) // 60) for r in ops.pending_alerts(samples, 1200).collect())
    assert got == [(50 * k + 21, 50 * k + 41) for k in range(8)]
    events = samples.select(F.lit(1).alias("run_id"), F.col("at").alias("occurred_at"), F.lit("x").alias("event_type"), F.xxhash64("at").alias("event_id"))
    assert [tuple(r) for r in audit.event_gaps(events, ["x"]).collect()] == [(1, 399, 60.0, 60.0, 60.0)]
    assert audit.event_gaps(events, ["y"]).count() == 0 and ops.pending_alerts(samples.where("false"), 1200).count() == 0


def test_drains_are_those_of_a_plain_sweep(spark):
    import random

    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    after = lambda m: start + timedelta(minutes=m)
    events, bursts, want = [], [], {}
    for trial in ("a", "b", "c", "d", None):
        mine = []
        for _ in range(60):
            a = rng.randrange(200)
            mine += [(a, 1), (a + rng.randrange(1, 9), -1)]
        if trial == "d":
            mine.append((0, 1))  # never goes
        events += [("x", trial, after(m), k) for m, k in mine] + [("x", trial, None, 1)]
        bursts.append(("x", trial, after(100)))
        depth = lambda m: sum(k for n, k in mine if n <= m)  # noqa: B023, E731
        want[trial] = next((60.0 * (m - 100) for m in range(100, 400) if depth(m) == 0), None)
    bursts.append(("x", "none", after(1)))
    want["none"] = 0.0
    e = spark.createDataFrame(events, "cell STRING, trial STRING, at TIMESTAMP, change INT").repartition(7)
    b = spark.createDataFrame(bursts, "cell STRING, trial STRING, end TIMESTAMP")
    assert {r.trial: r.drain_s for r in ops.drain_times(e, b).collect()} == want
    assert want["d"] is None and any(want.values())
    assert ops.drain_times(e.limit(0), b.limit(0)).count() == 0


def test_one_trial_beyond_its_limit_fails_the_cell(spark):
    values = spark.createDataFrame([("x", "m", "1", 1.0), ("x", "m", "2", 2.0), ("y", "m", "1", None), ("z", "m", "1", 2.0)], "cell STRING, metric STRING, trial STRING, value DOUBLE")
    limits = spark.createDataFrame([("x", "m", 1.5), ("y", "m", 9.0), ("z", "m", 2.0), ("w", "m", 9.0)], "cell STRING, metric STRING, most DOUBLE")
    got = {r.cell: (r.trials, r.worst, r.passed) for r in ops.trial_verdicts(values, limits).collect()}
    assert got == {"x": (2, 2.0, False), "y": (1, None, False), "z": (1, 2.0, True), "w": (0, None, False)}
