"""What goes through shuffles must grow with the tables, not with a product of them."""

from contextlib import contextmanager

from pyspark.sql import functions as F


from tallymill.operators import evidence as ev
from tallymill.operators import ledger as lg


@contextmanager
def settings(spark, **wanted):
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def collected(spark, make):
    """The rows of make()'s frame, and how many rows its shuffles wrote."""

    def written(node):
        m = node.metrics().get("shuffleRecordsWritten")
        children = node.children()
        return (m.get().value() if m.isDefined() else 0) + sum(written(children.apply(k)) for k in range(children.size()))

    with settings(spark, **{"spark.sql.adaptive.enabled": "false"}):
        df = make()
        rows = df.collect()
        return rows, written(df._jdf.queryExecution().executedPlan())


def test_pending_questions_are_not_shuffled(spark):
    questions = spark.range(4000).selectExpr("id AS question_id", "1L AS benchmark_id", "id AS position").unionByName(spark.createDataFrame([(None, 1, 7), (9000, 2, 0)], "question_id LONG, benchmark_id LONG, position LONG"))
    runs = spark.range(40).selectExpr("id AS run_id", "if(id = 39, 2L, 1L) AS benchmark_id", "if(id < 10, 'failed', 'running') AS status")
    # run 10 has answered all, 11 some of them twice, 39 a question of another benchmark
    given = [(10, q) for q in range(4000)] + [(11, q) for q in (5, 5, 77, 3999)] + [(39, 5), (3, 8), (12, None)]
    rows, shuffled = collected(spark, lambda: ev.pending_questions(runs, spark.createDataFrame(given, "run_id LONG, question_id LONG"), questions))
    want = {(r, q, 7 if q is None else q) for r in range(10, 39) for q in (*range(4000), None) if (r, q) not in given or q is None} | {(39, 9000, 0)}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert shuffled < 20_000  # of some 112,000 that are pending


def test_blocks_without_a_response_are_no_rows(spark):
    questions = spark.range(20_000).selectExpr("id AS question_id", "1L AS benchmark_id", "id AS position").unionByName(spark.createDataFrame([(20_000, 1, None)], "question_id LONG, benchmark_id LONG, position LONG"))
    runs = spark.range(30).selectExpr("id AS run_id", "CASE id WHEN 3 THEN 0L WHEN 4 THEN 9L ELSE 20000L END AS total_questions")
    given = [(1, 0), (1, 19_999), (1, 640), (1, 641), (2, 64), (3, 5), (4, 8), (4, 9), (4, 70), (5, 20_000)]
    responses = spark.createDataFrame(given, "run_id LONG, question_id LONG").selectExpr(
        "*", "'a' AS raw_response", "CAST(NULL AS STRING) AS error_type", "1D AS score", "2D AS latency_ms", "3L AS input_tokens", "CAST(NULL AS LONG) AS output_tokens", "CAST(1 AS DECIMAL(20,8)) AS estimated_cost",
    )
    rows, shuffled = collected(spark, lambda: ev.progress_index(runs, responses, questions, block=8))
    index = {r.run_id: r for r in rows}
    blocks = {k: {i: n for i, n in enumerate(r.block_counts or []) if n} for k, r in index.items()}
    assert blocks == {k: {} for k in range(30)} | {1: {0: 1, 80: 2, 2499: 1}, 2: {8: 1}, 4: {1: 2}}
    assert {k: r.block_counts and len(r.block_counts) for k, r in index.items()} == {k: 2500 for k in range(30)} | {3: None, 4: 2}
    assert (index[1].completed_questions, index[1].input_tokens, index[1].output_tokens) == (4, 12, None) and (index[3].completed_questions, index[4].completed_questions, index[5].completed_questions) == (0, 2, 0)
    assert shuffled < 25_000  # questions and responses, not 30 times 2,500 blocks


LEDGER = """run_id LONG, global_scope_id STRING, provider_scope_id STRING, model_scope_id STRING, run_scope_id STRING, operation_id LONG, policy_id STRING, state STRING, window_start TIMESTAMP,
reserved_input_tokens LONG, reserved_output_tokens LONG, reserved_cost_usd DECIMAL(20,8), actual_input_tokens LONG, actual_output_tokens LONG, actual_cost_usd DECIMAL(20,8)"""


def calls(spark, n=3000):
    """A ledger of 60 runs, each of them with calls at many minutes."""
    return spark.range(n).selectExpr(
        "id % 60 AS run_id", "'global' AS global_scope_id", "concat('p', id % 2) AS provider_scope_id", "concat('m', id % 30) AS model_scope_id", "if(id % 11 = 0, NULL, concat('r', id % 60)) AS run_scope_id",
        "id * 7919 % 100003 AS operation_id", "'policy' AS policy_id", "CASE id % 4 WHEN 0 THEN 'reserved' WHEN 1 THEN 'settled_actual' WHEN 2 THEN 'released' ELSE 'send_started' END AS state",
        "timestamp_seconds(1700000000 + id * 7919 % 100003 * 11) AS window_start", "10L + id % 3 AS reserved_input_tokens", "id % 5 AS reserved_output_tokens", "CAST(1 AS DECIMAL(20,8)) AS reserved_cost_usd",
        "if(id % 4 = 1, 9L + id % 7, NULL) AS actual_input_tokens", "if(id % 4 = 1, 0L, NULL) AS actual_output_tokens", "CAST(NULL AS DECIMAL(20,8)) AS actual_cost_usd",
    ).to(spark.createDataFrame([], LEDGER).schema)


def test_a_budget_takes_one_shuffle_and_no_other_way_for_hot_scopes(spark):
    ledger, want = calls(spark), {}
    rows = sorted(ledger.collect(), key=lambda r: (r.window_start, r.operation_id))
    for scope in ("global_scope_id", "provider_scope_id", "model_scope_id", "run_scope_id"):
        running = {}
        for r in rows:
            used = {"settled_actual": (r.actual_input_tokens or 0) + (r.actual_output_tokens or 0), "released": 0}.get(r.state, r.reserved_input_tokens + r.reserved_output_tokens)
            if (s := r[scope]) and running.get(s, 0) <= 300:
                running[s] = running.get(s, 0) + used
                want |= {s: (r.operation_id, running[s])} if running[s] > 300 else {}
    for hot in (10**6, 100, 40, 0):  # no scope, the shared ones, most and all are hot
        got, shuffled = collected(spark, lambda: lg.cumulative_budget(ledger, 300, hot=hot))
        assert {r.scope_id: (r.operation_id, r.running_tokens) for r in got} == want
        assert hot < 10**6 or shuffled < 4 * 3000  # once each row for each of its scopes, some without a run


def test_verdicts_take_one_shuffle_and_no_other_way_for_hot_scopes(spark):
    ledger = calls(spark)
    runs = spark.range(60).selectExpr("id AS run_id", "if(id % 3 = 0, 100L, NULL) AS input_token_reservation")
    policies = spark.createDataFrame([("policy", "global", 10**6, None, 60, None, None, None), ("policy", "provider", None, 1, None, None, None, None), ("policy", "model", 60, None, 24, None, None, None), ("policy", "run", None, None, None, 60, 700, None)], "policy_id STRING, scope_type STRING, concurrency LONG, rpm LONG, tpm LONG, request_budget LONG, token_budget LONG, cost_budget DECIMAL(20,8)")
    overrides = spark.range(0, 60, 3).selectExpr("concat('r', id) AS scope_id", "CAST(NULL AS LONG) AS request_budget", "200L AS token_budget", "CAST(NULL AS DECIMAL(20,8)) AS cost_budget")
    found = {}
    for hot in (10**6, 100, 0):
        parts = lg.by_load(lg.scope_facts(ledger, runs), ledger, hot)
        assert len(parts) == (1 if hot == 10**6 else 2)
        made = [collected(spark, lambda f=f: lg.limit_verdicts(lg.minute_rollup(f, every=True), policies, overrides, 5, "0")) for f in parts]
        found[hot] = sorted(tuple(r) for rows, _ in made for r in rows)
        assert hot < 10**6 or made[0][1] < 4 * 3000 + 1000  # once each row for each of its scopes, few with their runs
    assert found[10**6] == found[100] == found[0]
    assert {(r[0], r[4]) for r in found[0]} >= {("run", "overdrawn"), ("run", "ok"), ("run", "token_budget_exhausted"), ("provider", "overdrawn")}


def test_minutes_meet_what_is_stored_without_another_shuffle(spark):
    ledger, keys, fields = calls(spark), ["scope_type", "scope_id", "policy_id", "minute"], lg.FIELDS[1:9]
    runs = spark.range(60).selectExpr("id AS run_id", "if(id % 3 = 0, 100L, NULL) AS input_token_reservation")
    facts = lg.scope_facts(ledger, runs)
    minutes = lg.minute_rollup(lg.by_load(facts, ledger)[-1], every=True)
    lacks, changed = F.minute("minute") % 3 == 0, F.when(F.minute("minute") % 3 == 1, 1).otherwise(0)
    stored = minutes.where(~lacks).withColumn("reserved_requests", F.col("reserved_requests") + changed)
    side = lambda there, df: F.when(there, F.struct(*((F.col(f) + changed if df is stored and f == "reserved_requests" else F.col(f)).alias(f) for f in fields)))
    pairs = minutes.select(*keys, side(F.lit(True), minutes).alias("d"), side(~lacks, stored).alias("s"))
    rows, shuffled = collected(spark, lambda: lg.drift_of(pairs, keys, fields))
    want = lg.ledger_drift(minutes, stored, keys, fields).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and {r.kind for r in rows} == {"missing", "differs"}
    assert shuffled < 4 * 3000 + 1000
    columns = ["scope_type", "scope_id", *lg.FIELDS]
    assert sorted(map(tuple, lg.add_up(minutes).select(*columns).collect())) == sorted(map(tuple, lg.scope_rollup(facts).select(*columns).collect()))
