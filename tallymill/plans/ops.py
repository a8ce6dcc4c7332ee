"""Queries of operational metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, ops
from . import ledger as lg
from .registry import query

NOW = "TIMESTAMP '1996-01-01 00:00:00'"
START, END = "TIMESTAMP '1993-01-01 00:00:00'", "TIMESTAMP '1997-01-01 00:00:00'"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


KINDS = """x AS (SELECT task_id, finished_at, epoch_us(created_at) AS c, epoch_us(started_at) AS s, epoch_us(finished_at) AS f FROM {tasks} WHERE finished_at >= %s AND finished_at < %s),
l AS (SELECT task_id, finished_at, 'queue' AS kind, (s - c) / 1000000 AS v FROM x UNION ALL SELECT task_id, finished_at, 'execution', (f - s) / 1000000 FROM x UNION ALL SELECT task_id, finished_at, 'end_to_end', (f - c) / 1000000 FROM x)""" % (START, END)  # noqa: UP031
QUANTILES = "round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99"


@query(f"WITH {KINDS} SELECT kind, count(*) AS n, {QUANTILES}, false AS truncated FROM l WHERE v >= 0 GROUP BY kind")
def latency_percentiles(t):
    return ops.latency_percentiles(t.tasks, F.expr(START), F.expr(END), cap=None)


@query(f"""WITH {KINDS}, k AS (SELECT task_id FROM x ORDER BY finished_at, task_id LIMIT 1000)
SELECT kind, count(*) FILTER (task_id IN (SELECT task_id FROM k)) AS n, {QUANTILES.replace("(v, 0.5)", "(v, 0.5) FILTER (task_id IN (SELECT task_id FROM k))").replace("(v, 0.95)", "(v, 0.95) FILTER (task_id IN (SELECT task_id FROM k))").replace("(v, 0.99)", "(v, 0.99) FILTER (task_id IN (SELECT task_id FROM k))")},
  count(*) > 1000 AS truncated FROM l WHERE v >= 0 GROUP BY kind""")
def latency_sample(t):
    """The feature is a stated sample: the first rows by time."""
    return ops.latency_percentiles(t.tasks, F.expr(START), F.expr(END), cap=1000)


@query("""SELECT run_id, count(*) AS n, min(latency_ms) AS least, round(avg(latency_ms), 6) AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
  round(quantile_cont(latency_ms, 0.99), 6) AS p99, max(latency_ms) AS most FROM {responses} GROUP BY run_id""")
def distribution(t):
    return ops.distribution(t.responses, "latency_ms", "run_id")


DUE = f"status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= {NOW}) AND (not_before IS NULL OR not_before <= {NOW})"
EXPIRED = f"status = 'running' AND lease_expires_at <= {NOW}"
GAUGES = f"""{lg.FACTS}, scopes AS (SELECT scope_type, scope_id, coalesce(bool_or({lg.OVER}), false) AS overdrawn FROM facts GROUP BY scope_type, scope_id),
g AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER ({DUE}) AS due_pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER ({EXPIRED}) AS expired_running,
  count(*) FILTER (cancel_requested AND status IN ('pending', 'running')) AS active_cancel_requests, count(*) FILTER (status = 'pending' AND next_attempt_at IS NOT NULL) AS retry_scheduled,
  count(dead_lettered_at) AS dead_lettered, count(*) FILTER (last_error = 'queue_unavailable') AS queue_errors, count(*) FILTER (status IN ('pending', 'running') AND budget_status <> 'unmanaged') AS managed_backlog,
  count(*) FILTER (budget_status = 'delayed') AS budget_delayed, count(*) FILTER (budget_status = 'exhausted') AS budget_exhausted,
  CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts, CAST(coalesce(sum(failures), 0) AS BIGINT) AS failed_attempts, CAST(coalesce(sum(dispatches), 0) AS BIGINT) AS dispatches,
  coalesce(max(CASE WHEN {EXPIRED} THEN (epoch_us({NOW}) - epoch_us(lease_expires_at)) / 1000000 END), 0.0) AS oldest_expired_lease_s,
  (SELECT count(*) FROM {{ledger}} WHERE state IN ('reserved', 'send_started')) AS active_calls, (SELECT count(*) FROM scopes WHERE overdrawn) AS overdrawn_scopes FROM {{tasks}})"""


def gauges(t):
    return ops.task_gauges(t.tasks, t.ledger, ledger.scope_rollup(lg.facts(t)), F.expr(NOW))


@query(f"WITH {GAUGES} SELECT * FROM g")
def task_gauges(t):
    return gauges(t)


@query(f"""WITH {GAUGES} SELECT CASE WHEN k IN ('pending', 'running') THEN 'tasks' ELSE k END AS metric, CASE WHEN k IN ('pending', 'running') THEN 'status=' || k ELSE '' END AS labels, CAST(value AS DOUBLE) AS value, 820454400 AS moment
FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM g) ON COLUMNS(*) INTO NAME k VALUE value)""")
def metrics_long(t):
    long = ops.metrics_long(gauges(t), F.expr(NOW), {s: ("tasks", {"status": s}) for s in ("pending", "running")})
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return long.select("metric", labels.alias("labels"), "value", F.unix_seconds("at").alias("moment"))


@query(f"""WITH {GAUGES}, e AS (SELECT count(*) FILTER (event_type = 'run_dead_lettered') AS dead, count(*) FILTER (event_type = 'governance_integrity_error') AS integrity FROM {{audit_events}}),
w AS (SELECT count(*) FILTER (stopped_at IS NULL) AS live FROM {{workers}})
SELECT a.alert, CAST(a.hold_s AS INT) AS hold_s, a.firing FROM g, e, w, unnest([{{'alert': 'metrics_unavailable', 'hold_s': 120, 'firing': false}}, {{'alert': 'backlog_persistent', 'hold_s': 900, 'firing': due_pending > 0}}, {{'alert': 'dead_lettered', 'hold_s': 0, 'firing': dead > 0}},
  {{'alert': 'budget_integrity_error', 'hold_s': 0, 'firing': integrity > 0}}, {{'alert': 'budget_overdrawn', 'hold_s': 0, 'firing': overdrawn_scopes > 0}}, {{'alert': 'queue_degraded', 'hold_s': 120, 'firing': queue_errors > 0}},
  {{'alert': 'worker_stalled', 'hold_s': 120, 'firing': live < 100000}}, {{'alert': 'lease_recovery_slow', 'hold_s': 60, 'firing': oldest_expired_lease_s > 300}}]) AS u(a)""".replace("{{'", "{'").replace("}},", "},").replace("}}]", "}]"))
def alert_conditions(t):
    events = t.audit_events.agg(F.count_if(F.col("event_type") == "run_dead_lettered").alias("dead_letter_events"), F.count_if(F.col("event_type") == "governance_integrity_error").alias("integrity_error_events"))
    short = ops.worker_liveness(t.workers, F.lit(None).cast("timestamp"), 0, 100_000, live=F.lit(True)).select("shortfall")
    row = gauges(t).crossJoin(events).crossJoin(short)  # one row each
    return ops.alert_conditions(row.withColumns({"up": F.lit(1), "queue_configured": F.lit(1), "queue_available": F.expr("if(queue_errors > 0, 0, 1)"), "recovery_threshold_s": F.lit(300)}))


@query(f"""SELECT task_id, status, status = 'running' AS expired FROM {{tasks}} WHERE NOT cancel_requested AND failures < 3 AND budget_status <> 'exhausted' AND responded < planned
AND (({DUE}) OR ({EXPIRED} AND failures + 1 < 3)) ORDER BY CASE WHEN status = 'running' THEN 0 ELSE 1 END, coalesce(started_at, created_at), task_id LIMIT 100""")
def due_runs(t):
    return ops.due_tasks(t.tasks, F.expr(NOW), 100)


@query(f"SELECT task_id, lease_expires_at = {NOW} AS at_the_bound FROM {{tasks}} WHERE {EXPIRED} UNION ALL SELECT task_id, next_attempt_at = {NOW} OR not_before = {NOW} FROM {{tasks}} WHERE {DUE}")
def due_at_the_bound(t):
    """All that is due or expired, those at the very time too."""
    now = F.expr(NOW)
    at = F.when(F.col("status") == "running", F.col("lease_expires_at") == now).otherwise((F.col("next_attempt_at") == now) | (F.col("not_before") == now))
    return t.tasks.where(ops.lease_expired(now) | ops.due(now)).select("task_id", at.alias("at_the_bound"))


@query("SELECT task_id, least(2.0 * pow(2, greatest(failures - 1, 0)), 6.0) AS delay_s FROM {tasks}")
def retry_delay(t):
    return t.tasks.select("task_id", ops.retry_delay(F.col("failures"), 2.0, 6.0).alias("delay_s"))


LATEST = "(SELECT max(last_seen_at) FROM {workers})"


def seen(t):
    """Workers with the time at which the last of all was seen."""
    return t.workers.crossJoin(t.workers.agg(F.max("last_seen_at").alias("latest")))  # one row


@query(f"""SELECT count(*) FILTER (stopped_at IS NULL) AS registered, count(*) FILTER (stopped_at IS NULL AND epoch_us({LATEST}) - epoch_us(last_seen_at) <= 3600000000) AS live,
  count(*) FILTER (stopped_at IS NULL AND epoch_us({LATEST}) - epoch_us(last_seen_at) > 3600000000) AS stalled, greatest(0, 500 - count(*) FILTER (stopped_at IS NULL AND epoch_us({LATEST}) - epoch_us(last_seen_at) <= 3600000000)) AS shortfall FROM {{workers}}""")
def worker_liveness(t):
    return ops.worker_liveness(seen(t), F.col("latest"), 3600, 500).select("registered", "live", "stalled", "shortfall")


@query("""SELECT activity, round((epoch_us(m) - epoch_us(moment)) / 1000000, 6) AS age_s FROM (
  SELECT 'last_seen_at' AS activity, min(last_seen_at) AS moment FROM {workers} WHERE stopped_at IS NULL UNION ALL SELECT 'last_claim_at', min(last_claim_at) FROM {workers} WHERE stopped_at IS NULL UNION ALL SELECT 'last_progress_at', min(last_progress_at) FROM {workers} WHERE stopped_at IS NULL),
  (SELECT max(last_seen_at) AS m FROM {workers})""")
def worker_oldest_activity(t):
    return rounded(ops.worker_oldest_activity(seen(t), F.max("latest")), "age_s")


STATS = "s AS (SELECT cell, count(*) AS n, avg(sample) AS mean, quantile_cont(sample, 0.5) AS median, stddev_samp(sample) AS deviation FROM few GROUP BY cell)"
FEW = "few AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY trial) AS k FROM {trials}) WHERE k <= 8)"


def few(t):
    """The first eight trials of each cell: the bounds are for a few samples."""
    from pyspark.sql.window import Window

    return t.trials.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("trial"))).where("k <= 8").drop("k")


@query(f"""WITH {FEW}, {STATS} SELECT cell, n, round(mean, 6) AS mean, round(median, 6) AS median, round(deviation, 6) AS deviation, round(deviation / mean, 6) AS cv, round(mean - t2 * deviation / sqrt(n), 6) AS low, round(mean + t2 * deviation / sqrt(n), 6) AS high,
  round(mean - t1 * deviation / sqrt(n), 6) AS lower_bound, round(mean + t1 * deviation / sqrt(n), 6) AS upper_bound FROM s LEFT JOIN (VALUES {", ".join(map(str, ops.STUDENT_T))}) AS t(k, t2, t1) ON n = k""")
def trial_statistics(t):
    return rounded(ops.trial_statistics(few(t)), "mean", "median", "deviation", "cv", "low", "high", "lower_bound", "upper_bound")


@query("SELECT cell, count(*) AS n, round(avg(sample), 6) AS mean, round(quantile_cont(sample, 0.5), 6) AS median, round(stddev_samp(sample), 6) AS deviation, round(stddev_samp(sample) / avg(sample), 6) AS cv FROM {trials} GROUP BY cell")
def trial_statistics_all(t):
    return rounded(ops.trial_statistics(t.trials), "mean", "median", "deviation", "cv").select("cell", "n", "mean", "median", "deviation", "cv")


@query(f"""WITH {FEW}, {STATS} SELECT k.cell, k.metric, round(CASE k.metric WHEN 'mean' THEN mean WHEN 'cv' THEN deviation / mean END, 6) AS value,
  coalesce(CASE k.metric WHEN 'mean' THEN mean WHEN 'cv' THEN deviation / mean END >= least, least IS NULL) AND coalesce(CASE k.metric WHEN 'mean' THEN mean WHEN 'cv' THEN deviation / mean END <= most, most IS NULL) AND s.cell IS NOT NULL AS passed
FROM (VALUES ('click', 'mean', 1.0, NULL), ('click', 'cv', NULL, 0.01), ('view', 'mean', 1000000.0, NULL), ('nothing', 'cv', NULL, 1.0)) AS k(cell, metric, least, most) LEFT JOIN s ON k.cell = s.cell""")
def slo_verdicts(t):
    """Over the first eight trials of each cell, as trial_statistics."""
    limits = t.spark.createDataFrame([("click", "mean", 1.0, None), ("click", "cv", None, 0.01), ("view", "mean", 1e6, None), ("nothing", "cv", None, 1.0)], "cell STRING, metric STRING, least DOUBLE, most DOUBLE")
    return rounded(ops.slo_verdicts(ops.trial_statistics(few(t)), limits), "value")


DRAINS = """o AS (SELECT phase AS cell, strftime(created_at, '%Y-%m') AS trial, created_at, lease_expires_at FROM {tasks} WHERE status = 'running' OR (status = 'pending' AND task_id % 97 = 0)),
changes AS (SELECT cell, trial, created_at AS moment, 1 AS change FROM o UNION ALL SELECT cell, trial, lease_expires_at, -1 FROM o WHERE lease_expires_at IS NOT NULL),
depths AS (SELECT DISTINCT cell, trial, moment, sum(change) OVER (PARTITION BY cell, trial ORDER BY moment) AS depth FROM changes),
bursts AS (SELECT DISTINCT cell, trial, CAST(trial || '-05' AS TIMESTAMP) AS finish FROM o),
drains AS (SELECT b.cell, b.trial, CASE WHEN coalesce(max_by(depth, moment) FILTER (moment <= finish), 0) <= 0 THEN 0.0 ELSE (epoch_us(min(moment) FILTER (moment > finish AND depth <= 0)) - epoch_us(finish)) / 1000000 END AS drain_s
  FROM bursts b LEFT JOIN depths d ON b.cell = d.cell AND b.trial = d.trial GROUP BY b.cell, b.trial, finish)"""


@query(f"WITH {DRAINS} SELECT * FROM drains")
def drain_times(t):
    """A phase's open tasks of a month, after its fifth day: those with a lease until it ends; of those without, which stay open, a few are in it."""
    rows = t.tasks.where("status = 'running' OR (status = 'pending' AND task_id % 97 = 0)").select(F.col("phase").alias("cell"), F.date_format("created_at", "yyyy-MM").alias("trial"), "created_at", "lease_expires_at")
    changes = F.array(F.struct(F.col("created_at").alias("at"), F.lit(1).alias("change")), F.struct(F.col("lease_expires_at").alias("at"), F.lit(-1).alias("change")))
    events = rows.select("cell", "trial", F.explode(changes).alias("e")).select("cell", "trial", "e.*")
    bursts = rows.select("cell", "trial").distinct().withColumn("end", F.to_timestamp(F.concat("trial", F.lit("-05"))))
    return ops.drain_times(events, bursts)


@query(f"""WITH {DRAINS}, times AS (SELECT phase AS cell, strftime(created_at, '%Y-%m') AS trial, (epoch_us(finished_at) - epoch_us(created_at)) / 1000000 AS s FROM {{tasks}} WHERE finished_at IS NOT NULL),
v AS (SELECT cell, 'drain_s' AS metric, trial, drain_s AS value FROM drains UNION ALL SELECT cell, 'p95_s', trial, quantile_cont(s, 0.95) FROM times GROUP BY cell, trial)
SELECT l.cell, l.metric, count(trial) AS trials, round(max(value), 6) AS worst, bool_and(coalesce(value <= most, false)) AS passed
FROM (VALUES ('1-URGENT', 'drain_s', 10000000.0), ('3-MEDIUM', 'drain_s', 864000.0), ('1-URGENT', 'p95_s', 30000.0), ('2-HIGH', 'p95_s', 10000.0), ('nothing', 'p95_s', 1.0)) AS l(cell, metric, most)
LEFT JOIN v ON l.cell = v.cell AND l.metric = v.metric GROUP BY l.cell, l.metric""")
def trial_verdicts(t):
    """Each trial's drain and p95 of end-to-end time against the limits of its cell."""
    drains = drain_times(t).select("cell", F.lit("drain_s").alias("metric"), "trial", F.col("drain_s").alias("value"))
    times = ops.latencies(t.tasks).where("end_to_end IS NOT NULL").select(F.col("phase").alias("cell"), F.lit("p95_s").alias("metric"), F.date_format("created_at", "yyyy-MM").alias("trial"), F.col("end_to_end").alias("value"))
    limits = [("1-URGENT", "drain_s", 1e7), ("3-MEDIUM", "drain_s", 864e3), ("1-URGENT", "p95_s", 3e4), ("2-HIGH", "p95_s", 1e4), ("nothing", "p95_s", 1.0)]
    values = drains.unionByName(ops.trial_percentile(times))
    return rounded(ops.trial_verdicts(values, t.spark.createDataFrame(limits, "cell STRING, metric STRING, most DOUBLE")), "worst")


@query("SELECT cell, CAST(sum(sample) AS BIGINT) AS n, CASE WHEN sum(errors) = 0 THEN round(1 - pow(0.05, 1 / sum(sample)), 6) END AS bound FROM (SELECT cell, sample, CASE WHEN cell = 'click' THEN 0 ELSE errors END AS errors FROM {trials}) GROUP BY cell")
def zero_event_bound(t):
    return rounded(ops.zero_event_bound(t.trials.withColumn("errors", F.expr("if(cell = 'click', 0, errors)"))), "bound")


@query("""SELECT phase, count(*) AS tasks, count(*) FILTER (status = 'completed') AS completed, CAST(sum(failures) AS BIGINT) AS retries, (epoch_us(max(finished_at)) - epoch_us(min(created_at))) / 1000000 AS wall_s,
  round(count(*) FILTER (status = 'completed') / ((epoch_us(max(finished_at)) - epoch_us(min(created_at))) / 1000000), 9) AS tasks_per_s,
  round(sum(responded) FILTER (status = 'completed') / ((epoch_us(max(finished_at)) - epoch_us(min(created_at))) / 1000000), 9) AS responses_per_s FROM {tasks} GROUP BY phase""")
def phase_throughput(t):
    return ops.phase_throughput(t.tasks)


WINDOWS = "w AS (SELECT o_orderkey AS window_id, CAST(o_orderdate AS TIMESTAMP) AS start, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 60) * INTERVAL '1' HOUR AS stop FROM {orders})"


@query(f"WITH {WINDOWS} SELECT window_id, count(*) AS n FROM w JOIN {{responses}} r ON r.created_at >= start AND r.created_at < stop GROUP BY window_id")
def events_in_windows(t):
    windows = t.orders.selectExpr("o_orderkey AS window_id", "CAST(o_orderdate AS TIMESTAMP) AS start", "CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 60) * INTERVAL '1' HOUR AS end")
    times = t.responses.groupBy("created_at").agg(F.count(F.lit(1)).alias("k"))
    return ops.events_in_windows(times, windows, "created_at").groupBy("window_id").agg(F.sum("k").alias("n"))


@query("""WITH s AS (SELECT event_type AS alert, date_trunc('hour', occurred_at) AS moment, count(*) > 3 AS value FROM {audit_events} GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY moment) - row_number() OVER (PARTITION BY alert, value ORDER BY moment) AS island FROM s), f AS (SELECT *, min(moment) OVER (PARTITION BY alert, island) AS since FROM g WHERE value)
SELECT alert, CAST(epoch(since) AS BIGINT) AS since, CAST(epoch(min(moment)) AS BIGINT) AS fired_at FROM f WHERE epoch(moment) - epoch(since) >= 7200 GROUP BY alert, since""")
def pending_alerts(t):
    samples = t.audit_events.groupBy(F.col("event_type").alias("alert"), F.date_trunc("hour", "occurred_at").alias("at")).agg((F.count(F.lit(1)) > 3).alias("value"))
    return ops.pending_alerts(samples, 7200).withColumns({c: F.unix_seconds(c) for c in ("since", "fired_at")})


@query("""SELECT trial, 'click/view' AS cell, round(a.sample / b.sample, 6) AS sample FROM (SELECT trial, sample FROM {trials} WHERE cell = 'click') a JOIN (SELECT trial, sample FROM {trials} WHERE cell = 'view') b USING (trial)""")
def paired_ratios(t):
    return rounded(ops.paired_ratios(t.trials, "click", "view"), "sample")
