"""Operational metrics: gauges, liveness, latencies, trials and alerts, always as of a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import dealt_by_ranges, exact_percentiles, with_latest, with_previous, with_running_sum

#: Two-sided 95 % and one-sided 95 % points of Student's t for 3 to 10 samples.
STUDENT_T = [(3, 4.302653, 2.919986), (4, 3.182446, 2.353363), (5, 2.776445, 2.131847), (6, 2.570582, 2.015048), (7, 2.446912, 1.94318), (8, 2.364624, 1.894579), (9, 2.306004, 1.859548), (10, 2.262157, 1.833113)]


def seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1_000_000


def latencies(tasks: DataFrame) -> DataFrame:
    """Tasks with their queue, execution and end-to-end times in seconds."""
    c, s, f = F.col("created_at"), F.col("started_at"), F.col("finished_at")
    return tasks.withColumns({"queue": seconds(c, s), "execution": seconds(s, f), "end_to_end": seconds(c, f)})


def latency_percentiles(tasks: DataFrame, start: Column, end: Column, cap: int | None = 10_000) -> DataFrame:
    """(kind, n, p50, p95, p99, truncated) of the tasks that finished in [start, end): exact, by linear interpolation.

    With a cap the first tasks by (finished_at, task_id) count, as a stated sample of all kinds; null means all tasks.
    """
    rows = latencies(tasks).where((F.col("finished_at") >= start) & (F.col("finished_at") < end))
    long = rows.select("task_id", "finished_at", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("queue", "execution", "end_to_end"))), F.array("queue", "execution", "end_to_end"))).alias("kind", "s")).where("s >= 0")
    total = long.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    if cap is not None:
        firsts = rows.where("queue >= 0 OR execution >= 0").orderBy("finished_at", "task_id").limit(cap).select("task_id", F.lit(True).alias("first"))
        long = long.join(firsts, "task_id", "left_semi")
    stats = exact_percentiles(long, ["kind"], "s", (0.5, 0.95, 0.99))
    out = stats.join(total, "kind")
    return out.select("kind", "n", *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{q}") for k, q in enumerate((50, 95, 99))), (F.col("total") > F.col("n")).alias("truncated"))


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, least, mean, p50, p95, p99 and most of each group's values, exact; no task holds a group."""
    v = F.col(value)
    mean = F.sum(v.cast("decimal(30,8)")).cast("double") / F.count(v)
    sums = df.where(v.isNotNull()).groupBy(*keys).agg(F.min(v).alias("least"), F.round(mean, 6).alias("mean"), F.max(v).alias("most"))
    quantiles = exact_percentiles(df, list(keys), value, (0.5, 0.95, 0.99))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in keys]
    both = sums.alias("s").join(quantiles.alias("q"), same) if keys else sums.alias("s").crossJoin(quantiles.alias("q"))
    p = [F.round(F.get("p", F.lit(k)), 6).alias(f"p{q}") for k, q in enumerate((50, 95, 99))]
    return both.select(*(f"s.{c}" for c in keys), "n", "least", "mean", *p, "most")


def due(now: Column) -> Column:
    """A pending task whose next attempt and budget may begin; a time that is not set is no bound, and one that is now has come."""
    come = lambda c: F.coalesce(F.col(c) <= now, F.lit(True))
    return (F.col("status") == "pending") & come("next_attempt_at") & come("not_before")


def lease_expired(now: Column) -> Column:
    """A running task whose lease ended at `now` or before; without a lease there is nothing to expire."""
    return (F.col("status") == "running") & F.coalesce(F.col("lease_expires_at") <= now, F.lit(False))


def task_gauges(tasks: DataFrame, ledger: DataFrame, scopes: DataFrame, now: Column) -> DataFrame:
    """One row of counts and sums over all tasks as of `now`, with calls under way (ledger) and overdrawn scopes."""
    pending, open_ = F.col("status") == "pending", F.col("status").isin("pending", "running")
    expired, n = lease_expired(now), F.count_if
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    row = tasks.agg(
        n(pending).alias("pending"), n(due(now)).alias("due_pending"), n(F.col("status") == "running").alias("running"), n(expired).alias("expired_running"),
        n(F.col("cancel_requested") & open_).alias("active_cancel_requests"), n(pending & F.col("next_attempt_at").isNotNull()).alias("retry_scheduled"),
        n(F.col("dead_lettered_at").isNotNull()).alias("dead_lettered"), n(F.col("last_error") == "queue_unavailable").alias("queue_errors"),
        n(open_ & (F.col("budget_status") != "unmanaged")).alias("managed_backlog"), n(F.col("budget_status") == "delayed").alias("budget_delayed"), n(F.col("budget_status") == "exhausted").alias("budget_exhausted"),
        total("attempts").alias("attempts"), total("failures").alias("failed_attempts"), total("dispatches").alias("dispatches"),
        F.coalesce(F.max(F.when(expired, seconds(F.col("lease_expires_at"), now))), F.lit(0.0)).alias("oldest_expired_lease_s"),
    )
    calls = ledger.agg(n(F.col("state").isin("reserved", "send_started")).alias("active_calls"))
    return row.crossJoin(calls).crossJoin(scopes.agg(n("overdrawn").alias("overdrawn_scopes")))  # one row each


def due_tasks(tasks: DataFrame, now: Column, limit: int, max_failures: int = 3) -> DataFrame:
    """Tasks that may be taken: not cancelled, not out of attempts or budget, not complete; due, or running with an expired
    lease and one more failure allowed. Expired ones first, then those served least recently."""
    expired = lease_expired(now)
    may = ~F.col("cancel_requested") & (F.col("failures") < max_failures) & (F.col("budget_status") != "exhausted") & (F.col("responded") < F.col("planned"))
    rows = tasks.where(may & (due(now) | (expired & (F.col("failures") + 1 < max_failures))))
    order = [F.when(expired, 0).otherwise(1), F.coalesce("started_at", "created_at"), F.col("task_id")]
    return rows.orderBy(*order).limit(limit).select("task_id", "status", expired.alias("expired"))


def retry_delay(failures: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0))), F.lit(cap))


def worker_liveness(workers: DataFrame, now: Column, stale_s: int, wanted: int, live: Column | None = None) -> DataFrame:
    """One row: registered, live (seen at or after now - stale), stalled, and how many of those wanted are short. Stopped workers don't count."""
    active, live = F.col("stopped_at").isNull(), seconds(F.col("last_seen_at"), now) <= stale_s if live is None else live
    out = workers.agg(F.count_if(active).alias("registered"), F.count_if(active & live).alias("live"), F.max(F.when(active, F.col("last_claim_at"))).alias("newest_claim"), F.max(F.when(active, F.col("last_progress_at"))).alias("newest_progress"))
    return out.withColumns({"stalled": F.col("registered") - F.col("live"), "shortfall": F.greatest(F.lit(0).cast("long"), F.lit(wanted) - F.col("live"))})


def worker_oldest_activity(workers: DataFrame, now: Column) -> DataFrame:
    """(activity, age_s) of the oldest of each kind among workers that are not stopped; an age below 0 is a fault of the clocks. `now` is an aggregate or a constant."""
    kinds = ["last_seen_at", "last_claim_at", "last_progress_at"]
    row = workers.where("stopped_at IS NULL").agg(*(F.min(k).alias(k) for k in kinds), now.alias("now"))
    return row.unpivot(["now"], kinds, "activity", "at").select("activity", seconds(F.col("at"), F.col("now")).alias("age_s"))


def metrics_long(gauges: DataFrame, at: Column, names: dict[str, tuple[str, dict[str, str]]] | None = None) -> DataFrame:
    """(metric, labels, value, at): a row of gauges turned into rows; null, negative and non-finite values are left out.

    `names` gives columns the metric and labels (from closed sets) that they stand for; others have their own name and no label.
    """
    names = names or {}
    rows = [(F.lit(names.get(c, (c, {}))[0]), F.create_map(*(F.lit(x) for kv in names.get(c, (c, {}))[1].items() for x in kv)).cast("map<string,string>"), F.col(f"`{c}`").cast("double")) for c in gauges.columns]
    each = F.array(*(F.struct(m.alias("metric"), labels.alias("labels"), v.alias("value")) for m, labels, v in rows))
    return gauges.select(F.explode(each).alias("g")).select("g.*", at.alias("at")).where("value >= 0 AND value < double('infinity')")


def trial_statistics(samples: DataFrame) -> DataFrame:
    """(cell, n, mean, median, deviation, cv, and from 3 to 10 samples the 95 % interval and one-sided bounds)."""
    stats = samples.groupBy("cell").agg(F.count("sample").alias("n"), F.avg("sample").alias("mean"), F.percentile("sample", F.lit(0.5)).alias("median"), F.stddev_samp("sample").alias("deviation"))
    t = samples.sparkSession.createDataFrame(STUDENT_T, "n LONG, t2 DOUBLE, t1 DOUBLE")
    half = lambda q: F.col(q) * F.col("deviation") / F.sqrt("n")
    m = F.col("mean")
    out = stats.join(F.broadcast(t), "n", "left")
    return out.select("cell", "n", "mean", "median", "deviation", F.try_divide("deviation", "mean").alias("cv"), (m - half("t2")).alias("low"), (m + half("t2")).alias("high"), (m - half("t1")).alias("lower_bound"), (m + half("t1")).alias("upper_bound"))


def slo_verdicts(statistics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(cell, metric, value, passed) for thresholds (cell, metric, least, most); a null bound is none, an unknown value fails."""
    numbers = [c for c in statistics.columns if c != "cell"]
    long = statistics.select("cell", *(F.col(c).cast("double") for c in numbers)).unpivot(["cell"], numbers, "metric", "value")
    rows = thresholds.join(long, ["cell", "metric"], "left")
    ok = F.coalesce(F.col("value") >= F.col("least"), F.col("least").isNull()) & F.coalesce(F.col("value") <= F.col("most"), F.col("most").isNull())
    return rows.select("cell", "metric", "value", (ok & F.col("value").isNotNull()).alias("passed"))


def drain_times(events: DataFrame, bursts: DataFrame) -> DataFrame:
    """(cell, trial, drain_s) for bursts (cell, trial, end): seconds from a burst's end to the first time from then on at which no task is open.

    events: (cell, trial, at, change), 1 where a task comes and -1 where it goes; those of one time count together, those
    without a time not at all. 0 if no task is open at the end, null if that time does not come. Open tasks are a running
    sum over ranges of (cell, trial, at), so one trial with all events is many tasks' work.
    """
    keys = ["cell", "trial"]
    changes = events.where("at IS NOT NULL").groupBy(*keys, "at").agg(F.sum("change").alias("change"))
    depth = with_running_sum(dealt_by_ranges(changes, keys, ["at"]), keys, ["at"], "change", "depth").alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    both = bursts.select(*keys, "end").alias("b").join(depth, same, "left")
    at, before = F.col("d.at"), F.col("d.at") <= F.col("b.end")
    found = both.groupBy("b.cell", "b.trial", "b.end").agg(F.max_by(F.when(before, F.col("depth")), F.when(before, at)).alias("open"), F.min(F.when(~before & (F.col("depth") <= 0), at)).alias("empty"))
    return found.select(*keys, F.when(F.coalesce("open", F.lit(0)) <= 0, 0.0).otherwise(seconds(F.col("end"), F.col("empty"))).alias("drain_s"))


def trial_percentile(samples: DataFrame, fraction: float = 0.95) -> DataFrame:
    """(cell, metric, trial, value): the exact percentile of each trial's samples (cell, metric, trial, value)."""
    keys = ["cell", "metric", "trial"]
    return exact_percentiles(samples, keys, "value", (fraction,)).select(*keys, F.get("p", F.lit(0)).alias("value"))


def trial_verdicts(values: DataFrame, limits: DataFrame) -> DataFrame:
    """(cell, metric, trials, worst, passed) for limits (cell, metric, most): passed if each trial's value (cell, metric, trial, value) is known and within the limit.

    A limit that no trial has a value for fails.
    """
    rows = limits.join(values, ["cell", "metric"], "left").groupBy("cell", "metric", "most")
    within = F.coalesce(F.col("value") <= F.col("most"), F.lit(False))
    return rows.agg(F.count("trial").alias("trials"), F.max("value").alias("worst"), F.bool_and(within).alias("passed")).drop("most")


def paired_ratios(samples: DataFrame, above: str, below: str) -> DataFrame:
    """(cell, trial, sample): of each trial the ratio of two cells' samples, for trial_statistics; trials without both are left out."""
    side = lambda cell, name: samples.where(F.col("cell") == cell).select("trial", F.col("sample").alias(name))
    both = side(above, "a").join(side(below, "b"), "trial")
    return both.select(F.lit(f"{above}/{below}").alias("cell"), "trial", F.try_divide("a", "b").alias("sample"))


def zero_event_bound(samples: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(cell, n, bound): the highest error rate that n attempts without an error still allow; null where there was one."""
    rows = samples.groupBy("cell").agg(F.sum("sample").cast("long").alias("n"), F.sum("errors").alias("e"))
    return rows.select("cell", "n", F.when(F.col("e") == 0, 1 - F.pow(F.lit(1 - confidence), 1 / F.col("n"))).alias("bound"))


def phase_throughput(tasks: DataFrame) -> DataFrame:
    """(phase, tasks, completed, retries, wall_s, tasks_per_s, responses_per_s)."""
    wall = seconds(F.min("created_at"), F.max("finished_at"))
    done = F.count_if(F.col("status") == "completed")
    out = tasks.groupBy("phase").agg(F.count(F.lit(1)).alias("tasks"), done.alias("completed"), F.sum("failures").alias("retries"), wall.alias("wall_s"), F.sum(F.when(F.col("status") == "completed", F.col("responded")).otherwise(0)).alias("responses"))
    rate = lambda c: F.round(F.try_divide(c, "wall_s"), 9)
    return out.select("phase", "tasks", "completed", "retries", "wall_s", rate("completed").alias("tasks_per_s"), rate("responses").alias("responses_per_s"))


def events_in_windows(events: DataFrame, windows: DataFrame, at: str = "occurred_at") -> DataFrame:
    """Events with the half-open windows (window_id, start, end) that hold them.

    Both sides are keyed by day, a window once for each day that it touches, so the join is by equality.
    """
    day = lambda c: F.date_trunc("day", c)
    days = windows.where("end > start").withColumn("day", F.explode(F.sequence(day("start"), day("end"), F.expr("INTERVAL 1 DAY"))))
    return events.withColumn("day", day(at)).join(days, "day").where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("day")


#: The alerts, when each is firing over a row of gauges, and for how many seconds it must be (see pending_alerts).
ALERTS: list[tuple[str, str, int]] = [
    ("metrics_unavailable", "up = 0", 120),
    ("backlog_persistent", "due_pending > 0", 900),
    ("dead_lettered", "dead_letter_events > 0", 0),
    ("budget_integrity_error", "integrity_error_events > 0", 0),
    ("budget_overdrawn", "overdrawn_scopes > 0", 0),
    ("queue_degraded", "queue_configured = 1 AND queue_available = 0", 120),
    ("worker_stalled", "shortfall > 0", 120),
    ("lease_recovery_slow", "oldest_expired_lease_s > recovery_threshold_s", 60),
]


def alert_conditions(gauges: DataFrame, rules: list[tuple[str, str, int]] = ALERTS) -> DataFrame:
    """(alert, hold_s, firing) for each named predicate over a row of gauges; one over an unknown value is not firing."""
    rows = F.array(*(F.struct(F.lit(name).alias("alert"), F.lit(hold).alias("hold_s"), F.coalesce(F.expr(cond), F.lit(False)).alias("firing")) for name, cond, hold in rules))
    return gauges.select(F.explode(rows).alias("a")).select("a.*")


def pending_alerts(samples: DataFrame, hold_s: int) -> DataFrame:
    """(alert, since, fired_at): stretches of samples (alert, at, value) with a true value that lasted for hold_s; the first sample at which they had.

    An unknown value is not true; of samples of one time the true ones come last. Samples are dealt by ranges of time
    and stretches are stitched at the ranges' borders, so one alert with all samples is many tasks' work.
    """
    keys, order = ["alert"], ["at", "value"]
    dealt = dealt_by_ranges(samples.select("alert", "at", F.coalesce("value", F.lit(False)).alias("value")), keys, order)
    before = with_previous(dealt, keys, order, "value", "before")
    starts = before.withColumn("start", F.when(F.col("value") & ~F.coalesce("before", F.lit(False)), F.col("at")))
    held = with_latest(starts, keys, order, "start", "since").where(F.col("value") & (seconds(F.col("since"), F.col("at")) >= hold_s))
    return held.groupBy("alert", "since").agg(F.min("at").alias("fired_at"))
