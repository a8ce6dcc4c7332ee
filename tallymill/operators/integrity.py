"""Whole-table checks: row rules, duplicate keys, orphans, digests and comparisons of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_violations(df: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """(key, rule) for each row that breaks a named rule; a rule is the condition that must not be false (null passes, as in a CHECK)."""
    broken = F.array_compact(F.array(*(F.when(F.expr(f"NOT ({cond})"), F.lit(name)) for name, cond in rules.items())))
    return df.select(*key, F.explode(broken).alias("rule"))


#: Rules of the rows of the evaluation tables, each the condition that must not be false.
TABLE_RULES: dict[str, dict[str, str]] = {
    "runs": {
        "status_known": "status IN ('pending', 'running', 'completed', 'failed', 'cancelled')", "total_questions_not_negative": "total_questions >= 0", "times_in_order": "finished_at >= started_at",
        "max_attempts_positive": "max_attempts > 0", "concurrency_positive": "concurrency > 0", "max_tokens_positive": "max_tokens > 0", "temperature_not_negative": "temperature_setting >= 0", "reservation_not_negative": "input_token_reservation >= 0",
    },
    "responses": {
        "score_in_range": "score >= 0 AND score <= 1", "latency_not_negative": "latency_ms >= 0", "input_tokens_not_negative": "input_tokens >= 0", "output_tokens_not_negative": "output_tokens >= 0", "cost_not_negative": "estimated_cost >= 0",
        "error_has_no_score": "error_type IS NULL OR score = 0", "answer_or_error": "raw_response IS NOT NULL OR error_type IS NOT NULL",
    },
    "ledger": {
        "state_known": "state IN ('reserved', 'send_started', 'settled_actual', 'settled_conservative', 'released')", "reserved_not_negative": "reserved_input_tokens >= 0 AND reserved_output_tokens >= 0 AND reserved_cost_usd >= 0",
        "actual_not_negative": "actual_input_tokens >= 0 AND actual_output_tokens >= 0 AND actual_cost_usd >= 0", "settled_has_actual": "state NOT IN ('settled_actual', 'settled_conservative') OR actual_output_tokens IS NOT NULL",
        "unsettled_has_none": "state NOT IN ('reserved', 'send_started', 'released') OR actual_output_tokens IS NULL",
    },
    "audit_events": {"attempt_not_negative": "attempt >= 0", "kept_after_it_happened": "expires_at > occurred_at", "class_known": "retention_class IN ('operational', 'security')", "key_not_empty": "event_key <> ''"},
    "workers": {"seen_after_start": "last_seen_at >= started_at", "claim_not_after_seen": "last_claim_at <= last_seen_at", "progress_not_after_seen": "last_progress_at <= last_seen_at", "stop_not_before_start": "stopped_at >= started_at"},
    "tasks": {
        "failures_in_range": "failures >= 0 AND failures <= attempts", "lease_only_while_running": "(lease_expires_at IS NOT NULL) = (status = 'running')", "started_unless_pending": "(started_at IS NULL) = (status = 'pending')",
        "finished_only_if_completed": "(finished_at IS NOT NULL) = (status = 'completed')", "times_in_order": "finished_at >= started_at AND started_at >= created_at", "no_more_responses_than_planned": "responded <= planned",
    },
}


#: Rules of a run's counters and rates, beside its plan (see evidence.run_evidence); a rate that is not known yet passes.
COUNTER_RULES: dict[str, str] = {
    "completed_within_total": "completed_questions >= 0 AND completed_questions <= total_questions",
    "correct_within_completed": "correct_questions >= 0 AND correct_questions <= completed_questions",
    "errors_within_completed": "error_questions >= 0 AND error_questions <= completed_questions",
    "score_in_range": "score >= 0 AND score <= 100",
    "completion_rate_in_range": "completion_rate >= 0 AND completion_rate <= 100",
    "answered_accuracy_in_range": "answered_accuracy >= 0 AND answered_accuracy <= 100",
    "usage_not_negative": "input_tokens >= 0 AND output_tokens >= 0 AND estimated_cost >= 0",
}


def rule_counts(tables: dict[str, DataFrame], rules: dict[str, dict[str, str]] = TABLE_RULES) -> DataFrame:
    """(table_name, rule, broken): how many rows of each table break each rule, 0 too; a pass over each table."""
    frames = []
    for table, own in rules.items():
        each = F.array(*(F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("rule"), F.count_if(F.expr(f"NOT ({cond})")).alias("broken")) for name, cond in own.items()))
        frames.append(tables[table].agg(each.alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key is not null and not in parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def require_empty(violations: DataFrame, what: str) -> None:
    """Fails if there is a row, and shows a few."""
    rows = violations.take(5)
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def cap_issues(issues: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first issues of each group in a stable order: a report for people, so `most` is the feature."""
    from pyspark.sql.window import Window

    return issues.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most)


def import_preflight(runs: DataFrame, ledger: DataFrame, workers: DataFrame) -> DataFrame:
    """(check, n): what must be zero before tables are moved."""
    parts = [
        (runs, "active_runs", "status IN ('pending', 'running')"), (ledger, "active_reservations", "state IN ('reserved', 'send_started')"), (workers, "live_workers", "stopped_at IS NULL"),
    ]
    frames = [df.agg(F.count_if(F.expr(cond)).alias("n")).select(F.lit(name).alias("check"), "n") for df, name, cond in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def canonical(df: DataFrame, columns: list[str]) -> Column:
    """One text for a row: columns by name, each value with its type; equal values have equal texts however they are written."""

    def one(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        if kind in ("float", "double"):
            value = F.col(c).cast("double").cast("string")
            value = F.when(F.col(c) == 0, F.lit("0.0")).otherwise(value)
        elif kind == "decimal":
            value = F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        elif kind == "timestamp":
            value = F.unix_micros(F.col(c)).cast("string")
        else:
            value = F.col(c).cast("string")
        return F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("~")))

    return F.concat_ws(";", *map(one, sorted(columns)))


def table_digest(df: DataFrame, key: list[str], columns: list[str], buckets: int = 256) -> DataFrame:
    """One row: (rows, key_digest, row_digest), whatever the order and partitioning of the rows.

    A row's text is hashed; hashes are summed by bucket as exact numbers (a commutative digest), and the
    sorted buckets are hashed. So no task sees all rows and repeated rows count.
    """
    rows = df.select(F.sha2(canonical(df, key), 256).alias("k"), F.sha2(canonical(df, columns), 256).alias("r"))
    part = lambda c, a: F.sum(F.conv(F.substring(c, a, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy(F.conv(F.substring("r", 1, 2), 16, 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *(part(c, a).alias(f"{c}{a}") for c in "kr" for a in (1, 16, 31, 46)))
    whole = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.concat_ws(",", *(F.col(f"{c}{a}").cast("string") for a in (1, 16, 31, 46))).alias("s")))), lambda x: x["s"]), "\n"), 256)
    totals = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *(F.sum(f"k{a}").alias(f"k{a}") for a in (1, 16, 31, 46)), whole("r").alias("row_digest"))
    return totals.select("rows", F.sha2(F.concat_ws(",", *(F.col(f"k{a}").cast("string") for a in (1, 16, 31, 46))), 256).alias("key_digest"), "row_digest")


def summary_mismatch(source: DataFrame, target: DataFrame) -> DataFrame:
    """(table_name, kind) where two summaries (table_name, rows, key_digest, row_digest) differ."""
    a = source.select("table_name", F.struct("rows", "key_digest", "row_digest").alias("a"))
    both = a.join(target.select("table_name", F.struct("rows", "key_digest", "row_digest").alias("b")), "table_name", "full_outer")
    kind = F.when(F.col("a").isNull(), "only_in_target").when(F.col("b").isNull(), "only_in_source").when(F.col("a.rows") != F.col("b.rows"), "row_count").when(F.col("a.key_digest") != F.col("b.key_digest"), "keys").when(F.col("a.row_digest") != F.col("b.row_digest"), "rows")
    return both.select("table_name", kind.alias("kind")).where("kind IS NOT NULL")


def policy_issues(policies: DataFrame, computed_hash: Column) -> DataFrame:
    """(policy_id, code): a stored hash that is not that of the limits; more or less than one active policy."""
    wrong = policies.where(computed_hash != F.col("policy_hash")).select("policy_id", F.lit("policy_hash_mismatch").alias("code"))
    active = policies.agg(F.count_if("is_active").alias("n")).where("n <> 1").select(F.lit(None).cast(policies.schema["policy_id"].dataType).alias("policy_id"), F.lit("active_policy_count").alias("code"))
    return wrong.unionByName(active)


def snapshot_issues(runs: DataFrame, policies: DataFrame, limits: list[str], overrides: list[str]) -> DataFrame:
    """(run_id, code): managed runs whose frozen snapshot is not what their policy and their own settings say.

    runs: (run_id, policy_id, managed, the override columns, snapshot: struct of the limits, provider_scope_key,
    local_admission_only and run_overrides, a struct of the overrides); policies: (policy_id, limits). A run that is
    not managed has no snapshot to keep; one without a policy or a snapshot is a mismatch.
    """
    limit = policies.select("policy_id", F.struct(*limits).alias("__limits"))
    got = lambda f: F.col(f"snapshot.{f}")
    same = [F.equal_null(got(c), F.col(f"__limits.{c}")) for c in limits] + [F.equal_null(got(f"run_overrides.{c}"), F.col(c)) for c in overrides]
    whole = [F.col("__limits").isNotNull(), F.col("snapshot").isNotNull(), got("provider_scope_key").rlike(r"^[0-9a-f]{64}\z"), got("local_admission_only"), got("run_overrides").isNotNull()]
    good = reduce(lambda a, b: a & b, (F.coalesce(x, F.lit(False)) for x in whole + same))
    bad = runs.where("managed").join(limit, "policy_id", "left").where(~good)
    return bad.select("run_id", F.lit("governance_run_snapshot_mismatch").alias("code"))
