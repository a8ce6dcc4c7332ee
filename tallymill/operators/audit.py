"""A typed audit log: validation, idempotent keys, history, archives and their reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import dealt_by_ranges, exact_percentiles, number_rows, with_previous

#: Days that each retention class keeps at least.
RETENTION_DAYS = {"operational": 90, "security": 365}
SAFE_ID = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
#: The events of tasks.
EVENT_TYPES = (
    "governance_policy_bootstrapped", "governance_policy_applied", "run_admitted", "run_claimed", "run_cancel_requested", "run_deferred", "run_yielded", "run_terminal", "run_retry_scheduled",
    "run_dead_lettered", "run_lease_reconciled", "provider_attempt_reserved", "provider_attempt_send_started", "provider_attempt_settled", "question_evidence_persisted", "queue_notification", "governance_integrity_error",
)
#: What a payload's value of each kind looks like as text.
KINDS = {"int": r"\A-?[0-9]+\z", "bool": r"\A(true|false)\z", "text": r"\A[^\x00-\x1F]{0,256}\z"}


def event_issues(events: DataFrame, types: list[str]) -> DataFrame:
    """(event_id, code) for each rule that an event breaks."""
    days = F.datediff("expires_at", "occurred_at")
    least = F.coalesce(*(F.when(F.col("retention_class") == k, F.lit(d)) for k, d in RETENTION_DAYS.items()))
    rules = {
        "unknown_event_type": ~F.col("event_type").isin(types), "unsafe_event_key": ~F.col("event_key").rlike(SAFE_ID),
        "unknown_retention_class": least.isNull(), "retention_too_short": days < least, "negative_attempt": F.col("attempt") < 0,
    }
    codes = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)) if code == "unknown_event_type" else broken, F.lit(code)) for code, broken in rules.items())))
    return events.select("event_id", F.explode(codes).alias("code"))


def payload_issues(events: DataFrame, contract: DataFrame) -> DataFrame:
    """(event_id, missing, extra) where a payload's keys are not exactly those that the contract (event_type, keys) has for its type."""
    rows = events.join(contract.select("event_type", "keys"), "event_type")
    have = F.map_keys("payload")
    out = rows.select("event_id", F.array_sort(F.array_except("keys", have)).alias("missing"), F.array_sort(F.array_except(have, "keys")).alias("extra"))
    return out.where("size(missing) > 0 OR size(extra) > 0")


def payload_json(payload: Column, kinds: Column) -> Column:
    """Canonical JSON of a payload map<string,string>: names in order, text in quotes, null as null. Values are safe text (see KINDS)."""
    quoted = lambda e: F.concat(F.lit('"'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    one = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.when(e["value"].isNull(), "null").when(F.element_at(kinds, e["key"]).isin("int", "bool"), e["value"]).otherwise(quoted(e)))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(payload)), one), ","), F.lit("}"))


def payload_faults(events: DataFrame, contract: DataFrame) -> DataFrame:
    """(event_id, code, field): fields of a payload (map<string,string>) that miss, are too many or of another kind than the contract
    (event_type, kinds map<string,string>, of KINDS) says, and a payload_sha256 that is not that of the canonical JSON (field null).

    An event whose type has no contract has one fault. The contract, a row for each type, is the small side.
    """
    rows = events.join(contract.select("event_type", "kinds"), "event_type", "left")
    have, want = F.map_keys("payload"), F.map_keys("kinds")
    fault = lambda code: lambda f: F.struct(F.lit(code).alias("code"), f.cast("string").alias("field"))
    value = lambda f: F.element_at("payload", f)
    is_of = lambda f: F.coalesce(*(F.when(F.element_at("kinds", f) == k, value(f).rlike(p)) for k, p in KINDS.items()), F.lit(True))
    none = F.array().cast("array<struct<code:string,field:string>>")
    faults = F.concat(
        F.transform(F.array_except(want, have), fault("missing_field")), F.transform(F.array_except(have, want), fault("extra_field")),
        F.transform(F.filter(F.array_intersect(have, want), lambda f: value(f).isNotNull() & ~is_of(f)), fault("wrong_kind")),
        F.when(~F.equal_null(F.sha2(payload_json(F.col("payload"), F.col("kinds")), 256), F.col("payload_sha256")), F.array(fault("payload_hash_mismatch")(F.lit(None)))).otherwise(none),
    )
    unknown = F.array(fault("no_contract")(F.lit(None)))
    return rows.select("event_id", F.explode(F.when(F.col("kinds").isNull(), unknown).otherwise(faults)).alias("f")).select("event_id", "f.*")


def dedupe_events(events: DataFrame, facts: list[str]) -> DataFrame:
    """(event_key, event_id, replays, conflicts): the first event of each key, how many later ones say the same, and how many do not."""
    first = F.min(F.struct("occurred_at", "event_id", *facts)).alias("first")
    keyed = events.groupBy("event_key").agg(first)
    rows = events.join(keyed, "event_key")
    same = reduce(lambda a, b: a & b, (F.equal_null(F.col(f), F.col(f"first.{f}")) for f in facts))
    n = F.count_if(same)
    return rows.groupBy("event_key").agg(F.first("first.event_id").alias("event_id"), (n - 1).alias("replays"), F.count_if(~same).alias("conflicts"))


def trail(events: DataFrame, run_ids: list[int]) -> DataFrame:
    return events.where(F.col("run_id").isin(run_ids)).orderBy("occurred_at", "event_id")


def event_type_counts(events: DataFrame, types: DataFrame, start: Column, end: Column, most: int = 1_000_000) -> DataFrame:
    """(event_type, n, scanned, over_limit) in [start, end), with zeros; scanned is the number of all events there. Nothing is cut off: more than `most` is only told."""
    inside = events.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    counts = inside.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"))
    return types.select("event_type").join(counts, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0).cast("long")).alias("n")).crossJoin(total.withColumn("over_limit", F.col("scanned") > most))


def expired_events(events: DataFrame, cutoff: Column) -> DataFrame:
    return events.where(F.col("expires_at") < cutoff)


def expired_page(events: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """The first `limit` expired events by (expires_at, event_id), each with has_more: whether there are others."""
    some = expired_events(events, cutoff).orderBy("expires_at", "event_id").limit(limit + 1)
    numbered = some.withColumn("k", F.row_number().over(Window.orderBy("expires_at", "event_id")))  # limit + 1 rows at most
    return numbered.withColumn("has_more", F.max("k").over(Window.partitionBy()) > limit).where(F.col("k") <= limit).drop("k")


def archive_chunks(events: DataFrame, cutoff: Column, size: int = 10_000) -> DataFrame:
    """Expired events with their archive's number and place, in the order of (expires_at, event_id)."""
    numbered = number_rows(expired_events(events, cutoff), ["expires_at", "event_id"], "place")
    return numbered.withColumn("archive_id", F.expr(f"place div {size}"))


def record(columns: list[str]) -> Column:
    """One line of JSON for a row: values as text with their names, in order; null as null."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def archive_manifest(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each archive: counts by retention class, bounds, and a digest of its records in order.

    An archive has a fixed number of events at most, so its records may be put together.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", record(columns).alias("line")))), lambda x: x["line"])
    return chunks.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("events"), *(F.count_if(F.col("retention_class") == k).alias(f"{k}_events") for k in RETENTION_DAYS),
        F.map_from_arrays(F.array(*map(F.lit, EVENT_TYPES)), F.array(*(F.count_if(F.col("event_type") == k) for k in EVENT_TYPES))).alias("by_type"),
        F.min("occurred_at").alias("first_occurred"), F.max("occurred_at").alias("last_occurred"), F.min("expires_at").alias("first_expires"), F.max("expires_at").alias("last_expires"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("content_sha256"),
    )


def verify_archives(chunks: DataFrame, stored: DataFrame, columns: list[str], cutoff: Column) -> DataFrame:
    """(archive_id, codes): what of an archive is not as its stored manifest says; archives without a fault are left out."""
    order = Window.partitionBy("archive_id").orderBy("place")
    here = F.struct("expires_at", "event_id")
    checked = chunks.withColumn("unordered", here <= F.lag(here).over(order)).withColumn("not_expired", F.col("expires_at") >= cutoff)
    faults = checked.groupBy("archive_id").agg(F.bool_or(F.coalesce("unordered", F.lit(False))).alias("unordered"), F.bool_or("not_expired").alias("not_expired"), (F.count(F.lit(1)) != F.count_distinct("event_id")).alias("duplicate_id"), (F.count(F.lit(1)) != F.count_distinct("event_key")).alias("duplicate_key"))
    now = archive_manifest(chunks, columns).select("archive_id", "events", "content_sha256")
    was = stored.select("archive_id", F.col("events").alias("was_events"), F.col("content_sha256").alias("was_sha256"))
    both = now.join(faults, "archive_id").join(was, "archive_id", "full_outer")
    code = lambda broken, name: F.when(broken, F.lit(name))
    codes = F.array_compact(F.array(code(F.col("events").isNull(), "archive_missing"), code(F.col("was_events").isNull(), "manifest_missing"), code(F.col("events") != F.col("was_events"), "event_count_mismatch"), code(F.col("content_sha256") != F.col("was_sha256"), "content_mismatch"), code(F.col("unordered"), "unordered"), code(F.col("not_expired"), "not_expired"), code(F.col("duplicate_id"), "duplicate_id"), code(F.col("duplicate_key"), "duplicate_key")))
    return both.select("archive_id", F.array_join(codes, ",").alias("codes")).where("codes <> ''")


def reconcile_archive(archived: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """(event_id, status): an archived event is exact, absent or a conflict in the table, by its id and by its key (two equal-joins).

    Archived events with an archive_id keep it.
    """
    kept = [c for c in ("archive_id",) if c in archived.columns]
    facts = F.struct(*columns)
    by_id = stored.select(F.col("event_id"), facts.alias("same_id"))
    by_key = stored.groupBy("event_key").agg(F.min("event_id").alias("key_id"))
    rows = archived.select(*kept, "event_id", "event_key", facts.alias("own")).join(by_id, "event_id", "left").join(by_key, "event_key", "left")
    status = F.when(F.col("same_id").isNull() & F.col("key_id").isNull(), "absent").when(F.equal_null("same_id", "own"), "exact").otherwise("conflict")
    return rows.select(*kept, "event_id", status.alias("status"))


def archive_status(reconciled: DataFrame) -> DataFrame:
    """(status, exact, absent, conflict): of reconcile_archive's rows as a whole; conflict if any is one, else exact or absent if all are, else partial."""
    n = {k: F.count_if(F.col("status") == k) for k in ("exact", "absent", "conflict")}
    out = reconciled.agg(*(c.alias(k) for k, c in n.items()))
    status = F.when(F.col("conflict") > 0, "conflict").when(F.col("absent") == 0, "exact").when(F.col("exact") == 0, "absent").otherwise("partial")
    return out.select(status.alias("status"), "exact", "absent", "conflict")


def archive_verdicts(archived: DataFrame, stored: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """(archive_id, exact, absent, conflict, status, may_delete, may_restore): archives go or come back whole or not at all.

    An archive may be deleted if each of its events stands in the table as archived and has expired by `now`, and
    restored if none is in conflict.
    """
    n = {k: F.count_if(F.col("status") == k).alias(k) for k in ("exact", "absent", "conflict")}
    counts = reconcile_archive(archived, stored, columns).groupBy("archive_id").agg(*n.values())
    ends = archived.groupBy("archive_id").agg((F.max("expires_at") < now).alias("expired"))
    status = F.when(F.col("conflict") > 0, "conflict").when(F.col("absent") == 0, "exact").when(F.col("exact") == 0, "absent").otherwise("partial")
    may = [((F.col("status") == "exact") & F.col("expired")).alias("may_delete"), (F.col("conflict") == 0).alias("may_restore")]
    return counts.withColumn("status", status).join(ends, "archive_id").select("archive_id", *n, "status", *may)


def restore_set(archived: DataFrame, stored: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """Events that the table lacks, of the archives (archive_id) without a conflict; of others none."""
    whole = archive_verdicts(archived, stored, columns, now).where("may_restore").select("archive_id")
    return archived.join(whole, "archive_id", "left_semi").join(stored.select("event_id"), "event_id", "left_anti")


def after_delete(stored: DataFrame, archived: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """The table without the events of archives (archive_id) that are exact and expired as a whole; those of others stay."""
    whole = archive_verdicts(archived, stored, columns, now).where("may_delete").select("archive_id")
    return stored.join(archived.join(whole, "archive_id", "left_semi").select("event_id"), "event_id", "left_anti")


def missing_ids(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(there.select(key), key, "left_anti")


def first_at_or_after(events: DataFrame, thresholds: DataFrame, event_type: str) -> DataFrame:
    """(run_id, threshold, event_id, occurred_at): the first event of the type at or after each run's threshold; nulls where none is."""
    rows = thresholds.join(events.where(F.col("event_type") == event_type).select("run_id", "occurred_at", "event_id"), "run_id", "left")
    later = F.when(F.col("occurred_at") >= F.col("threshold"), F.struct("occurred_at", "event_id"))
    return rows.groupBy("run_id", "threshold").agg(F.min(later).alias("f")).select("run_id", "threshold", "f.event_id", "f.occurred_at")


def event_gaps(events: DataFrame, types: list[str]) -> DataFrame:
    """(run_id, n, least, median, most): seconds between a run's consecutive events of the types; a run's events are many tasks' work."""
    keys, order = ["run_id"], ["occurred_at", "event_type", "event_id"]
    dealt = dealt_by_ranges(events.where(F.col("event_type").isin(types)).select(*keys, *order), keys, order)
    gap = (F.unix_micros("occurred_at") - F.unix_micros("before")) / 1_000_000
    gaps = with_previous(dealt, keys, order, "occurred_at", "before").select("run_id", gap.alias("gap")).where("gap IS NOT NULL")
    ends = gaps.groupBy("run_id").agg(F.min("gap").alias("least"), F.max("gap").alias("most"))
    middle = exact_percentiles(gaps, keys, "gap", (0.5,)).select(F.col("run_id").alias("of"), "n", F.get("p", F.lit(0)).alias("median"))
    return ends.join(middle, F.col("run_id").eqNullSafe(F.col("of"))).select("run_id", "n", "least", "median", "most")


def first_claims(events: DataFrame, by: str) -> DataFrame:
    """(by, first_claim, events, all_claimed_at): the first claim of each run or worker, and when the last of them had one."""
    first = events.where("event_type = 'run_claimed'").groupBy(by).agg(F.min("occurred_at").alias("first_claim"), F.count(F.lit(1)).alias("claims"))
    return first.crossJoin(first.agg(F.max("first_claim").alias("all_claimed_at")))


def fairness(events: DataFrame, high: Column) -> DataFrame:
    """One row: did every low-volume run get its first claim before the last end of a high-volume run, and how many ends came after."""
    rows = events.withColumn("high", high)
    low_claim = rows.where("NOT high AND event_type = 'run_claimed'").groupBy("run_id").agg(F.min("occurred_at").alias("t")).agg(F.max("t").alias("last_low_first_claim"), F.count(F.lit(1)).alias("low_runs"))
    high_end = rows.where("high AND event_type = 'run_terminal'").agg(F.max("occurred_at").alias("last_high_end"))
    both = low_claim.crossJoin(high_end)
    after = rows.where("event_type = 'run_terminal'").crossJoin(F.broadcast(both.select("last_low_first_claim"))).agg(F.count_if(F.col("occurred_at") > F.col("last_low_first_claim")).alias("ends_after"))
    return both.withColumn("fair", F.col("last_low_first_claim") < F.col("last_high_end")).crossJoin(after)


def scheduling_summary(events: DataFrame) -> DataFrame:
    """(run_id, claims, yields, dispatched_again, yielded)."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    out = events.groupBy("run_id").agg(n("run_claimed").alias("claims"), n("run_yielded").alias("yields"))
    return out.withColumns({"dispatched_again": F.col("claims") > 1, "yielded": F.col("yields") > 0})


def worker_participation(events: DataFrame, threshold: Column) -> DataFrame:
    """One row: claims at or after the threshold, distinct workers and runs, and runs without a claim then."""
    claim = (F.col("event_type") == "run_claimed") & (F.col("occurred_at") >= threshold)
    per_run = events.groupBy("run_id").agg(F.count_if(claim).alias("n"))
    workers = events.where(claim).agg(F.count_distinct("worker_id").alias("workers"))
    return per_run.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), F.count_if(F.col("n") > 0).alias("runs_claimed"), F.count_if(F.col("n") == 0).alias("runs_without_claim")).crossJoin(workers)


def worker_parts(worker: Column) -> Column:
    """host:pid:uuid of a worker's name that starts with `worker`; null if it is written otherwise."""
    p = F.split(worker, ":")
    return F.when((F.size(p) == 4) & (F.get(p, F.lit(0)) == "worker"), F.struct(F.get(p, F.lit(1)).alias("host"), F.get(p, F.lit(2)).try_cast("long").alias("pid"), F.get(p, F.lit(3)).alias("uuid")))


def run_state(events: DataFrame, terminal: list[str]) -> DataFrame:
    """(run_id, state, since): the latest event's type of each run; a terminal one absorbs what follows."""
    place = F.struct("occurred_at", "event_id", "event_type")
    ends = F.min(F.when(F.col("event_type").isin(terminal), place))
    last = F.coalesce(ends, F.max(place))
    return events.groupBy("run_id").agg(last.alias("x")).select("run_id", F.col("x.event_type").alias("state"), F.col("x.occurred_at").alias("since"))
