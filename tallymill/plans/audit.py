"""Queries of the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from .registry import query

TYPES = ["run_admitted", "run_claimed", "run_yielded", "run_terminal", "run_dead_lettered", "run_cancelled"]
CUT = "TIMESTAMP '2024-06-01 00:00:00'"


def at(text):
    return F.lit(text).cast("timestamp")


def bounds(t):
    """Two times within the events, a fifth and four fifths of the way: scalar subqueries of one scan each."""
    row = t.audit_events.agg(F.unix_micros(F.min("occurred_at")).alias("a"), F.unix_micros(F.max("occurred_at")).alias("b"))
    return [row.select(F.timestamp_micros(F.floor(F.col("a") + (F.col("b") - F.col("a")) * k / 5).cast("long"))).scalar() for k in (1, 4)]


BOUNDS = "bounds AS (SELECT min(occurred_at) + (max(occurred_at) - min(occurred_at)) / 5 AS a, min(occurred_at) + (max(occurred_at) - min(occurred_at)) * 4 / 5 AS b FROM {audit_events})"
EPOCH = lambda c: f"CAST(epoch_us({c}) AS BIGINT)"


@query("""SELECT event_id, 'retention_too_short' AS code FROM {audit_events} WHERE retention_class = 'security' UNION ALL SELECT event_id, 'unknown_event_type' FROM {audit_events} WHERE event_type = 'run_dead_lettered'
UNION ALL SELECT event_id, 'unsafe_event_key' FROM {audit_events} WHERE NOT regexp_full_match(event_key, '[A-Za-z0-9][A-Za-z0-9._:-]{{0,127}}') UNION ALL SELECT event_id, 'negative_attempt' FROM {audit_events} WHERE attempt < 0""".replace("{{", "{").replace("}}", "}"))
def audit_event_issues(t):
    return au.event_issues(t.audit_events, TYPES[:4])


@query("""WITH p AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN ['attempt', 'worker'] WHEN event_id % 3 = 1 THEN ['attempt'] ELSE ['attempt', 'note', 'worker'] END AS keys FROM {audit_events})
SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'worker' ELSE '' END AS missing, CASE WHEN event_id % 3 = 2 THEN 'note' ELSE '' END AS extra FROM p WHERE event_type <> 'run_dead_lettered' AND event_id % 3 > 0""")
def audit_payload_issues(t):
    contract = t.spark.createDataFrame([(k, ["attempt", "worker"]) for k in TYPES[:4]], "event_type STRING, keys ARRAY<STRING>")
    payload = F.expr("map_filter(map('attempt', attempt, 'note', 1L, 'worker', worker_id), (k, v) -> CASE k WHEN 'note' THEN event_id % 3 = 2 WHEN 'worker' THEN event_id % 3 <> 1 ELSE true END)")
    found = au.payload_issues(t.audit_events.withColumn("payload", payload), contract)
    return found.select("event_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("""WITH f AS (SELECT *, first_value(event_id) OVER w AS f_id, first_value(worker_id) OVER w AS f_worker, first_value(attempt) OVER w AS f_attempt FROM {audit_events} WINDOW w AS (PARTITION BY event_key ORDER BY occurred_at, event_id))
SELECT event_key, any_value(f_id) AS event_id, count(*) FILTER (worker_id = f_worker AND attempt IS NOT DISTINCT FROM f_attempt) - 1 AS replays, count(*) FILTER (NOT (worker_id = f_worker AND attempt IS NOT DISTINCT FROM f_attempt)) AS conflicts FROM f GROUP BY event_key""")
def dedupe_events(t):
    return au.dedupe_events(t.audit_events, ["worker_id", "attempt"])


@query(f"SELECT event_id, event_type, {EPOCH('occurred_at')} AS at FROM {{audit_events}} WHERE run_id IN (1, 2, 3)")
def run_audit_trail(t):
    return au.trail(t.audit_events, [1, 2, 3]).select("event_id", "event_type", F.unix_micros("occurred_at").alias("at"))


@query(f"""WITH {BOUNDS}, e AS (SELECT event_type FROM {{audit_events}}, bounds WHERE occurred_at >= a AND occurred_at < b)
SELECT k.event_type, (SELECT count(*) FROM e WHERE e.event_type = k.event_type) AS n, (SELECT count(*) FROM e) AS scanned, (SELECT count(*) FROM e) > 5000 AS over_limit FROM (VALUES {", ".join(f"('{x}')" for x in au.EVENT_TYPES)}) AS k(event_type)""")
def event_type_counts(t):
    start, end = bounds(t)
    return au.event_type_counts(t.audit_events, t.spark.createDataFrame([(x,) for x in au.EVENT_TYPES], "event_type STRING"), start, end, 5000)


def chunks(t, size=500):
    return au.archive_chunks(t.audit_events, bounds(t)[1] + F.expr("INTERVAL 90 DAYS"), size)


COLUMNS = ["event_id", "event_key", "event_type", "retention_class", "worker_id"]
LINE = "'{' || " + " || ',' || ".join(f"'\"{c}\":\"' || CAST({c} AS VARCHAR) || '\"'" for c in sorted(COLUMNS)) + " || '}'"
CHUNKS = BOUNDS + ", x AS (SELECT e.*, row_number() OVER (ORDER BY expires_at, event_id) - 1 AS place FROM {audit_events} e, bounds WHERE expires_at < b + INTERVAL 90 DAY), chunks AS (SELECT *, place // 500 AS archive_id FROM x)"
BY_TYPE = " || ',' || ".join(f"'{k}=' || count(*) FILTER (event_type = '{k}')" for k in sorted(au.EVENT_TYPES))
MANIFEST = f"""SELECT archive_id, count(*) AS events, count(*) FILTER (retention_class = 'operational') AS operational_events, count(*) FILTER (retention_class = 'security') AS security_events,
  {BY_TYPE} AS by_type, {EPOCH('min(expires_at)')} AS first_expires, {EPOCH('max(expires_at)')} AS last_expires, sha256(string_agg({LINE.replace("{", "{").replace("}", "}")}, chr(10) ORDER BY place)) AS content_sha256 FROM chunks GROUP BY archive_id"""


@query(f"WITH {CHUNKS} SELECT event_id, place, archive_id FROM chunks")
def archive_chunks(t):
    return chunks(t).select("event_id", "place", "archive_id")


@query(f"WITH {CHUNKS} {MANIFEST}")
def archive_manifest(t):
    found = au.archive_manifest(chunks(t), COLUMNS)
    by_type = F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("archive_id", "events", "operational_events", "security_events", by_type.alias("by_type"), F.unix_micros("first_expires").alias("first_expires"), F.unix_micros("last_expires").alias("last_expires"), "content_sha256")


@query(f"""WITH {CHUNKS}, f AS (SELECT archive_id, count(*) AS n, count(*) FILTER (NOT (archive_id % 3 = 0 AND place % 500 = 7)) AS was_n, count(DISTINCT event_key) < count(*) AS again,
  sha256(string_agg({LINE}, chr(10) ORDER BY place)) AS sha, sha256(string_agg({LINE.replace("CAST(worker_id AS VARCHAR)", "CAST(CASE WHEN archive_id % 3 = 1 THEN worker_id + 1 ELSE worker_id END AS VARCHAR)")}, chr(10) ORDER BY place) FILTER (NOT (archive_id % 3 = 0 AND place % 500 = 7))) AS was FROM chunks GROUP BY archive_id)
SELECT archive_id, array_to_string(list_filter([CASE WHEN n <> was_n THEN 'event_count_mismatch' END, CASE WHEN sha <> was THEN 'content_mismatch' END, CASE WHEN again THEN 'duplicate_key' END], lambda x: x IS NOT NULL), ',') AS codes FROM f WHERE n <> was_n OR sha <> was OR again""")
def verify_archives(t):
    made = chunks(t)
    stored = au.archive_manifest(made.where("NOT (archive_id % 3 = 0 AND place % 500 = 7)").withColumn("worker_id", F.expr("CASE WHEN archive_id % 3 = 1 THEN worker_id + 1 ELSE worker_id END")), COLUMNS)
    return au.verify_archives(made, stored, COLUMNS, bounds(t)[1] + F.expr("INTERVAL 90 DAYS"))


FACTS = ["event_key", "event_type", "worker_id", "attempt"]


def archived_and_stored(t):
    e = t.audit_events
    return e.where("event_id % 2 = 0"), e.where("event_id % 5 > 0").withColumn("worker_id", F.expr("CASE WHEN event_id % 7 = 0 THEN worker_id + 1 ELSE worker_id END"))


PAIR = "a AS (SELECT * FROM {audit_events} WHERE event_id % 2 = 0), s AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN worker_id + 1 ELSE worker_id END AS worker_id) FROM {audit_events} WHERE event_id % 5 > 0)"


@query(f"""WITH {PAIR} SELECT a.event_id, CASE WHEN i.event_id IS NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.event_key = a.event_key) THEN 'absent'
  WHEN i.worker_id = a.worker_id THEN 'exact' ELSE 'conflict' END AS status FROM a LEFT JOIN s i ON a.event_id = i.event_id""")
def reconcile_archive(t):
    return au.reconcile_archive(*archived_and_stored(t), FACTS)


@query(f"""WITH {PAIR}, r AS (SELECT CASE WHEN i.event_id IS NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.event_key = a.event_key) THEN 'absent' WHEN i.worker_id = a.worker_id THEN 'exact' ELSE 'conflict' END AS k FROM a LEFT JOIN s i ON a.event_id = i.event_id),
n AS (SELECT count(*) FILTER (k = 'exact') AS exact, count(*) FILTER (k = 'absent') AS absent, count(*) FILTER (k = 'conflict') AS conflict FROM r)
SELECT CASE WHEN conflict > 0 THEN 'conflict' WHEN absent = 0 THEN 'exact' WHEN exact = 0 THEN 'absent' ELSE 'partial' END AS status, * FROM n""")
def archive_status(t):
    return au.archive_status(au.reconcile_archive(*archived_and_stored(t), FACTS))


@query(f"WITH {BOUNDS} SELECT event_id, (SELECT count(*) FROM {{audit_events}}, bounds WHERE expires_at < b + INTERVAL 90 DAY) > 200 AS has_more FROM {{audit_events}}, bounds WHERE expires_at < b + INTERVAL 90 DAY ORDER BY expires_at, event_id LIMIT 200")
def expired_page(t):
    """The first of those that have expired: the limit is what is asked for."""
    return au.expired_page(t.audit_events, bounds(t)[1] + F.expr("INTERVAL 90 DAYS"), 200).select("event_id", "has_more")


@query(f"""SELECT event_id, 'no_contract' AS code, CAST(NULL AS VARCHAR) AS field FROM {{audit_events}} WHERE event_type = 'run_dead_lettered'
UNION ALL SELECT event_id, 'missing_field', 'note' FROM {{audit_events}} WHERE event_type <> 'run_dead_lettered' AND event_id % 7 = 1 UNION ALL SELECT event_id, 'extra_field', 'more' FROM {{audit_events}} WHERE event_type <> 'run_dead_lettered' AND event_id % 7 = 2
UNION ALL SELECT event_id, 'wrong_kind', 'attempt' FROM {{audit_events}} WHERE event_type <> 'run_dead_lettered' AND event_id % 7 = 3 UNION ALL SELECT event_id, 'payload_hash_mismatch', NULL FROM {{audit_events}} WHERE event_type <> 'run_dead_lettered' AND event_id % 7 IN (1, 2, 3, 4)""")
def audit_payload_faults(t):
    """Payloads with a field too few, too many or of another kind, and hashes that are not theirs."""
    contract = t.spark.createDataFrame([(k, {"attempt": "int", "note": "text"}) for k in TYPES[:5] if k != "run_dead_lettered"], "event_type STRING, kinds MAP<STRING,STRING>")
    payload = F.expr("map_filter(map('attempt', if(event_id % 7 = 3, 'x', CAST(attempt AS STRING)), 'note', concat('n', event_id % 9), 'more', '1'), (k, v) -> CASE k WHEN 'note' THEN event_id % 7 <> 1 WHEN 'more' THEN event_id % 7 = 2 ELSE true END)")
    sent = F.expr("""concat('{"attempt":', coalesce(CAST(attempt AS STRING), 'null'), ',"note":"n', event_id % 9, if(event_id % 7 = 4, '!', ''), '"}')""")
    return au.payload_faults(t.audit_events.withColumns({"payload": payload, "payload_sha256": F.sha2(sent, 256)}), contract)


LATER = "INTERVAL 90 DAYS"
#: Five archives: one exact, one with absent events, one with conflicts and absent events, one absent, and one that has not expired as a whole.
PLACED = f"""{BOUNDS}, a AS (SELECT *, event_id % 5 AS archive_id FROM {{audit_events}}, bounds WHERE event_id % 5 = 4 OR expires_at < b + INTERVAL 90 DAY),
s AS (SELECT * REPLACE (CASE WHEN event_id % 10 = 2 THEN worker_id + 1 ELSE worker_id END AS worker_id) FROM {{audit_events}} WHERE NOT (event_id % 10 = 1 OR event_id % 20 = 7 OR event_id % 5 = 3)),
j AS (SELECT a.archive_id, a.event_id, a.event_key, a.expires_at < b + INTERVAL 90 DAY AS gone, s.event_id IS NULL AS absent, s.worker_id IS DISTINCT FROM a.worker_id AS other FROM a LEFT JOIN s ON a.event_id = s.event_id),
v AS (SELECT archive_id, count(*) FILTER (NOT absent AND NOT other) AS exact, count(*) FILTER (absent) AS absent, count(*) FILTER (NOT absent AND other) AS conflict, bool_and(gone) AS gone FROM j GROUP BY archive_id)"""


def placed(t):
    """(archived events, stored events, time) of PLACED."""
    e, now = t.audit_events, bounds(t)[1] + F.expr(LATER)
    stored = e.where("NOT (event_id % 10 = 1 OR event_id % 20 = 7 OR event_id % 5 = 3)").withColumn("worker_id", F.expr("CASE WHEN event_id % 10 = 2 THEN worker_id + 1 ELSE worker_id END"))
    return e.where((F.col("event_id") % 5 == 4) | (F.col("expires_at") < now)).withColumn("archive_id", F.col("event_id") % 5), stored, now


@query(f"""WITH {PLACED} SELECT archive_id, exact, absent, conflict, CASE WHEN conflict > 0 THEN 'conflict' WHEN absent = 0 THEN 'exact' WHEN exact = 0 THEN 'absent' ELSE 'partial' END AS status,
  conflict = 0 AND absent = 0 AND gone AS may_delete, conflict = 0 AS may_restore FROM v""")
def archive_verdicts(t):
    archived, stored, now = placed(t)
    return au.archive_verdicts(archived, stored, FACTS, now)


@query(f"WITH {PLACED} SELECT event_id, event_key FROM j WHERE absent AND archive_id NOT IN (SELECT archive_id FROM v WHERE conflict > 0)")
def restore_set(t):
    """Nothing of an archive with a conflict comes back."""
    archived, stored, now = placed(t)
    return au.restore_set(archived, stored, FACTS, now).select("event_id", "event_key")


@query(f"WITH {PLACED} SELECT event_id FROM s WHERE event_id NOT IN (SELECT event_id FROM j JOIN v USING (archive_id) WHERE v.conflict = 0 AND v.absent = 0 AND v.gone)")
def delete_set(t):
    """Only archives that are exact and expired as a whole go."""
    archived, stored, now = placed(t)
    return au.after_delete(stored, archived, FACTS, now).select("event_id")


@query("SELECT DISTINCT run_id FROM {responses} WHERE run_id NOT IN (SELECT run_id FROM {audit_events} WHERE run_id IS NOT NULL)")
def missing_ids(t):
    return au.missing_ids(t.responses, t.audit_events, "run_id")


@query(f"""WITH th AS (SELECT DISTINCT run_id, (SELECT a FROM bounds) AS threshold FROM {{audit_events}}), {BOUNDS},
c AS (SELECT th.run_id, e.event_id, e.occurred_at, row_number() OVER (PARTITION BY th.run_id ORDER BY e.occurred_at, e.event_id) AS k FROM th JOIN {{audit_events}} e ON th.run_id = e.run_id AND e.event_type = 'run_claimed' AND e.occurred_at >= threshold)
SELECT th.run_id, c.event_id, {EPOCH('c.occurred_at')} AS at FROM th LEFT JOIN c ON th.run_id = c.run_id AND k = 1""".replace("WITH th AS (SELECT DISTINCT run_id, (SELECT a FROM bounds) AS threshold FROM {audit_events}), " + BOUNDS, "WITH " + BOUNDS + ", th AS (SELECT DISTINCT run_id, (SELECT a FROM bounds) AS threshold FROM {audit_events})"))
def first_claim_at_or_after(t):
    runs = t.audit_events.select("run_id").distinct().withColumn("threshold", bounds(t)[0])
    return au.first_at_or_after(t.audit_events, runs, "run_claimed").select("run_id", "event_id", F.unix_micros("occurred_at").alias("at"))


@query("""WITH g AS (SELECT run_id, (epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY run_id ORDER BY occurred_at, event_type, event_id)) / 1000000 AS gap FROM {audit_events} WHERE event_type IN ('run_claimed', 'run_yielded'))
SELECT run_id, count(*) AS n, CAST(floor(min(gap)) AS BIGINT) AS least, CAST(floor(quantile_cont(gap, 0.5)) AS BIGINT) AS median, CAST(floor(max(gap)) AS BIGINT) AS most FROM g WHERE gap IS NOT NULL GROUP BY run_id""")
def event_gaps(t):
    found = au.event_gaps(t.audit_events, ["run_claimed", "run_yielded"])
    return found.withColumns({c: F.floor(c) for c in ("least", "median", "most")})


@query(f"""WITH f AS (SELECT worker_id, min(occurred_at) AS t, count(*) AS claims FROM {{audit_events}} WHERE event_type = 'run_claimed' GROUP BY worker_id)
SELECT worker_id, {EPOCH('t')} AS first_claim, claims, {EPOCH('max(t) OVER ()')} AS all_claimed_at FROM f""")
def first_claims(t):
    return au.first_claims(t.audit_events, "worker_id").withColumns({c: F.unix_micros(c) for c in ("first_claim", "all_claimed_at")})


@query(f"""WITH l AS (SELECT run_id, min(occurred_at) AS t FROM {{audit_events}} WHERE run_id % 3 > 0 AND event_type = 'run_claimed' GROUP BY run_id), h AS (SELECT max(occurred_at) AS t FROM {{audit_events}} WHERE run_id % 3 = 0 AND event_type = 'run_terminal')
SELECT {EPOCH('(SELECT max(t) FROM l)')} AS last_low_first_claim, (SELECT count(*) FROM l) AS low_runs, {EPOCH('(SELECT t FROM h)')} AS last_high_end, (SELECT max(t) FROM l) < (SELECT t FROM h) AS fair,
  (SELECT count(*) FROM {{audit_events}} WHERE event_type = 'run_terminal' AND occurred_at > (SELECT max(t) FROM l)) AS ends_after""")
def fairness_order(t):
    return au.fairness(t.audit_events, F.expr("run_id % 3 = 0")).withColumns({c: F.unix_micros(c) for c in ("last_low_first_claim", "last_high_end")})


@query("""SELECT run_id, count(*) FILTER (event_type = 'run_claimed') AS claims, count(*) FILTER (event_type = 'run_yielded') AS yields, count(*) FILTER (event_type = 'run_claimed') > 1 AS dispatched_again,
  count(*) FILTER (event_type = 'run_yielded') > 0 AS yielded FROM {audit_events} GROUP BY run_id""")
def scheduling_summary(t):
    return au.scheduling_summary(t.audit_events)


@query(f"""WITH {BOUNDS}, c AS (SELECT run_id, worker_id FROM {{audit_events}}, bounds WHERE event_type = 'run_claimed' AND occurred_at >= b)
SELECT (SELECT count(*) FROM c) AS claims, (SELECT count(DISTINCT run_id) FROM c) AS runs_claimed, (SELECT count(DISTINCT run_id) FROM {{audit_events}}) - (SELECT count(DISTINCT run_id) FROM c) AS runs_without_claim, (SELECT count(DISTINCT worker_id) FROM c) AS workers""")
def worker_participation(t):
    return au.worker_participation(t.audit_events, bounds(t)[1])


@query("SELECT event_id, 'h' || worker_id AS host, event_id % 1000 AS pid FROM {audit_events} WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, NULL FROM {audit_events} WHERE event_id % 2 = 1")
def worker_parts(t):
    name = F.expr("concat(if(event_id % 2 = 0, 'worker:', 'other:'), 'h', worker_id, ':', event_id % 1000, ':', event_key)")
    parts = au.worker_parts(F.replace(name, F.col("event_key"), F.lit("u")))
    return t.audit_events.select("event_id", parts.alias("p")).select("event_id", "p.host", "p.pid")


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_type = 'run_terminal' DESC, CASE WHEN event_type = 'run_terminal' THEN epoch_us(occurred_at) ELSE -epoch_us(occurred_at) END, CASE WHEN event_type = 'run_terminal' THEN event_id ELSE -event_id END) AS k FROM {{audit_events}})
SELECT run_id, event_type AS state, {EPOCH('occurred_at')} AS since FROM o WHERE k = 1""")
def run_state(t):
    return au.run_state(t.audit_events, ["run_terminal"]).withColumn("since", F.unix_micros("since"))
