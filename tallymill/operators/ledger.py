"""Budgets from an append-only ledger of provider calls: roll-ups by scope and minute, drift, limits and replays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The states that hold a reservation, those that are settled, and those that used up a request.
ACTIVE, SETTLED = ("reserved", "send_started"), ("settled_actual", "settled_conservative")
CONSUMED = ("send_started", *SETTLED)
SCOPES = ("global", "provider", "model", "run")


#: Cells of scopes by a hash, and the rows from which a cell is hot; it is too only with over a thousandth of all rows.
CELLS, HOT = 1 << 16, 1_000_000

AMOUNTS = ("input_tokens", "output_tokens", "cost_usd")


def by_scope(rows: DataFrame, *keep: str) -> DataFrame:
    """Each row once for each of its three or four scopes, with the columns to keep and what it holds or has used up (AMOUNTS; null after a release)."""
    state = F.col("state")
    amounts = [F.when(state.isin(*ACTIVE), F.col(f"reserved_{c}")).when(state.isin(*SETTLED), F.col(f"actual_{c}")).alias(c) for c in AMOUNTS]
    scopes = F.array(*(F.struct(F.lit(s).alias("scope_type"), F.col(f"{s}_scope_id").alias("scope_id")) for s in SCOPES))
    keep = ("operation_id", "policy_id", "state", "window_start", *keep)
    return rows.select(*keep, *amounts, F.explode(F.filter(scopes, lambda x: x["scope_id"].isNotNull())).alias("s")).select("s.scope_type", "s.scope_id", *keep, *AMOUNTS)


def scope_facts(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """by_scope with `above`, a settled row above what it reserved, and `overdrawn`, the same where input and cost count only if the run set a bound itself.

    Only rows whose flag hangs on that bound are joined with the runs.
    """
    over = lambda x: F.coalesce(F.col(f"actual_{x}") > F.col(f"reserved_{x}"), F.lit(False))
    settled, own = F.coalesce(F.col("state").isin(*SETTLED), F.lit(False)), over("input_tokens") | over("cost_usd")
    sure = settled & (over("output_tokens") | (own & F.col("run_id").isNull()))
    rows = ledger.withColumns({"above": settled & (own | over("output_tokens")), "sure": sure})
    bounds = runs.select("run_id", F.col("input_token_reservation").isNotNull().alias("bounded"))
    told = rows.where("above AND NOT sure").join(bounds, "run_id", "left").withColumn("overdrawn", F.coalesce("bounded", F.lit(False)))
    rest = rows.where("NOT above OR sure").withColumn("overdrawn", F.col("sure"))
    return by_scope(rest, "above", "overdrawn").unionByName(by_scope(told, "above", "overdrawn"))


def by_load(facts: DataFrame, ledger: DataFrame, hot: int = HOT) -> list[DataFrame]:
    """The facts of hot scopes, if there are any, and those of the others, of which a scope's are in one partition.

    Partial sums take the former, however many rows a scope has. The latter are too few of a scope for partial sums to
    help, so they go once through a shuffle, as they are, after which all sums and windows of a scope are at hand.
    """
    cell = F.pmod(F.xxhash64("scope_id"), F.lit(CELLS))
    loads = by_scope(ledger).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(hot), F.floor(F.sum("n").over(Window.partitionBy()) / 1000))  # a row for each cell
    crowded = [r.cell for r in loads.withColumn("most", most).where("n > most").select("cell").collect()]  # under 1,000
    spread = lambda df: df.repartition("scope_id")
    return [facts.where(cell.isin(crowded)), spread(facts.where(~cell.isin(crowded)))] if crowded else [spread(facts)]


def usage() -> list[Column]:
    """What scopes and minutes have in common."""
    state, zero = F.col("state"), F.lit(0)
    while_in = lambda states, c: F.coalesce(F.sum(F.when(state.isin(*states), F.col(c)).otherwise(zero)), zero).alias
    count = lambda *states: F.count_if(state.isin(*states)).alias
    return [
        count(*ACTIVE)("active_reservations"), count("reserved")("reserved_requests"), count(*CONSUMED)("consumed_requests"),
        *(while_in(ACTIVE, c)(f"reserved_{c}") for c in AMOUNTS), *(while_in(SETTLED, c)(f"consumed_{c}") for c in AMOUNTS),
        F.bool_or("overdrawn").alias("overdrawn"),
    ]


FIELDS = ["active_reservations", "reserved_requests", "consumed_requests", "reserved_input_tokens", "reserved_output_tokens", "reserved_cost_usd", "consumed_input_tokens", "consumed_output_tokens", "consumed_cost_usd", "overdrawn"]


def scope_rollup(facts: DataFrame) -> DataFrame:
    """Partial aggregation takes the one global scope, however many rows it has."""
    return facts.groupBy("scope_type", "scope_id").agg(*usage())


def minute_rollup(facts: DataFrame, every: bool = False) -> DataFrame:
    """What minutes store; with `every`, also what only scopes do, so that scopes can be added up from it."""
    minute = F.date_trunc("minute", "window_start")
    return facts.groupBy("scope_type", "scope_id", "policy_id", minute.alias("minute")).agg(*(usage() if every else usage()[1:9]))


def add_up(minutes: DataFrame) -> DataFrame:
    """The scopes' roll-up from that of minutes with every part."""
    return minutes.groupBy("scope_type", "scope_id").agg(*(F.sum(c).alias(c) for c in FIELDS[:9]), F.bool_or("overdrawn").alias("overdrawn"))


def overdrawn_scopes(facts: DataFrame) -> DataFrame:
    """(scope_type, scope_id, before, after): the flag without and with the rule of explicit bounds, where either is set."""
    both = facts.groupBy("scope_type", "scope_id").agg(F.bool_or("above").alias("before"), F.bool_or("overdrawn").alias("after"))
    return both.where("before OR after")


def paired(derived: DataFrame, stored: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, d, s): the fields of both tables' rows with a key, null where a table has none."""
    a, b = (df.select(*keys, F.struct(*fields).alias(name)) for df, name in ((derived, "d"), (stored, "s")))
    return a.join(b, keys, "full_outer")


def ledger_drift(derived: DataFrame, stored: DataFrame, keys: list[str], fields: list[str], extra_as_zero: bool = False) -> DataFrame:
    """(keys, kind, fields): rows that are missing in the stored table, extra in it, or differ in fields.

    With extra_as_zero a stored row without ledger facts is compared with zeros instead of being extra.
    """
    return drift_of(paired(derived, stored, keys, fields), keys, fields, extra_as_zero)


def drift_of(pairs: DataFrame, keys: list[str], fields: list[str], extra_as_zero: bool = False) -> DataFrame:
    """ledger_drift of rows that are paired already."""
    kinds = {f.name: f.dataType for f in pairs.schema["d"].dataType.fields}
    value = lambda f: F.when(F.col("d").isNull(), F.lit(0).cast(kinds[f])).otherwise(F.col(f"d.{f}")) if extra_as_zero and f != "overdrawn" else F.coalesce(F.col(f"d.{f}"), F.lit(False)) if extra_as_zero else F.col(f"d.{f}")
    differing = F.array_compact(F.array(*(F.when(~F.equal_null(value(f), F.col(f"s.{f}")), F.lit(f)) for f in fields)))
    kind = F.when(F.col("s").isNull(), "missing").when(F.col("d").isNull() & F.lit(not extra_as_zero), "extra").when(F.size(differing) > 0, "differs")
    return pairs.select(*keys, kind.alias("kind"), F.when(kind == "differs", F.array_join(differing, ",")).otherwise("").alias("fields")).where("kind IS NOT NULL")


def settle_stale(ledger: DataFrame, owners: DataFrame) -> DataFrame:
    """The ledger after active reservations whose lease is no longer their run's are settled: reserved ones are released,
    those being sent are settled as if all that was reserved had been used where nothing is known. `owners` has (run_id, lease_token)."""
    rows = ledger.join(owners.select("run_id", F.col("lease_token").alias("owner")), "run_id", "left")
    stale = F.col("state").isin(*ACTIVE) & ~F.equal_null("owner", "lease_token")
    sent = stale & (F.col("state") == "send_started")
    new = {f"actual_{c}": F.when(sent, F.coalesce(f"actual_{c}", f"reserved_{c}")).otherwise(F.col(f"actual_{c}")) for c in ("input_tokens", "output_tokens", "cost_usd")}
    state = F.when(sent, "settled_conservative").when(stale, "released").otherwise(F.col("state"))
    return rows.withColumns(new | {"was": F.col("state"), "state": state, "settled": stale}).drop("owner")


def stale_counts(settled: DataFrame) -> DataFrame:
    """(run_id, lease_token, released, settled_conservatively) of settle_stale's result."""
    rows = settled.where("settled")
    return rows.groupBy("run_id", "lease_token").agg(F.count_if(F.col("state") == "released").alias("released"), F.count_if(F.col("state") == "settled_conservative").alias("settled_conservatively"))


def limit_verdicts(minutes: DataFrame, policies: DataFrame, overrides: DataFrame, new_tokens: int, new_cost: str) -> DataFrame:
    """(scope_type, scope_id, policy_id, minute, verdict): the first limit that one more call would break, in the order of the checks, or `ok`.

    minutes: minute_rollup's with every part; a scope's all-time usage is added up over its minutes, of which there is a row
    each, so nothing but these sums is put together by scope. policies: (policy_id, scope_type, concurrency, rpm, tpm, request_budget,
    token_budget, cost_budget), a few rows. overrides: (scope_id, request_budget, token_budget, cost_budget) of runs, of which the
    stricter counts. A null limit is none. Minutes that come by scope_id (by_load) are not shuffled again.
    """
    own = overrides.select("scope_id", *(F.col(c).alias(f"own_{c}") for c in ("request_budget", "token_budget", "cost_budget")))
    tokens = F.expr("reserved_input_tokens + reserved_output_tokens + consumed_input_tokens + consumed_output_tokens")
    requests = F.expr("reserved_requests + consumed_requests")
    used = minutes.select(
        "scope_type", "scope_id", "policy_id", "minute", "overdrawn", "active_reservations", requests.alias("minute_requests"), tokens.alias("minute_tokens"),
        F.expr("reserved_cost_usd + consumed_cost_usd").alias("minute_cost"),
    )
    scope = Window.partitionBy("scope_id", "scope_type")
    now = used.withColumns({
        "overdrawn": F.bool_or("overdrawn").over(scope), "active_reservations": F.sum("active_reservations").over(scope), "requests": F.sum("minute_requests").over(scope),
        "tokens": F.sum("minute_tokens").over(scope), "cost": F.sum("minute_cost").over(scope),
    })
    rows = now.join(F.broadcast(policies), ["policy_id", "scope_type"]).join(own, "scope_id", "left")
    budget = lambda c: F.when(F.col("scope_type") == "run", F.least(c, f"own_{c}")).when(F.col("scope_type") == "global", F.col(c))
    cost = F.lit(new_cost).cast("decimal(20,8)")
    checks = [
        (F.col("overdrawn"), "overdrawn"), (F.col("active_reservations") + 1 > F.col("concurrency"), "concurrency"),
        (F.col("minute_requests") + 1 > F.col("rpm"), "rpm"), (F.col("minute_tokens") + new_tokens > F.col("tpm"), "tpm"),
        (F.col("requests") + 1 > budget("request_budget"), "request_budget_exhausted"), (F.col("tokens") + new_tokens > budget("token_budget"), "token_budget_exhausted"),
        (F.col("cost") + cost > budget("cost_budget"), "cost_budget_exhausted"),
    ]
    verdict = F.coalesce(*(F.when(broken, F.lit(code)) for broken, code in checks), F.lit("ok"))
    return rows.select("scope_type", "scope_id", "policy_id", "minute", verdict.alias("verdict"))


def not_before(verdict: Column, now: Column) -> Column:
    """When a call that is put off may be tried again: after a second for concurrency, at the next minute for rates, else never."""
    return F.when(verdict == "concurrency", now + F.expr("INTERVAL 1 SECOND")).when(verdict.isin("rpm", "tpm"), F.date_trunc("minute", now) + F.expr("INTERVAL 1 MINUTE"))


def backlog_admission(runs: DataFrame, limit: int) -> DataFrame:
    """One row: active runs, the limit, and whether one more is accepted."""
    active = F.count_if(F.col("status").isin("pending", "running"))
    return runs.agg(active.alias("active_runs")).select("active_runs", F.lit(limit).cast("long").alias("backlog_limit"), (F.col("active_runs") < limit).alias("accepted"))


def cumulative_budget(ledger: DataFrame, budget: int, hot: int = HOT) -> DataFrame:
    """(scope_id, operation_id, running_tokens): for each scope the first ledger row at which reserved or used tokens pass the budget.

    The rows of a hot scope are never ordered in one task: minutes and days are summed first, the running totals say in which
    day and then in which minute the budget is passed, and only that minute's rows are put in order. Those of other scopes
    go through one shuffle.
    """
    parts = by_load(by_scope(ledger), ledger, hot)
    passed = [_first_past(_tokens(parts[-1]).withColumn("before", F.lit(0).cast("long")), budget)]
    return reduce(DataFrame.unionByName, passed + [_first_past(_passing_minutes(_tokens(p), budget), budget) for p in parts[:-1]])


def _tokens(facts: DataFrame) -> DataFrame:
    held = F.when(F.col("state").isin(*SETTLED), F.expr("coalesce(input_tokens, 0) + coalesce(output_tokens, 0)")).when(F.col("state").isin(*ACTIVE), F.expr("input_tokens + output_tokens")).otherwise(0)
    return facts.select("scope_id", "operation_id", "window_start", held.alias("tokens"))


def _passing_minutes(rows: DataFrame, budget: int) -> DataFrame:
    """The rows of the minute in which each scope's budget is passed, with the total before it."""
    rows = rows.withColumn("minute", F.date_trunc("minute", "window_start"))
    minutes = rows.groupBy("scope_id", "minute").agg(F.sum("tokens").alias("n")).withColumn("day", F.date_trunc("day", "minute"))

    def passing(sums: DataFrame, by: str) -> DataFrame:
        """Of rows (scope_id, before, n) in order of `by` the one in which the budget is passed, with the total before it."""
        until = F.col("before") + F.sum("n").over(Window.partitionBy("scope_id").orderBy(by))
        return sums.withColumn("until", until).where((F.col("until") > budget) & (F.col("until") - F.col("n") <= budget)).select("scope_id", by, (F.col("until") - F.col("n")).alias("before"))

    day = passing(minutes.groupBy("scope_id", "day").agg(F.sum("n").alias("n")).withColumn("before", F.lit(0).cast("long")), "day")
    minute = passing(minutes.join(day, ["scope_id", "day"]), "minute")
    return rows.join(F.broadcast(minute), ["scope_id", "minute"])  # a row for each scope in under 1,000 of CELLS


def _first_past(rows: DataFrame, budget: int) -> DataFrame:
    order = Window.partitionBy("scope_id").orderBy("window_start", "operation_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("running_tokens", F.col("before") + F.sum("tokens").over(order)).where(F.col("running_tokens") > budget)
    first = running.groupBy("scope_id").agg(F.min(F.struct("running_tokens", "window_start", "operation_id")).alias("f"))
    return first.select("scope_id", "f.operation_id", "f.running_tokens")


#: The limits that a policy's hash is over, and those that are money.
POLICY_FIELDS = (
    "global_concurrency_limit", "provider_concurrency_limit", "model_concurrency_limit", "run_concurrency_limit",
    "global_requests_per_minute", "provider_requests_per_minute", "model_requests_per_minute", "run_requests_per_minute",
    "global_tokens_per_minute", "provider_tokens_per_minute", "model_tokens_per_minute", "run_tokens_per_minute",
    "global_lifetime_request_budget", "global_lifetime_token_budget", "global_lifetime_cost_budget_usd",
    "run_lifetime_request_budget", "run_lifetime_token_budget", "run_lifetime_cost_budget_usd", "backlog_limit", "question_quantum",
)
MONEY = ("global_lifetime_cost_budget_usd", "run_lifetime_cost_budget_usd")


def policy_hash(values: dict[str, Column], money: tuple[str, ...] = MONEY) -> Column:
    """SHA-256 of the canonical JSON of a policy's limits: names in order, money as text with eight places."""
    one = lambda name, v: F.coalesce(F.concat(F.lit('"'), v.cast("decimal(20,8)").cast("string"), F.lit('"')) if name in money else v.cast("string"), F.lit("null"))
    inner = F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), one(name, values[name])) for name in sorted(values)))
    return F.sha2(F.concat(F.lit("{"), inner, F.lit("}")), 256)


#: What must be zero in a reconciled ledger.
ZERO = (
    "active_reservations", "scope_active_reservations", "scope_reserved_requests", "scope_reserved_input_tokens", "scope_reserved_output_tokens",
    "minute_reserved_requests", "minute_reserved_input_tokens", "minute_reserved_output_tokens", "overdrawn_scopes", "duplicate_operations", "duplicate_responses",
    "duplicate_event_keys", "active_runs", "missing_scopes", "extra_scopes", "scope_fields", "missing_minutes", "extra_minutes", "minute_fields",
)


def reconciliation_report(runs: DataFrame, responses: DataFrame, ledger: DataFrame, events: DataFrame, scopes: DataFrame, minutes: DataFrame) -> DataFrame:
    """(check, n, must_be_zero): counts of what there is, of states and event types, and of all that ZERO names.

    scopes and minutes: what the ledger gives (scope_rollup, minute_rollup) and what is written down, as `paired` puts them together.
    """
    count, when = F.count(F.lit(1)), lambda c: F.count_if(F.expr(c))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    again = lambda df, *keys: df.groupBy(*keys).agg(count.alias("n"))
    kinds = lambda what: [when(f"kind = '{k}'").alias(name) for k, name in (("missing", f"missing_{what}s"), ("extra", f"extra_{what}s"), ("differs", f"{what}_fields"))]
    held = ("reserved_requests", "reserved_input_tokens", "reserved_output_tokens")
    parts = [
        runs.agg(count.alias("runs"), when("status = 'completed'").alias("completed_runs"), when("status IN ('pending', 'running')").alias("active_runs")),
        responses.agg(count.alias("responses"), F.count("error_type").alias("question_errors")),
        again(responses, "run_id", "question_id").agg(count.alias("distinct_responses"), when("n > 1").alias("duplicate_responses")),
        ledger.agg(F.count_distinct("policy_id").alias("policies"), count.alias("reservations"), when("state IN ('reserved', 'send_started')").alias("active_reservations")),
        again(ledger, "operation_id").agg(when("n > 1").alias("duplicate_operations")),
        again(events, "event_key").agg(when("n > 1").alias("duplicate_event_keys")),
        scopes.agg(*(total(f"s.{c}").alias(f"scope_{c}") for c in ("active_reservations", *held)), when("s.overdrawn").alias("overdrawn_scopes")),
        minutes.agg(*(total(f"s.{c}").alias(f"minute_{c}") for c in held)),
        drift_of(scopes, ["scope_type", "scope_id"], FIELDS).agg(*kinds("scope")),
        drift_of(minutes, ["scope_type", "scope_id", "policy_id", "minute"], FIELDS[1:9]).agg(*kinds("minute")),
    ]
    long = [p.unpivot([], p.columns, "check", "n") for p in parts]
    long += [again(df, c).select(F.concat(F.lit(f"{name}_"), c).alias("check"), "n") for df, c, name in ((ledger, "state", "state"), (events, "event_type", "event"))]
    out = reduce(DataFrame.unionByName, long)
    return out.withColumn("must_be_zero", F.col("check").isin(*ZERO))
