"""Metrics of evaluation runs from their stored responses: per run, per block of questions and per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Questions of a progress block.
BLOCK = 512
UNGROUPED = "__ungrouped__"

HAS_OUTPUT = "raw_response IS NOT NULL AND raw_response <> ''"
#: What every roll-up adds up; ratios are only taken after the last sum.
PARTS: dict[str, str] = {
    "responses": "count(*)",
    "score_sum": "coalesce(sum(score), 0D)",
    "completed_outputs": f"count_if({HAS_OUTPUT})",
    "evaluable": f"count_if(error_type IS NULL AND {HAS_OUTPUT})",
    "errors": "count(error_type)",
    "latency_sum": "coalesce(sum(CAST(latency_ms AS DECIMAL(28,6))), 0)",
    "latency_reports": "count(latency_ms)",
    "known_input_tokens": "coalesce(sum(input_tokens), 0)",
    "input_token_reports": "count(input_tokens)",
    "known_output_tokens": "coalesce(sum(output_tokens), 0)",
    "output_token_reports": "count(output_tokens)",
    "known_cost": "coalesce(sum(estimated_cost), 0)",
    "cost_reports": "count(estimated_cost)",
}


def first_response_wins(responses: DataFrame) -> DataFrame:
    """One response for each (run, question): the first by time, then id, then the other columns, so ties never depend on the order of rows."""
    rest = [c for c in responses.columns if c not in ("run_id", "question_id", "created_at", "response_id")]
    whole = F.struct("created_at", "response_id", *rest)
    return responses.groupBy("run_id", "question_id").agg(F.min(whole).alias("r")).select("run_id", "question_id", "r.*").select(*responses.columns)


def response_dispositions(responses: DataFrame) -> DataFrame:
    """(run_id, question_id, stored, already_present): how many rows of each key idempotent storing would keep or turn away."""
    n = F.count(F.lit(1))
    return responses.groupBy("run_id", "question_id").agg(F.lit(1).cast("long").alias("stored"), (n - 1).alias("already_present"))


def outcome(error_type: Column, score: Column) -> Column:
    return F.when(error_type.isNotNull(), "error").when(score == 1.0, "passed").otherwise("wrong")


def sums(responses: DataFrame, *keys: str) -> DataFrame:
    return responses.groupBy(*keys).agg(*(F.expr(e).alias(k) for k, e in PARTS.items()))


def add_up(parts: DataFrame, *keys: str) -> DataFrame:
    """The same sums over coarser keys."""
    return parts.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in PARTS))


def metrics(parts: DataFrame, planned: str = "total_questions") -> DataFrame:
    """Adds the metrics of sums and a plan. Totals are null unless every response reported; accuracy divides the rounded number of correct."""
    plan, zero = F.col(planned), F.lit(0)
    sized = parts.na.fill(0, [k for k in PARTS if k not in ("known_cost", "latency_sum")]).withColumns({k: F.coalesce(k, zero.cast(parts.schema[k].dataType)) for k in ("known_cost", "latency_sum")})
    correct = F.bround("score_sum", 0).cast("long")
    percent = lambda a, b: F.when(b > 0, a.cast("double") / b * 100)
    total = lambda known, reports: F.when((F.col("responses") > 0) & (F.col(reports) == F.col("responses")), F.col(known))
    return sized.withColumns({
        "completed_questions": F.col("responses"),
        "correct_questions": correct,
        "error_questions": F.col("errors"),
        "score": F.coalesce(percent(F.col("score_sum"), plan), F.lit(0.0)),
        "completion_rate": F.coalesce(percent(F.col("completed_outputs"), plan), F.lit(0.0)),
        "answered_accuracy": percent(correct, F.col("evaluable")),
        "average_latency_ms": F.when(F.col("latency_reports") > 0, F.col("latency_sum").cast("double") / F.col("latency_reports")),
        "input_tokens": total("known_input_tokens", "input_token_reports"),
        "output_tokens": total("known_output_tokens", "output_token_reports"),
        "estimated_cost": total("known_cost", "cost_reports"),
    })


METRICS = ["completed_questions", "correct_questions", "error_questions", "score", "completion_rate", "answered_accuracy", "average_latency_ms", "input_tokens", "output_tokens", "estimated_cost"]


def run_evidence(runs: DataFrame, responses: DataFrame) -> DataFrame:
    """(run_id, total_questions, metrics) for each run, those without a response too."""
    return metrics(runs.select("run_id", "total_questions").join(sums(responses, "run_id"), "run_id", "left")).select("run_id", "total_questions", *METRICS)


def placed(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses with their question's benchmark and position; only those columns of the questions take part."""
    return responses.join(questions.select("question_id", F.col("benchmark_id").alias("question_benchmark"), "position"), "question_id")


def progress_blocks(runs: DataFrame, responses: DataFrame, questions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, block_index, sums) for each block of each run's plan; blocks without a response have zeros."""
    plan = runs.where("total_questions > 0").select("run_id", F.explode(F.expr(f"sequence(0L, (total_questions - 1) div {block})")).alias("block_index"))
    found = sums(placed(responses, questions).withColumn("block_index", F.expr(f"position div {block}")), "run_id", "block_index")
    out = plan.join(found, ["run_id", "block_index"], "left")
    return out.select("run_id", "block_index", *(F.coalesce(k, F.lit(0).cast(found.schema[k].dataType)).alias(k) for k in PARTS))


def progress_index(runs: DataFrame, responses: DataFrame, questions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Metrics of each run, from one scan of the responses by blocks, with the blocks' response counts in order.

    A run's blocks are only listed in its own row, so that blocks without a response are never rows. Responses go once
    through a shuffle, by their run; a run has a question's response once, so its rows are bounded by its plan.
    """
    rows = placed(responses, questions).withColumn("block_index", F.expr(f"position div {block}"))
    found = sums(rows.repartition("run_id"), "run_id", "block_index")
    inside = F.expr(f"total_questions > 0 AND block_index BETWEEN 0 AND (total_questions - 1) div {block}")
    listed = F.array_sort(F.collect_list(F.when(inside, F.struct("block_index", "responses"))))
    blocks = runs.select("run_id", "total_questions").join(found, "run_id", "left")
    per_run = blocks.groupBy("run_id", "total_questions").agg(*(F.sum(F.when(inside, F.col(k))).alias(k) for k in PARTS), listed.alias("listed"))
    index = lambda k: F.coalesce(F.get("listed", k)["block_index"], F.lit(-1).cast("long"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    known = F.transform("listed", lambda x, k: F.concat(zeros(x["block_index"] - index(k - 1) - 1), F.array(x["responses"])))
    after = zeros(F.expr(f"(total_questions - 1) div {block}") - index(F.size("listed") - 1))
    counts = F.when(F.col("total_questions") > 0, F.flatten(F.concat(known, F.array(after))))
    return metrics(per_run).select("run_id", *METRICS, counts.alias("block_counts"))


def progress_cells(runs: DataFrame, responses: DataFrame, questions: DataFrame) -> DataFrame:
    """One compact row for each response that lies in its run's plan."""
    cells = placed(responses, questions).join(runs.select("run_id", F.col("benchmark_id").alias("plan"), "total_questions"), "run_id")
    kept = cells.where("question_benchmark = plan AND position < total_questions")
    return kept.select("run_id", "position", outcome(F.col("error_type"), F.col("score")).alias("outcome"), "score", "latency_ms", "input_tokens", "output_tokens", "estimated_cost", "error_type")


def progress_totals(index: DataFrame) -> DataFrame:
    """(run_id, passed, wrong, error, pending) from rows with metrics; wrong is what neither passed nor failed, 0 at least."""
    wrong = F.greatest(F.lit(0).cast("long"), F.col("completed_questions") - F.col("correct_questions") - F.col("error_questions"))
    pending = F.greatest(F.lit(0).cast("long"), F.col("total_questions") - F.col("completed_questions"))
    return index.select("run_id", F.col("correct_questions").alias("passed"), wrong.alias("wrong"), F.col("error_questions").alias("error"), pending.alias("pending"))


def plan_violations(runs: DataFrame, responses: DataFrame, questions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, code, n): responses without a question, of another benchmark or outside the plan; over-full blocks and runs."""
    all_of = responses.select("run_id", "question_id").join(questions.select("question_id", F.col("benchmark_id").alias("b"), "position"), "question_id", "left")
    all_of = all_of.join(runs.select("run_id", "benchmark_id", "total_questions"), "run_id")
    code = F.when(F.col("position").isNull(), "response_mapping_missing").when((F.col("b") != F.col("benchmark_id")) | (F.col("position") < 0) | (F.col("position") >= F.col("total_questions")), "response_outside_plan")
    rows = all_of.select("run_id", code.alias("code")).where("code IS NOT NULL").groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n"))
    room = F.expr(f"least((block_index + 1) * {block}, total_questions) - block_index * {block}")
    per_block = all_of.where("position IS NOT NULL").groupBy("run_id", "total_questions", F.expr(f"position div {block}").alias("block_index")).agg(F.count(F.lit(1)).alias("n"))
    full = per_block.where(F.col("n") > room).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", F.lit("block_over_full").alias("code"), "n")
    per_run = all_of.groupBy("run_id", "total_questions").agg(F.count(F.lit(1)).alias("n")).where("n > total_questions").select("run_id", F.lit("more_responses_than_planned").alias("code"), "n")
    return rows.unionByName(full).unionByName(per_run)


def group_value(value: Column | None, kind: str = "string") -> Column:
    """A metadata value as the name of a group: true and false for booleans, trimmed text for other scalars; `__ungrouped__` for
    blank and nested values (`kind` is the column's type); `all` where there is no dimension to group by."""
    if value is None:
        return F.lit("all")
    if kind.startswith(("struct", "array", "map", "binary")):
        return F.lit(UNGROUPED)
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(UNGROUPED))


def metadata_group(metadata: Column, field: str) -> Column:
    """group_value of a field of JSON metadata: objects, arrays and null are no groups."""
    value = F.get_json_object(metadata, f"$.{field}")
    return F.when(F.trim(value).rlike(r"^[\[{]"), F.lit(UNGROUPED)).otherwise(group_value(value))


def choose_group_field(questions: DataFrame, fields: list[str]) -> DataFrame:
    """(benchmark_id, field): the field with the most non-blank values; of equals the first of `fields`; null without any."""
    rank = [F.struct(F.count_if(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "").alias("n"), F.lit(-k).alias("k"), F.lit(f).alias("field")) for k, f in enumerate(fields)]
    best = questions.groupBy("benchmark_id").agg(F.array_max(F.array(*rank)).alias("best"))
    return best.select("benchmark_id", F.when(F.col("best.n") > 0, F.col("best.field")).alias("field"))


def report_groups(runs: DataFrame, responses: DataFrame, questions: DataFrame, field: str) -> DataFrame:
    """Per run and group: planned questions, responses, correct, errors, score, completion and accuracy. Groups cover the whole plan."""
    named = questions.select("question_id", "benchmark_id", group_value(F.col(field)).alias("group_value"))
    planned = named.groupBy("benchmark_id", "group_value").agg(F.count(F.lit(1)).alias("planned"))
    plan = runs.select("run_id", "benchmark_id").join(planned, "benchmark_id").drop("benchmark_id")
    found = sums(responses.join(named.drop("benchmark_id"), "question_id"), "run_id", "group_value")
    rows = metrics(plan.join(found, ["run_id", "group_value"], "left"), "planned")
    return rows.select("run_id", "group_value", "planned", F.col("completed_questions").alias("responses"), "correct_questions", "error_questions", "score", "completion_rate", "answered_accuracy")


#: What a report says of where its run came from, as far as the runs have it.
PROVENANCE = ("protocol", "benchmark_id", "benchmark_version", "dataset_hash", "prompt_template", "evaluator", "model_id")


def report_summary(runs: DataFrame, responses: DataFrame, questions: DataFrame, field: str) -> DataFrame:
    """The groups' sums and, with a null group, their run's, by one grouping of additive parts; with the run's provenance. A run without a response has a row of zeros."""
    named = questions.select("question_id", group_value(F.col(field)).alias("group_value"))
    parts = sums(responses.join(named, "question_id"), "run_id", "group_value")
    both = parts.rollup("run_id", "group_value").agg(F.grouping("run_id").alias("g"), F.sum("responses").alias("responses"), F.bround(F.sum("score_sum"), 0).cast("long").alias("correct"), F.sum("errors").alias("errors"))
    told = runs.select("run_id", *(c for c in PROVENANCE if c in runs.columns))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.join(both.where("g = 0"), "run_id", "left").select("run_id", "group_value", *map(zero, ("responses", "correct", "errors")), *told.columns[1:])


def usage_coverage(responses: DataFrame) -> DataFrame:
    """Known sums and how many responses reported, for each run."""
    keep = ["responses", "known_input_tokens", "input_token_reports", "known_output_tokens", "output_token_reports", "known_cost", "cost_reports"]
    return sums(responses, "run_id").select("run_id", *keep)


def leaderboard(runs: DataFrame, evidence: DataFrame, models: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Completed runs, ranked inside (protocol, benchmark, version, hash) by score, then latency, then the newest, then id."""
    done = runs.where("status = 'completed'").join(evidence.select("run_id", "score", "completion_rate", "answered_accuracy", "average_latency_ms"), "run_id")
    named = done.join(models.select("model_id", F.col("name").alias("model_name")), "model_id").join(benchmarks.select(F.col("benchmark_id").alias("b"), "slug"), F.col("benchmark_id") == F.col("b"))
    order = [F.desc_nulls_last("score"), F.asc_nulls_last("average_latency_ms"), F.desc_nulls_last("finished_at"), F.asc("run_id")]
    rank = F.row_number().over(Window.partitionBy("protocol", "benchmark_id", "benchmark_version", "dataset_hash").orderBy(*order))
    return named.select("protocol", "slug", "benchmark_version", "dataset_hash", rank.cast("long").alias("rank"), "run_id", "model_name", "score", "completion_rate", "answered_accuracy", "average_latency_ms")


#: The orders of a leaderboard's page; runs that tie stand newest first, then by id.
ORDERS = {"score_desc": ("score", False), "score_asc": ("score", True), "latency_asc": ("average_latency_ms", True), "newest": ("finished_at", False)}


def leaderboard_page(runs: DataFrame, evidence: DataFrame, models: DataFrame, benchmarks: DataFrame, protocol: str, order: str = "score_desc", model_id: int | None = None, benchmark_id: int | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of one protocol's completed runs in one of ORDERS, with their rank inside (benchmark, version, hash) and the total of all that match.

    What is unknown stands last.
    """
    column, rising = ORDERS[order]
    rows = runs.where((F.col("protocol") == protocol) & (F.col("status") == "completed"))
    ranked = leaderboard(rows, evidence, models, benchmarks).join(rows.select("run_id", "model_id", "benchmark_id", "finished_at"), "run_id")
    by = F.asc_nulls_last(column) if rising else F.desc_nulls_last(column)
    return page(ranked, {"model_id": model_id, "benchmark_id": benchmark_id}, [by, F.desc_nulls_last("finished_at"), F.asc("run_id")], offset, limit)


#: What two runs must have in common to be compared.
SETTINGS = ("protocol", "benchmark_id", "benchmark_version", "dataset_hash", "total_questions", "prompt_template", "evaluator", "temperature_setting", "max_tokens", "concurrency", "max_attempts")


def comparable_runs(runs: DataFrame, settings: tuple[str, ...] = SETTINGS) -> DataFrame:
    """(run_id, comparison_key, peers): runs with the same protocol, data, prompt, evaluator, generation and execution settings may be compared."""
    keyed = runs.select("run_id", F.sha2(F.to_json(F.struct(*settings), {"ignoreNullFields": "false"}), 256).alias("comparison_key"))
    peers = keyed.groupBy("comparison_key").agg(F.count(F.lit(1)).alias("peers"))
    return keyed.join(peers, "comparison_key").select("run_id", "comparison_key", "peers")


def dashboard_summary(runs: DataFrame, evidence: DataFrame, models: DataFrame, benchmarks: DataFrame, protocol: str) -> DataFrame:
    """One row: how many models, benchmarks and runs there are; of the protocol's runs those completed and failed, means over
    the completed, and totals that are 0 without one and null unless every one has reported."""
    rows = runs.select("run_id", "status", (F.col("protocol") == protocol).alias("mine")).join(evidence, "run_id", "left")
    done = F.col("mine") & (F.col("status") == "completed")
    value = lambda c: F.when(done, F.col(c))
    total = lambda c: F.when(F.count(value(c)) == F.count_if(done), F.coalesce(F.sum(value(c)), F.lit(0)))
    mean = lambda c: F.sum(value(c).cast("decimal(30,10)")).cast("double") / F.nullif(F.count(value(c)), F.lit(0))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = rows.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(done).alias("completed"), F.count_if(F.col("mine") & (F.col("status") == "failed")).alias("failed"),
        mean("score").alias("average_score"), mean("average_latency_ms").alias("average_latency_ms"),
        total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("estimated_cost").alias("estimated_cost"),
    )
    return n(models, "models").crossJoin(n(benchmarks, "benchmarks")).crossJoin(out)  # one row each


def newest_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    return runs.where("status = 'completed'").orderBy(F.desc_nulls_last("finished_at"), "run_id").limit(k)


#: Shares into which the questions are dealt by a hash, so that a task gets a part of them for all runs.
SHARES = 64


def pending_questions(runs: DataFrame, responses: DataFrame, questions: DataFrame, shares: int = SHARES) -> DataFrame:
    """(run_id, question_id, position): planned questions without a response, of runs that have not ended.

    There may be as many as open runs times questions, so no shuffle has them. A row for each open run and share, with the
    share's questions that the run has answered, meets that share's questions, and pending ones go straight out of the join.
    """
    kind = questions.schema["question_id"].dataType
    share = F.pmod(F.xxhash64("question_id"), F.lit(shares)).cast("int").alias("share")
    open_runs = runs.where("status NOT IN ('completed', 'failed', 'cancelled')").select("run_id", "benchmark_id")
    given = responses.select("run_id", F.col("question_id").cast(kind).alias("question_id")).join(open_runs, "run_id").select("run_id", "benchmark_id", share, "question_id")
    each = open_runs.select("run_id", "benchmark_id", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(None).cast(kind).alias("question_id"))
    # a number of its own: what comes out is far more than what goes in, so tasks must not be joined by their input's size
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = each.unionByName(given).repartition(n, "benchmark_id", "share").groupBy("benchmark_id", "share", "run_id").agg(F.collect_set("question_id").alias("answered"))
    asked = questions.select("benchmark_id", share, "question_id", "position").hint("shuffle_hash")
    missing = ~F.coalesce(F.array_contains("answered", F.col("question_id")), F.lit(False))
    return rows.join(asked, ["benchmark_id", "share"]).where(missing).select("run_id", "question_id", "position")


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, block_index, before, after) where two progress indexes differ; a missing block counts as null."""
    a, b = (x.select("run_id", "block_index", F.col("responses").alias(n)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, ["run_id", "block_index"], "full_outer").where(~F.equal_null("before", "after"))


def metric_differences(stored: DataFrame, computed: DataFrame, fields: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(run_id, fields): names of stored metrics that differ from those computed, by more than a relative tolerance."""
    a, b = stored.select("run_id", *(F.col(f).alias(f"s_{f}") for f in fields)), computed.select("run_id", *(F.col(f).alias(f"c_{f}") for f in fields))
    s, c = (lambda f: F.col(f"s_{f}").cast("double")), (lambda f: F.col(f"c_{f}").cast("double"))
    close = lambda f: F.coalesce(F.abs(s(f) - c(f)) <= tolerance * F.greatest(F.abs(s(f)), F.abs(c(f))), s(f).isNull() & c(f).isNull())
    names = F.array_compact(F.array(*(F.when(~close(f), F.lit(f)) for f in fields)))
    return a.join(b, "run_id").select("run_id", F.array_join(names, ",").alias("fields")).where("fields <> ''")


def page(rows: DataFrame, filters: dict[str, object], order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the rows that match all filters (a null one is none), in the order given, each with the total of all that match."""
    if not 0 < limit <= 100 or offset < 0:
        raise ValueError("limit must be between 1 and 100 and offset not negative")
    for column, wanted in filters.items():
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total)


def list_runs(runs: DataFrame, status: str | None = None, model_id: int | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Newest first."""
    columns = runs.select("run_id", "status", "model_id", "benchmark_id", "started_at")
    return page(columns, {"status": status, "model_id": model_id}, [F.desc_nulls_last("started_at"), F.asc("run_id")], offset, limit).drop("started_at")


def list_questions(questions: DataFrame, benchmark_id: int, category: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    return page(questions.select("question_id", "benchmark_id", "position", "category"), {"benchmark_id": benchmark_id, "category": category}, [F.asc("position")], offset, limit)


def display(snapshot: Column, path: str, current: Column) -> Column:
    """What a run's snapshot says, else the dimension's value of today."""
    return F.coalesce(F.nullif(F.get_json_object(snapshot, path), F.lit("")), current)


def run_responses_page(run_id: int, responses: DataFrame, questions: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """Responses of one run in the order of the questions, with the usage coverage of the whole run."""
    mine = responses.where(F.col("run_id") == run_id)
    page = placed(mine, questions).orderBy("position", "created_at", "response_id").offset(offset).limit(limit)
    return page.select("run_id", "question_id", "position", "response_id", "score", "error_type").join(usage_coverage(mine), "run_id")


def estimate_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column, *, ceiling: bool = False) -> Column:
    """Cost in DECIMAL(20,8) from prices for a million tokens; null if any part is. Rounded half up, or up, only at the end.

    A millionth of the exact sum is counted in quanta of 8 places, which is the sum times 100, so no product loses digits.
    """
    part = lambda n, p: n.cast("decimal(12,0)") * p.cast("decimal(20,8)")
    quanta = (part(input_tokens, input_price) + part(output_tokens, output_price)) * F.lit(100).cast("decimal(3,0)")
    whole = (F.ceil(quanta) if ceiling else F.round(quanta, 0)).cast("decimal(20,0)")
    return (whole * F.lit("0.00000001").cast("decimal(8,8)")).cast("decimal(20,8)")


def effective(requested: Column, field: str, model_default: Column, protocol_default: Column) -> Column:
    """The requested value if the map has the field (a null there stands), else the model's default, else the protocol's."""
    return F.when(F.map_contains_key(requested, field), requested[field]).otherwise(F.coalesce(model_default, protocol_default))


def render_messages(template: Column, prompt: Column, choices: Column, system: Column) -> Column:
    """The messages of a request: {prompt} and {choices} filled in, the choices by their letters; a blank system part is left out."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")
    user = F.trim(F.replace(F.replace(template, F.lit("{prompt}"), prompt), F.lit("{choices}"), F.coalesce(lines, F.lit(""))))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when(F.trim(F.coalesce(system, F.lit(""))) == "", F.array(message("user", user))).otherwise(F.array(message("system", F.trim(system)), message("user", user)))


def freeze_run_snapshot(runs: DataFrame, models: DataFrame, benchmarks: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """Runs with what they ran on as it was then: one JSON each of the model, the benchmark and the prompt (prompt_template, ...)."""
    as_json = lambda df, key, name: df.select(F.col(key), F.to_json(F.struct(*(F.col(c) for c in df.columns if c != key))).alias(name))
    frozen = runs.join(as_json(models, "model_id", "model_snapshot"), "model_id", "left").join(as_json(benchmarks, "benchmark_id", "benchmark_snapshot"), "benchmark_id", "left")
    if prompts is not None:
        frozen = frozen.join(as_json(prompts, "prompt_template", "prompt_snapshot"), "prompt_template", "left")
    return frozen
