"""Queries of run evidence, reports and leaderboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as ev
from .registry import query

FIRST = """
firsts AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, question_id ORDER BY created_at NULLS FIRST, response_id NULLS FIRST, raw_response NULLS FIRST, error_type NULLS FIRST,
      score NULLS FIRST, latency_ms NULLS FIRST, input_tokens NULLS FIRST, output_tokens NULLS FIRST, estimated_cost NULLS FIRST) AS k FROM {responses}) WHERE k = 1)"""
OUTPUT = "raw_response IS NOT NULL AND raw_response <> ''"


def sums_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS responses, sum(score) AS score_sum, count(*) FILTER ({OUTPUT}) AS outputs, count(*) FILTER (error_type IS NULL AND {OUTPUT}) AS evaluable,
  count(error_type) AS errors, sum(latency_ms) AS latency_sum, count(latency_ms) AS latency_reports, sum(input_tokens) AS in_sum, count(input_tokens) AS in_n,
  sum(output_tokens) AS out_sum, count(output_tokens) AS out_n, sum(estimated_cost) AS cost_sum, count(estimated_cost) AS cost_n FROM {source} GROUP BY {keys}"""


def metrics_sql(planned: str = "r.total_questions") -> str:
    return f"""coalesce(s.responses, 0) AS completed_questions, CAST(coalesce(round_even(s.score_sum, 0), 0) AS BIGINT) AS correct_questions, coalesce(s.errors, 0) AS error_questions,
  coalesce(s.score_sum, 0) / {planned} * 100 AS score, coalesce(s.outputs, 0)::DOUBLE / {planned} * 100 AS completion_rate,
  CASE WHEN s.evaluable > 0 THEN round_even(s.score_sum, 0) / s.evaluable * 100 END AS answered_accuracy, CASE WHEN s.latency_reports > 0 THEN s.latency_sum / s.latency_reports END AS average_latency_ms,
  CAST(CASE WHEN s.in_n = s.responses THEN s.in_sum END AS BIGINT) AS input_tokens, CAST(CASE WHEN s.out_n = s.responses THEN s.out_sum END AS BIGINT) AS output_tokens,
  CAST(CASE WHEN s.cost_n = s.responses THEN s.cost_sum END AS DOUBLE) AS estimated_cost"""


EVIDENCE = f"""{FIRST},
s AS ({sums_sql("firsts", "run_id")}),
evidence AS (SELECT r.run_id, r.total_questions, {metrics_sql()} FROM {{runs}} r LEFT JOIN s ON r.run_id = s.run_id)"""
ROUND = ["score", "completion_rate", "answered_accuracy", "average_latency_ms"]


def rounded(df, columns=ROUND):
    """Ratios to 6 places and money as DOUBLE, for comparisons by value."""
    out = df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})
    return out.withColumns({c: F.col(c).cast("double") for c, kind in out.dtypes if kind.startswith("decimal")})


def rounded_sql(names: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in ROUND else c for c in names.replace(",", " ").split())


def firsts(t):
    """Without the answers' text: metrics ask only whether there is one, so its first character goes through the shuffle."""
    return ev.first_response_wins(t.responses.withColumn("raw_response", F.substring("raw_response", 1, 1)))


def evidence_of(t):
    return ev.run_evidence(t.runs, firsts(t))


NAMES = "completed_questions correct_questions error_questions score completion_rate answered_accuracy average_latency_ms input_tokens output_tokens estimated_cost"


@query(f"WITH {EVIDENCE} SELECT run_id, total_questions, {rounded_sql(NAMES)} FROM evidence")
def run_evidence(t):
    return rounded(evidence_of(t))


@query(f"WITH {FIRST} SELECT run_id, question_id, response_id, raw_response, error_type, score, latency_ms, input_tokens, output_tokens FROM firsts")
def first_response_wins(t):
    return ev.first_response_wins(t.responses).select("run_id", "question_id", "response_id", "raw_response", "error_type", "score", "latency_ms", "input_tokens", "output_tokens")


@query("SELECT run_id, question_id, CAST(1 AS BIGINT) AS stored, count(*) - 1 AS already_present FROM {responses} GROUP BY run_id, question_id")
def response_dispositions(t):
    return ev.response_dispositions(t.responses)


@query(f"""WITH {EVIDENCE} SELECT r.protocol, b.slug, r.benchmark_version, r.dataset_hash,
  row_number() OVER (PARTITION BY r.protocol, r.benchmark_id ORDER BY score DESC, average_latency_ms ASC NULLS LAST, finished_at DESC NULLS LAST, r.run_id) AS rank,
  r.run_id, m.name AS model_name, round(score, 6) AS score, round(completion_rate, 6) AS completion_rate, round(answered_accuracy, 6) AS answered_accuracy, round(average_latency_ms, 6) AS average_latency_ms
FROM {{runs}} r JOIN evidence e ON r.run_id = e.run_id JOIN {{models}} m ON r.model_id = m.model_id JOIN {{benchmarks}} b ON r.benchmark_id = b.benchmark_id WHERE status = 'completed'""")
def leaderboard(t):
    return rounded(ev.leaderboard(t.runs, evidence_of(t), t.models, t.benchmarks))


@query(f"""WITH {FIRST}, s AS ({sums_sql("(SELECT f.*, q.position // 512 AS block_index FROM firsts f JOIN {questions} q ON f.question_id = q.question_id)", "run_id, block_index")}),
plan AS (SELECT run_id, unnest(range(0, (total_questions - 1) // 512 + 1)) AS block_index FROM {{runs}})
SELECT p.run_id, p.block_index, coalesce(responses, 0) AS responses, coalesce(score_sum, 0) AS score_sum, coalesce(outputs, 0) AS completed_outputs, coalesce(errors, 0) AS errors,
  CAST(coalesce(in_sum, 0) AS BIGINT) AS known_input_tokens, coalesce(in_n, 0) AS input_token_reports FROM plan p LEFT JOIN s ON p.run_id = s.run_id AND p.block_index = s.block_index""")
def progress_blocks(t):
    return ev.progress_blocks(t.runs, firsts(t), t.questions).select("run_id", "block_index", "responses", "score_sum", "completed_outputs", "errors", "known_input_tokens", "input_token_reports")


@query(f"""WITH {EVIDENCE}, b AS (SELECT f.run_id, q.position // 64 AS k, count(*) AS n FROM firsts f JOIN {{questions}} q ON f.question_id = q.question_id GROUP BY ALL),
p AS (SELECT run_id, unnest(range(0, (total_questions - 1) // 64 + 1)) AS k FROM {{runs}}),
c AS (SELECT p.run_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY p.k) AS block_counts FROM p LEFT JOIN b ON p.run_id = b.run_id AND p.k = b.k GROUP BY p.run_id)
SELECT e.run_id, {rounded_sql(NAMES)}, block_counts FROM evidence e JOIN c ON e.run_id = c.run_id""")
def progress_index(t):
    return rounded(ev.progress_index(t.runs, firsts(t), t.questions, block=64)).withColumn("block_counts", F.array_join(F.col("block_counts").cast("array<string>"), ","))


@query(f"""WITH {FIRST} SELECT f.run_id, q.position, CASE WHEN error_type IS NOT NULL THEN 'error' WHEN score = 1 THEN 'passed' ELSE 'wrong' END AS outcome, score, latency_ms,
  input_tokens, output_tokens, CAST(estimated_cost AS DOUBLE) AS estimated_cost, error_type
FROM firsts f JOIN {{questions}} q ON f.question_id = q.question_id JOIN {{runs}} r ON f.run_id = r.run_id WHERE q.benchmark_id = r.benchmark_id AND position < total_questions""")
def progress_cells(t):
    return rounded(ev.progress_cells(t.runs, firsts(t), t.questions), [])


@query(f"""WITH {EVIDENCE} SELECT run_id, correct_questions AS passed, greatest(0, completed_questions - correct_questions - error_questions) AS wrong, error_questions AS error,
  greatest(0, total_questions - completed_questions) AS pending FROM evidence""")
def progress_totals(t):
    return ev.progress_totals(evidence_of(t))


@query("""WITH a AS (SELECT r.run_id, q.position, q.benchmark_id AS b, u.benchmark_id, u.total_questions FROM {responses} r JOIN {runs} u ON r.run_id = u.run_id LEFT JOIN {questions} q ON r.question_id = q.question_id)
SELECT run_id, 'response_outside_plan' AS code, count(*) AS n FROM a WHERE b <> benchmark_id OR position >= total_questions GROUP BY run_id
UNION ALL SELECT run_id, 'response_mapping_missing', count(*) FROM a WHERE position IS NULL GROUP BY run_id
UNION ALL SELECT run_id, 'block_over_full', count(*) FROM (SELECT run_id, position // 8 AS k, count(*) AS c, any_value(total_questions) AS t FROM a WHERE position IS NOT NULL GROUP BY ALL) WHERE c > least(k * 8 + 8, t) - k * 8 GROUP BY run_id
UNION ALL SELECT run_id, 'more_responses_than_planned', count(*) FROM a GROUP BY run_id HAVING count(*) > any_value(total_questions)""")
def plan_violations(t):
    return ev.plan_violations(t.runs, t.responses, t.questions, block=8)


@query("""SELECT benchmark_id, CASE WHEN c >= d AND c >= p AND c > 0 THEN 'topic' WHEN d >= p AND d > 0 THEN 'category' WHEN p > 0 THEN 'domain' END AS field FROM (
  SELECT benchmark_id, count(*) FILTER (trim(topic) <> '') AS c, count(*) FILTER (trim(category) <> '') AS d, count(*) FILTER (trim(domain) <> '') AS p FROM {questions} GROUP BY benchmark_id)""")
def choose_group_field(t):
    return ev.choose_group_field(t.questions, ["topic", "category", "domain"])


@query(f"""WITH {FIRST}, q AS (SELECT question_id, benchmark_id, coalesce(nullif(trim(category), ''), '__ungrouped__') AS group_value FROM {{questions}}),
p AS (SELECT benchmark_id, group_value, count(*) AS planned FROM q GROUP BY ALL), s AS ({sums_sql("(SELECT f.*, group_value FROM firsts f JOIN q ON f.question_id = q.question_id)", "run_id, group_value")})
SELECT run_id, group_value, planned, coalesce(responses, 0) AS responses, correct_questions, error_questions, {rounded_sql("score completion_rate answered_accuracy")}
FROM (SELECT r.run_id, p.group_value, planned, s.responses, {metrics_sql("planned")} FROM {{runs}} r JOIN p ON r.benchmark_id = p.benchmark_id LEFT JOIN s ON r.run_id = s.run_id AND p.group_value = s.group_value)""")
def report_groups(t):
    return rounded(ev.report_groups(t.runs, firsts(t), t.questions, "category"))


@query(f"""WITH {FIRST}, q AS (SELECT question_id, coalesce(nullif(trim(topic), ''), '__ungrouped__') AS group_value FROM {{questions}}),
g AS (SELECT run_id, group_value, count(*) AS responses, CAST(round_even(sum(score), 0) AS BIGINT) AS correct, count(error_type) AS errors FROM firsts f JOIN q ON f.question_id = q.question_id GROUP BY GROUPING SETS ((run_id, group_value), (run_id)))
SELECT r.run_id, group_value, coalesce(responses, 0) AS responses, coalesce(correct, 0) AS correct, coalesce(errors, 0) AS errors, protocol, benchmark_id, benchmark_version, dataset_hash, prompt_template, evaluator, model_id FROM {{runs}} r LEFT JOIN g ON g.run_id = r.run_id""")
def report_summary(t):
    return ev.report_summary(t.runs, firsts(t), t.questions, "topic")


@query("""SELECT run_id, count(*) AS responses, CAST(sum(input_tokens) AS BIGINT) AS known_input_tokens, count(input_tokens) AS input_token_reports, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS known_output_tokens,
  count(output_tokens) AS output_token_reports, CAST(sum(estimated_cost) AS DOUBLE) AS known_cost, count(estimated_cost) AS cost_reports FROM {responses} GROUP BY run_id""")
def usage_coverage(t):
    return rounded(ev.usage_coverage(t.responses), [])


DONE = "status = 'completed' AND protocol = 'protocol-v1'"


@query(f"""WITH {EVIDENCE} SELECT (SELECT count(*) FROM {{models}}) AS models, (SELECT count(*) FROM {{benchmarks}}) AS benchmarks, count(*) AS runs, count(*) FILTER ({DONE}) AS completed, count(*) FILTER (status = 'failed' AND protocol = 'protocol-v1') AS failed,
  round(avg(score) FILTER ({DONE}), 6) AS average_score, round(avg(average_latency_ms) FILTER ({DONE}), 6) AS average_latency_ms,
  CAST(CASE WHEN count(input_tokens) FILTER ({DONE}) = count(*) FILTER ({DONE}) THEN coalesce(sum(input_tokens) FILTER ({DONE}), 0) END AS BIGINT) AS input_tokens,
  CAST(CASE WHEN count(output_tokens) FILTER ({DONE}) = count(*) FILTER ({DONE}) THEN coalesce(sum(output_tokens) FILTER ({DONE}), 0) END AS BIGINT) AS output_tokens,
  CAST(CASE WHEN count(estimated_cost) FILTER ({DONE}) = count(*) FILTER ({DONE}) THEN coalesce(sum(estimated_cost) FILTER ({DONE}), 0) END AS DOUBLE) AS estimated_cost
FROM {{runs}} r JOIN evidence e ON r.run_id = e.run_id""")
def dashboard_summary(t):
    return rounded(ev.dashboard_summary(t.runs, evidence_of(t), t.models, t.benchmarks, "protocol-v1"), ["average_score", "average_latency_ms"])


@query(f"""WITH {EVIDENCE} SELECT (SELECT count(*) FROM {{models}}) AS models, (SELECT count(*) FROM {{benchmarks}}) AS benchmarks, count(*) AS runs, CAST(0 AS BIGINT) AS completed, CAST(0 AS BIGINT) AS failed,
  CAST(0 AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, CAST(0 AS DOUBLE) AS estimated_cost FROM {{runs}} r JOIN evidence e ON r.run_id = e.run_id""")
def dashboard_without_runs(t):
    """Of a protocol that no run has: totals are 0, not unknown."""
    return rounded(ev.dashboard_summary(t.runs, evidence_of(t), t.models, t.benchmarks, "none such"), []).drop("average_score", "average_latency_ms")


PAGES = {"score_desc": "score DESC NULLS LAST", "score_asc": "score ASC NULLS LAST", "latency_asc": "average_latency_ms ASC NULLS LAST", "newest": "finished_at DESC NULLS LAST"}
PAGE = lambda name, by: f"(SELECT '{name}' AS page, run_id, rank, round(score, 6) AS score, (SELECT count(*) FROM ranked WHERE benchmark_id = 1) AS total FROM ranked WHERE benchmark_id = 1 ORDER BY {by}, finished_at DESC NULLS LAST, run_id LIMIT 20 OFFSET 3)"


@query(f"""WITH {EVIDENCE}, ranked AS (SELECT r.run_id, r.benchmark_id, finished_at, score, average_latency_ms,
  row_number() OVER (PARTITION BY r.benchmark_id ORDER BY score DESC NULLS LAST, average_latency_ms ASC NULLS LAST, finished_at DESC NULLS LAST, r.run_id) AS rank FROM {{runs}} r JOIN evidence e ON r.run_id = e.run_id WHERE {DONE})
{" UNION ALL ".join(PAGE(name, by) for name, by in PAGES.items())}""")
def leaderboard_page(t):
    """One page in each of the orders."""
    evidence = evidence_of(t)
    pages = [ev.leaderboard_page(t.runs, evidence, t.models, t.benchmarks, "protocol-v1", order, benchmark_id=1, offset=3).select(F.lit(order).alias("page"), "run_id", "rank", F.round("score", 6).alias("score"), "total") for order in PAGES]
    return reduce(DataFrame.unionByName, pages)


@query("SELECT run_id, model_id, benchmark_id FROM {runs} WHERE status = 'completed' ORDER BY finished_at DESC NULLS LAST, run_id LIMIT 5")
def newest_runs(t):
    return ev.newest_runs(t.runs).select("run_id", "model_id", "benchmark_id")


TEXTS = ("protocol", "benchmark_version", "dataset_hash", "prompt_template", "evaluator")
SETTINGS = " || ',' || ".join(f"""'"{c}":' || '"' || {c} || '"'""" if c in TEXTS else f"""'"{c}":' || {c}""" for c in ev.SETTINGS)


@query(f"""SELECT run_id, sha256('{{{{' || {SETTINGS} || '}}}}') AS comparison_key, count(*) OVER (PARTITION BY {", ".join(ev.SETTINGS)}) AS peers FROM {{runs}}""".replace("{{'", "{'").replace("}}'", "}'"))
def comparable_runs(t):
    return ev.comparable_runs(t.runs)


@query("""SELECT question_id, CASE WHEN question_id % 5 = 0 THEN 'true' WHEN question_id % 5 = 1 THEN '__ungrouped__' WHEN question_id % 5 = 2 THEN '__ungrouped__' WHEN question_id % 5 = 3 THEN CAST(position AS VARCHAR) ELSE category END AS by_field, 'all' AS without_field FROM {questions}""")
def group_value(t):
    """Metadata as JSON has it: a boolean, an object, a blank, a number, a text between spaces."""
    metadata = F.expr("""concat('{"g":', CASE question_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '{"x":1}' WHEN 2 THEN '"  "' WHEN 3 THEN CAST(position AS STRING) ELSE concat('" ', category, ' "') END, '}')""")
    return t.questions.select("question_id", ev.metadata_group(metadata, "g").alias("by_field"), ev.group_value(None).alias("without_field"))


@query("""SELECT r.run_id, q.question_id, q.position FROM {runs} r JOIN {questions} q ON r.benchmark_id = q.benchmark_id WHERE status = 'running'
AND NOT EXISTS (SELECT 1 FROM {responses} x WHERE x.run_id = r.run_id AND x.question_id = q.question_id)""")
def pending_questions(t):
    return ev.pending_questions(t.runs, t.responses, t.questions)


@query("""WITH b AS (SELECT run_id, position // 512 AS block_index, count(*) AS n, count(*) FILTER (response_id % 3 > 0) AS m FROM {responses} r JOIN {questions} q ON r.question_id = q.question_id GROUP BY ALL),
p AS (SELECT run_id, unnest(range(0, (total_questions - 1) // 512 + 1)) AS block_index FROM {runs})
SELECT p.run_id, p.block_index, coalesce(m, 0) AS before, coalesce(n, 0) AS after FROM p LEFT JOIN b ON p.run_id = b.run_id AND p.block_index = b.block_index WHERE coalesce(m, 0) <> coalesce(n, 0)""")
def changed_blocks(t):
    blocks = lambda r: ev.progress_blocks(t.runs, r, t.questions)
    return ev.changed_blocks(blocks(t.responses.where("response_id % 3 > 0")), blocks(t.responses))


@query(f"""WITH {EVIDENCE}, a AS (SELECT run_id, count(*) AS n, CAST(round_even(sum(score), 0) AS BIGINT) AS c, count(error_type) AS e FROM {{responses}} GROUP BY run_id)
SELECT e.run_id, array_to_string(list_filter([CASE WHEN n <> completed_questions THEN 'completed_questions' END, CASE WHEN c <> correct_questions THEN 'correct_questions' END, CASE WHEN a.e <> error_questions THEN 'error_questions' END], lambda x: x IS NOT NULL), ',') AS fields
FROM evidence e JOIN a ON e.run_id = a.run_id WHERE n <> completed_questions OR c <> correct_questions OR a.e <> error_questions""")
def metric_differences(t):
    return ev.metric_differences(ev.run_evidence(t.runs, t.responses), evidence_of(t), ["completed_questions", "correct_questions", "error_questions"])


@query("""SELECT run_id, status, model_id, benchmark_id, (SELECT count(*) FROM {runs} WHERE status = 'completed') AS total FROM {runs} WHERE status = 'completed' ORDER BY started_at DESC NULLS LAST, run_id LIMIT 20 OFFSET 10""")
def list_runs(t):
    return ev.list_runs(t.runs, status="completed", offset=10, limit=20)


@query("""SELECT run_id, question_id, position, response_id, score, error_type, u.* FROM (SELECT r.*, q.position FROM {responses} r JOIN {questions} q ON r.question_id = q.question_id WHERE run_id = 4 ORDER BY position, created_at, response_id LIMIT 50) x,
(SELECT count(*) AS responses, CAST(sum(input_tokens) AS BIGINT) AS known_input_tokens, count(input_tokens) AS input_token_reports, CAST(sum(output_tokens) AS BIGINT) AS known_output_tokens,
  count(output_tokens) AS output_token_reports, CAST(sum(estimated_cost) AS DOUBLE) AS known_cost, count(estimated_cost) AS cost_reports FROM {responses} WHERE run_id = 4) u""")
def run_responses_page(t):
    return rounded(ev.run_responses_page(4, t.responses, t.questions, limit=50), [])


@query("""SELECT r.response_id, r.run_id, r.question_id, CAST(input_tokens * 1000000 AS HUGEINT) * 0 + 0 AS zero, CAST((CAST(input_tokens AS DECIMAL(12,0)) * CAST(input_price AS DECIMAL(8,2)) + CAST(output_tokens AS DECIMAL(12,0)) * CAST(output_price AS DECIMAL(8,2))) AS DOUBLE) / 1000000 AS cost
FROM {responses} r JOIN {runs} u ON r.run_id = u.run_id JOIN {models} m ON u.model_id = m.model_id""".replace("CAST(input_tokens * 1000000 AS HUGEINT) * 0 + 0 AS zero, ", ""))
def estimate_cost(t):
    priced = t.responses.join(t.runs.select("run_id", "model_id"), "run_id").join(t.models, "model_id")
    cost = ev.estimate_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"), F.col("output_price"))
    return priced.select("response_id", "run_id", "question_id", cost.cast("double").alias("cost"))


@query("""SELECT question_id, 'Q: ' || category || E'\\nA. yes\\nB. no' AS content, 1 + CAST(topic <> '' AS INT) AS n_messages FROM {questions}""")
def render_messages(t):
    choices = F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes"))
    made = t.questions.withColumn("m", ev.render_messages(F.lit("Q: {prompt}\n{choices} "), F.col("category"), choices, F.col("topic")))
    return made.select("question_id", F.get(F.transform("m", lambda x: x["content"]), F.size("m") - 1).alias("content"), F.size("m").alias("n_messages"))


@query("""SELECT run_id, name AS model_name, slug, CAST(m.input_price AS DOUBLE) AS input_price, prompt_template || ': {{prompt}}' AS prompt FROM {runs} r LEFT JOIN {models} m ON r.model_id = m.model_id LEFT JOIN {benchmarks} b ON r.benchmark_id = b.benchmark_id""".replace("{{prompt}}", "' || chr(123) || 'prompt' || chr(125) || '"))
def freeze_run_snapshot(t):
    prompts = t.runs.select("prompt_template").distinct().withColumn("user", F.concat("prompt_template", F.lit(": {prompt}")))
    frozen = ev.freeze_run_snapshot(t.runs, t.models, t.benchmarks, prompts)
    return frozen.select("run_id", F.get_json_object("model_snapshot", "$.name").alias("model_name"), F.get_json_object("benchmark_snapshot", "$.slug").alias("slug"), F.get_json_object("model_snapshot", "$.input_price").cast("double").alias("input_price"), F.get_json_object("prompt_snapshot", "$.user").alias("prompt"))


@query("""SELECT question_id, benchmark_id, position, category, (SELECT count(*) FROM {questions} WHERE benchmark_id = 2) AS total FROM {questions} WHERE benchmark_id = 2 ORDER BY position LIMIT 30 OFFSET 5""")
def list_questions(t):
    return ev.list_questions(t.questions, 2, offset=5, limit=30)


@query("SELECT model_id, name, (SELECT count(*) FROM {models}) AS total FROM {models} ORDER BY name, model_id LIMIT 25")
def list_models(t):
    return ev.page(t.models.select("model_id", "name"), {}, [F.asc("name"), F.asc("model_id")], limit=25)


@query("SELECT slug, version, question_count, CAST(1 AS BIGINT) AS total FROM {benchmarks} WHERE slug = 'bench-3'")
def list_benchmarks(t):
    return ev.page(t.benchmarks.select("slug", "version", "question_count"), {"slug": "bench-3", "version": None}, [F.asc("slug")])


@query("SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'then-' || r.model_id ELSE name END AS model_name FROM {runs} r JOIN {models} m ON r.model_id = m.model_id")
def leaderboard_display(t):
    snapshot = F.expr("CASE run_id % 3 WHEN 0 THEN to_json(named_struct('name', concat('then-', model_id))) WHEN 1 THEN to_json(named_struct('name', '')) END")
    rows = t.runs.withColumn("snapshot", snapshot).join(t.models.select("model_id", "name"), "model_id")
    return rows.select("run_id", ev.display(F.col("snapshot"), "$.name", F.col("name")).alias("model_name"))
