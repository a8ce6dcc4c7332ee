"""The evaluation tables, derived from the order and event tables at hand.

Each view is SQL that Spark and other engines read alike; names in braces are the tables it is made from.
The operators take DataFrames and know nothing of the tables below.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "questions": """
SELECT p_partkey AS question_id, p_size % 4 AS benchmark_id, CAST(row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) - 1 AS BIGINT) AS position,
       p_type AS category, p_brand AS domain, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS topic, chr(65 + p_size % 4) AS reference
FROM {part}""",
    "benchmarks": """
SELECT benchmark_id, concat('bench-', CAST(benchmark_id AS STRING)) AS slug, 'v1' AS version, count(*) AS question_count
FROM {questions} GROUP BY benchmark_id""",
    "models": """
SELECT s_suppkey AS model_id, s_name AS name, CAST(s_suppkey % 7 + 1 AS DECIMAL(20,8)) AS input_price, CAST(s_suppkey % 11 + 2 AS DECIMAL(20,8)) AS output_price
FROM {supplier}""",
    "responses": """
SELECT l_suppkey * 4 + p_size % 4 AS run_id, l_partkey AS question_id, l_orderkey * 10 + l_linenumber AS response_id,
       CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN '' ELSE concat('The answer is ', chr(65 + l_linenumber % 4)) END AS raw_response,
       CASE WHEN l_linenumber = 7 THEN 'adapter_timeout' WHEN l_linenumber = 6 THEN 'empty_response' END AS error_type,
       CAST(CASE WHEN l_linenumber <= 5 AND l_linenumber % 4 = p_size % 4 THEN 1 ELSE 0 END AS DOUBLE) AS score, l_quantity AS latency_ms,
       CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE CAST(l_quantity AS BIGINT) * 10 END AS input_tokens,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_partkey % 50 END AS output_tokens,
       CAST(CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_linenumber END AS DECIMAL(20,8)) AS estimated_cost, CAST(l_shipdate AS TIMESTAMP) AS created_at
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "runs": """
SELECT r.*, b.question_count AS total_questions, CASE WHEN r.run_id % 7 = 0 THEN 'protocol-v0' ELSE 'protocol-v1' END AS protocol, 'v1' AS benchmark_version,
       CASE WHEN r.run_id % 2 = 0 THEN 'direct' ELSE 'five-shot' END AS prompt_template, 'multiple_choice_v1' AS evaluator, 512 + r.run_id % 2 * 512 AS max_tokens, r.run_id % 3 + 1 AS concurrency, 3 AS max_attempts, concat('hash-', CAST(r.benchmark_id AS STRING)) AS dataset_hash,
       CASE r.run_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status, r.run_id % 3 AS temperature_setting,
       CASE WHEN r.run_id % 2 = 0 THEN 100 END AS input_token_reservation
FROM (SELECT run_id, run_id % 4 AS benchmark_id, CAST((run_id - run_id % 4) / 4 AS BIGINT) AS model_id, min(created_at) AS started_at, max(created_at) AS finished_at
      FROM {responses} GROUP BY run_id) r JOIN {benchmarks} b ON r.benchmark_id = b.benchmark_id""",
    "ledger": """
SELECT l_orderkey * 10 + l_linenumber AS operation_id, l_suppkey * 4 + l_partkey % 4 AS run_id, l_suppkey AS model_id, 'policy-1' AS policy_id,
       CASE l_linenumber WHEN 1 THEN 'reserved' WHEN 2 THEN 'send_started' WHEN 6 THEN 'settled_conservative' WHEN 7 THEN 'released' ELSE 'settled_actual' END AS state,
       'global' AS global_scope_id, concat('p', CAST(l_suppkey % 3 AS STRING)) AS provider_scope_id, concat('m', CAST(l_suppkey AS STRING)) AS model_scope_id,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE concat('r', CAST(l_suppkey * 4 + l_partkey % 4 AS STRING)) END AS run_scope_id,
       CAST(l_quantity AS BIGINT) AS reserved_input_tokens, CAST(l_linenumber * 10 AS BIGINT) AS reserved_output_tokens, CAST(l_linenumber AS DECIMAL(20,8)) AS reserved_cost_usd,
       CASE WHEN l_linenumber BETWEEN 3 AND 6 THEN CAST(l_quantity AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT) - 5 END AS actual_input_tokens,
       CASE WHEN l_linenumber BETWEEN 3 AND 6 THEN CAST(l_linenumber * 10 AS BIGINT) - l_orderkey % 3 END AS actual_output_tokens,
       CAST(CASE WHEN l_linenumber BETWEEN 3 AND 6 THEN l_linenumber - l_orderkey % 2 END AS DECIMAL(20,8)) AS actual_cost_usd,
       CAST(l_shipdate AS TIMESTAMP) AS window_start, l_partkey % 5 AS lease_token, CAST(l_partkey AS BIGINT) AS question_id
FROM {lineitem}""",
    "audit_events": """
SELECT event_id, concat(CAST(user_id AS STRING), ':', event_type, ':', CAST(event_id % 700 AS STRING)) AS event_key,
       CASE event_type WHEN 'signup' THEN 'run_admitted' WHEN 'click' THEN 'run_claimed' WHEN 'view' THEN 'run_yielded' WHEN 'purchase' THEN 'run_terminal' ELSE 'run_dead_lettered' END AS event_type,
       CAST(ts AS TIMESTAMP) AS occurred_at, CAST(ts AS TIMESTAMP) + INTERVAL '90' DAY AS expires_at, user_id AS run_id, event_id % 4 AS worker_id,
       CASE WHEN event_id % 5 = 0 THEN 'security' ELSE 'operational' END AS retention_class, CAST(floor(value) AS BIGINT) AS attempt
FROM {events}""",
    "tasks": """
SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_custkey % 50 AS model_id,
       CAST(o_orderdate AS TIMESTAMP) AS created_at,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 7) * INTERVAL '1' HOUR END AS started_at,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 7) * INTERVAL '1' HOUR + (o_custkey % 13) * INTERVAL '1' MINUTE END AS finished_at,
       CAST(o_orderkey % 4 AS INT) AS failures, o_orderkey % 17 = 0 AS cancel_requested, CAST(o_custkey % 20 AS BIGINT) AS planned, CAST(o_orderkey % 23 AS BIGINT) AS responded,
       CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS TIMESTAMP) + (o_custkey % 100) * INTERVAL '1' DAY END AS lease_expires_at, o_orderpriority AS phase,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + (o_custkey % 40) * INTERVAL '1' DAY END AS next_attempt_at,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + (o_custkey % 90) * INTERVAL '1' DAY END AS not_before,
       CASE o_orderkey % 6 WHEN 0 THEN 'unmanaged' WHEN 1 THEN 'delayed' WHEN 2 THEN 'exhausted' ELSE 'active' END AS budget_status, CAST(o_orderkey % 4 + 1 AS INT) AS attempts, CAST(o_orderkey % 5 AS INT) AS dispatches,
       CASE WHEN o_orderkey % 4 = 3 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY END AS dead_lettered_at, CASE WHEN o_orderkey % 19 = 0 THEN 'queue_unavailable' END AS last_error
FROM {orders}""",
    "workers": """
SELECT user_id AS worker_id, min(CAST(ts AS TIMESTAMP)) AS started_at, max(CAST(ts AS TIMESTAMP)) AS last_seen_at,
       max(CASE WHEN event_type = 'click' THEN CAST(ts AS TIMESTAMP) END) AS last_claim_at, max(CASE WHEN event_type = 'purchase' THEN CAST(ts AS TIMESTAMP) END) AS last_progress_at,
       CASE WHEN user_id % 5 = 0 THEN max(CAST(ts AS TIMESTAMP)) END AS stopped_at
FROM {events} GROUP BY user_id""",
    "trials": """
SELECT event_type AS cell, CAST(CAST(ts AS DATE) AS STRING) AS trial, CAST(count(*) AS DOUBLE) AS sample, count(CASE WHEN value < 1 THEN 1 END) AS errors
FROM {events} GROUP BY event_type, CAST(ts AS DATE)""",
}


def parts_of(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view by its name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{p: view(spark, sf_dir, p) for p in parts_of(VIEWS[name])})


def with_views(sql: str) -> str:
    """For another engine: `sql` after WITH clauses for the views that it names in braces, and those that they name."""
    found: dict[str, str] = {}

    def add(text: str) -> None:
        for p in parts_of(text):
            if p in VIEWS and p not in found:
                add(VIEWS[p])
                found[p] = VIEWS[p]

    add(sql)
    flat = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    ctes = ",\n".join(f"{name} AS ({flat(text)})" for name, text in found.items())
    body = flat(sql).strip()
    if not ctes:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
