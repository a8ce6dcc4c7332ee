"""Queries of file sources and sinks: tables are written to the scratch folder, read back and compared with what they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbering import scratch_path
from ..operators import audit as au
from ..operators import datasets as ds
from ..operators import evidence as ev
from ..operators import scoring
from ..sources import files
from . import audit, datasets
from .registry import query


@query(f"WITH {datasets.SOURCE} SELECT line AS question_id, question, array_to_string(options, '|') AS options, answer_index FROM src")
def read_mmlu_parquet(t):
    """A source with a column that is not asked for, and the number of rows that must be there."""
    path = scratch_path(t.spark)
    rows = datasets.source(t).withColumn("extra", F.lit(1))
    rows.write.parquet(path)
    back = ds.normalize_mmlu(files.read_mmlu_parquet(t.spark, path, t.part.count()))
    return back.select(F.col("question_id").cast("long"), "question", F.array_join("options", "|").alias("options"), "answer_index")


GPQA = {"Record ID": "p_partkey", "Question": "concat(p_name, ', \"', p_type, '\"\\n?')", "Correct Answer": "p_brand", "Incorrect Answer 1": "p_type", "Incorrect Answer 2": "if(p_partkey % 9 = 0, '  ', p_name)", "Incorrect Answer 3": "concat(p_name, '!')", "Subdomain": "p_type", "High-level domain": "p_brand", "Question Writer": "'someone'"}


@query("""SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_name || ', "' || p_type || '"' || chr(10) || '?' AS question, p_brand AS correct_answer, p_type || '|' || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END || '|' || p_name || '!' AS wrong,
  CASE WHEN p_partkey % 9 = 0 THEN 'empty_incorrect_answer_2' ELSE '' END AS issues FROM {part}""")
def normalize_gpqa(t):
    """Written as CSV with quotes and line ends inside, read back and normalised."""
    path = scratch_path(t.spark)
    t.part.select(*(F.expr(e).cast("string").alias(c) for c, e in GPQA.items())).write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = ds.normalize_gpqa(files.read_gpqa_csv(t.spark, path, t.part.count()))
    return rows.select("record_id", "question", "correct_answer", F.array_join("incorrect_answers", "|").alias("wrong"), F.array_join("issues", ",").alias("issues"))


@query(f"""WITH {datasets.SHUFFLED}, x AS (SELECT id, chr(CAST(64 + max(k) FILTER (i = 0) AS INT)) AS answer, count(*) AS n FROM s GROUP BY id)
SELECT 'gpqa-' || id AS id, 'multiple_choice' AS type, p_name AS prompt, n AS n_choices, answer, p_type AS domain FROM x JOIN {{part}} ON id = CAST(p_partkey AS VARCHAR)""")
def to_questions(t):
    rows = ds.shuffle_choices(datasets.records(t), 42).join(t.part.select(F.col("p_partkey").cast("string").alias("record_id"), F.col("p_name").alias("prompt"), F.col("p_type").alias("domain")), "record_id")
    return ds.to_questions(rows, "gpqa", "record_id", ["domain"]).select("id", "type", "prompt", F.size("choices").cast("long").alias("n_choices"), "answer", F.col("metadata")["domain"].alias("domain"))


@query("SELECT p_partkey AS line, p_brand AS category, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position FROM {part}")
def assign_positions(t):
    return ds.assign_positions(t.part.select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("category")), "category", ["line"])


@query("""SELECT p_partkey AS line, p_brand AS dataset, '{"p":"' || p_name || '","z":' || p_size || '}' AS value, count(*) OVER (PARTITION BY p_brand) AS question_count FROM {part}""")
def write_dataset(t):
    """Question lines and manifests written by dataset, in order, and read back line by line."""
    path = scratch_path(t.spark)
    json = ds.canonical_json(F.expr("concat('{ \"z\": ', p_size, ', \"p\":\"', p_name, '\"}')"))
    placed = ds.assign_positions(t.part.select("p_brand", "p_partkey", json.alias("json")), "p_brand", ["p_partkey"]).withColumnRenamed("p_brand", "dataset_id")
    manifests = placed.groupBy("dataset_id").agg(F.to_json(F.struct(F.col("dataset_id").alias("id"), F.count(F.lit(1)).alias("question_count"))).alias("json"))
    files.write_dataset(placed, path, manifests)
    dataset = F.url_decode(F.url_decode(F.regexp_extract("file", "dataset_id=([^/]+)/", 1))).alias("dataset")
    counts = files.read_manifests(t.spark, f"{path}/*/kind=manifest/part-*").select(dataset, F.get_json_object("value", "$.question_count").cast("long").alias("question_count"))
    lines = files.read_questions_jsonl(t.spark, f"{path}/*/kind=questions/part-*")
    read = lines.select(dataset, "value").groupBy("dataset", "value").agg(F.count(F.lit(1)).alias("n")).join(counts, "dataset")
    wanted = placed.select("p_partkey", F.col("dataset_id").alias("dataset"), F.col("json").alias("value"))
    return wanted.join(read, ["dataset", "value"]).select(F.col("p_partkey").alias("line"), "dataset", "value", "question_count")


@query(f"WITH {audit.CHUNKS}, m AS (SELECT archive_id, count(*) AS events FROM chunks GROUP BY archive_id) SELECT event_id, archive_id, event_type, events, CAST(event_id AS DOUBLE) / 8 AS seconds FROM chunks JOIN m USING (archive_id)")
def write_audit_archive(t):
    """Archives with headers, written and read back; durations are hexadecimal floats of eighths of a second."""
    path = scratch_path(t.spark)
    made = audit.chunks(t)
    eighths = F.col("event_id").cast("long")
    top = F.floor(F.log2(F.greatest(eighths, F.lit(1)).cast("double"))).cast("int")
    fraction = F.lpad(F.lower(F.hex(F.shiftleft(eighths, 0) * F.pow(F.lit(2.0), 52 - top).cast("long") - F.lit(1 << 52))), 13, "0")
    written = F.when(eighths == 0, "0x0.0p+0").otherwise(F.concat(F.lit("0x1."), fraction, F.lit("p"), F.when(top - 3 >= 0, "+").otherwise(""), (top - 3).cast("string")))
    line = F.to_json(F.struct("event_id", "event_type", written.alias("duration")))
    files.write_audit_archive(made, line, path, au.archive_manifest(made, audit.COLUMNS).select("archive_id", "events", "content_sha256"))
    events = files.read_audit_archive(t.spark, path, "event_id LONG, event_type STRING, duration STRING")
    heads = files.read_archive_headers(t.spark, path, "events LONG, content_sha256 STRING")
    rows = events.join(heads, "archive_id").select("event_id", F.col("archive_id").cast("long").alias("archive_id"), "event_type", "events", files.hex_float(F.col("duration")).alias("seconds"))
    return rows


@query("""SELECT run_id, CASE WHEN run_id % 3 = 0 THEN NULL WHEN run_id % 3 = 1 THEN 0.5 WHEN run_id % 2 = 0 THEN 1.0 ELSE 2.0 END AS temperature FROM {runs}""")
def effective_generation(t):
    """A requested null stands; without a request the model's default counts, else the protocol's."""
    asked = F.expr("CASE run_id % 3 WHEN 0 THEN map('temperature', CAST(NULL AS DOUBLE)) WHEN 1 THEN map('temperature', 0.5D) ELSE map('other', 9D) END")
    return t.runs.select("run_id", ev.effective(asked, "temperature", F.expr("if(run_id % 2 = 0, 1D, NULL)"), F.lit(2.0)).alias("temperature"))


CASES = """x AS (SELECT response_id, run_id, question_id, CASE response_id % 6 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'output_truncated' WHEN 2 THEN 'evaluator_internal_error' WHEN 3 THEN 'question_internal_error' WHEN 4 THEN 'adapter_timeout' END AS e, CASE question_id % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'stop' END AS f FROM {responses})"""


@query(f"""WITH {CASES} SELECT CASE e WHEN 'parse_error' THEN 'parse_error' WHEN 'output_truncated' THEN 'parse_error' WHEN 'evaluator_internal_error' THEN 'evaluator_error' WHEN 'question_internal_error' THEN 'internal_error' WHEN 'adapter_timeout' THEN 'adapter_error' ELSE 'none' END AS category,
  CASE WHEN e IS NULL THEN NULL WHEN f = 'length' THEN 'output_truncated' ELSE 'parse_error' END AS evidence, count(*) AS n FROM x GROUP BY ALL""")
def error_categories(t):
    e = F.expr("CASE response_id % 6 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'output_truncated' WHEN 2 THEN 'evaluator_internal_error' WHEN 3 THEN 'question_internal_error' WHEN 4 THEN 'adapter_timeout' END")
    f = F.expr("CASE question_id % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'stop' END")
    return t.responses.groupBy(scoring.error_category(e).alias("category"), scoring.parse_error_evidence(e, f).alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT question_id % 4 AS kind, response_id % 50 AS a, question_id % 50 AS b, raw_response AS raw, reference AS ref FROM {responses} JOIN {questions} USING (question_id))
SELECT kind, CAST(CASE kind WHEN 0 THEN CASE WHEN lower(raw) = lower('the  answer is ' || ref) OR lower(raw) = lower('the answer is ' || ref) THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN abs(a - b) <= 2 THEN 1 ELSE 0 END WHEN 2 THEN length(raw) ELSE 0 END AS DOUBLE) AS score,
  CASE WHEN kind = 3 THEN 'unknown_question_type' WHEN kind = 0 AND coalesce(raw, '') = '' THEN 'empty_response' WHEN kind = 2 AND raw IS NULL THEN 'evaluator_internal_error' END AS parse_error, count(*) AS n FROM x GROUP BY ALL""".replace("WHEN 2 THEN length(raw)", "WHEN 2 THEN coalesce(length(raw), 0)"))
def score_other_types(t):
    """Exact answers whatever their case and spaces, numbers within a tolerance, a type of one's own (it fails on a null), and an unknown one."""
    before = dict(scoring.SCORERS)
    scoring.register_scorer("length", "length_v1", lambda answer, reference, config: scoring.Score(float(len(answer)), None, None))
    asked = t.questions.selectExpr(
        "question_id", "CASE question_id % 4 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'numeric' WHEN 2 THEN 'length' ELSE 'none' END AS type", "CASE question_id % 4 WHEN 0 THEN concat(' the  ANSWER is ', reference) ELSE CAST(question_id % 50 AS STRING) END AS reference",
        "CAST(NULL AS ARRAY<STRING>) AS choices", "map('absolute_tolerance', '2') AS config",
    )
    answers = t.responses.withColumn("raw_response", F.expr("if(question_id % 4 = 1, concat('so \\\\boxed{', response_id % 50, '} it is'), raw_response)"))
    found = scoring.score_responses(answers, asked)
    scoring.SCORERS.clear()
    scoring.SCORERS.update(before)
    return found.groupBy((F.col("question_id") % 4).alias("kind"), "score", "parse_error").agg(F.count(F.lit(1)).alias("n"))
