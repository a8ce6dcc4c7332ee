"""Reading sources and writing datasets, reports and archives, all through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MMLU_COLUMNS = ["question_id", "question", "options", "answer", "answer_index", "cot_content", "category", "src"]
GPQA_COLUMNS = ["Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3", "Subdomain", "Record ID", "High-level domain"]


def _require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def read_questions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): each physical line of JSONL files, numbered from 1 within its file; a final empty line is none.

    A file is read by as many tasks as it has splits. Lines are numbered within their split; the splits' sizes, one row each,
    give what comes before. A byte order mark and the carriage return of a CRLF are no part of a line; an empty file has no lines.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    rows = text.select(*at, F.monotonically_increasing_id().alias("id"), "value")
    sizes = text.select(*at).groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"))
    before = sizes.select("file", "split", (F.sum("lines").over(Window.partitionBy("file").orderBy("split")) - F.col("lines")).alias("before"))
    inside = rows.withColumn("line", F.row_number().over(Window.partitionBy("file", "split").orderBy("id")))
    line = (F.col("before") + F.col("line")).cast("long")
    value = F.regexp_replace(F.when(line == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), "\r$", "")
    return inside.join(before, ["file", "split"]).select("file", line.alias("line"), value.alias("value"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of one JSON object for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def _expect(df: DataFrame, expected: int | None) -> DataFrame:
    """df, if it has as many rows as are expected."""
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return df


def read_mmlu_parquet(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    return _expect(_require(spark.read.parquet(path), MMLU_COLUMNS).select(*MMLU_COLUMNS), expected)


def read_gpqa_csv(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Columns that are not needed (some hold names of people) are not read further. The published diamond set has 198 rows."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    return _expect(_require(df, GPQA_COLUMNS).select(*(f"`{c}`" for c in GPQA_COLUMNS)), expected)


def write_dataset(questions: DataFrame, path: str, manifests: DataFrame | None = None) -> None:
    """(dataset_id, position, json) as text, a folder for each dataset, lines in order.

    With manifests (dataset_id, json) the folder of a dataset has two, kind=questions and kind=manifest.
    """
    dealt = questions.repartitionByRange("dataset_id", "position").sortWithinPartitions("dataset_id", "position")
    rows = dealt.select("dataset_id", F.lit("questions").alias("kind"), F.col("json").alias("value"))
    if manifests is None:
        rows.drop("kind").write.mode("errorifexists").partitionBy("dataset_id").text(path)
    else:
        both = rows.unionByName(manifests.select("dataset_id", F.lit("manifest").alias("kind"), F.col("json").alias("value")))
        both.write.mode("errorifexists").partitionBy("dataset_id", "kind").text(path)


def write_run_reports(responses: DataFrame, groups: DataFrame, summary: DataFrame, path: str) -> None:
    """For each run its responses (JSON lines by position), groups (CSV) and summary (JSON); nothing is overwritten."""
    by_run = lambda df: df.withColumn("run_dir", F.col("run_id"))
    by_run(responses).repartition("run_id").sortWithinPartitions("run_id", "position", "response_id").write.mode("errorifexists").partitionBy("run_dir").json(f"{path}/responses")
    by_run(groups).repartition("run_id").sortWithinPartitions("run_id", "group_value").write.mode("errorifexists").partitionBy("run_dir").csv(f"{path}/groups", header=True)
    by_run(summary).repartition("run_id").write.mode("errorifexists").partitionBy("run_dir").json(f"{path}/summary")


HEADER = "archive_header"


def write_audit_archive(chunks: DataFrame, lines: Column, path: str, manifests: DataFrame | None = None) -> None:
    """Archives as text, a folder for each, events in their place; `lines` is the Column of an event's line.

    With manifests (archive_id, ...) each archive begins with a header: its manifest's values as JSON.
    """
    rows = chunks.select("archive_id", "place", lines.alias("value"))
    if manifests is not None:
        values = [c for c in manifests.columns if c != "archive_id"]
        head = F.to_json(F.struct(F.lit(HEADER).alias("record"), *values), {"ignoreNullFields": "false"})
        rows = rows.unionByName(manifests.select("archive_id", F.lit(-1).cast("long").alias("place"), head.alias("value")))
    rows.repartition("archive_id").sortWithinPartitions("archive_id", "place").select("archive_id", "value").write.mode("errorifexists").partitionBy("archive_id").text(path)


def _is_header() -> Column:
    return F.coalesce(F.get_json_object("value", "$.record") == HEADER, F.lit(False))


def read_audit_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of archives, parsed by the schema; a line that can't be parsed has nulls and its text in _corrupt. Headers are left out."""
    lines = spark.read.text(path).where(~_is_header())
    return lines.select("archive_id", F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("archive_id", "e.*")


def read_archive_headers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(archive_id, the manifest's values) from the headers of archives."""
    lines = spark.read.text(path).where(_is_header())
    return lines.select("archive_id", F.from_json("value", schema).alias("m")).select("archive_id", "m.*")


def hex_float(value: Column) -> Column:
    """The number that a hexadecimal float such as 0x1.8000000000000p+1 writes; null for what is written otherwise."""
    part = lambda k: F.regexp_extract(value, r"^(-?)0x([01])\.([0-9a-f]{1,13})p([+-][0-9]+)$", k)
    fraction = F.conv(F.rpad(part(3), 13, "0"), 16, 10).cast("double") / F.lit(2.0**52)
    number = (part(2).cast("double") + fraction) * F.pow(F.lit(2.0), part(4).cast("double"))
    return F.when(part(2) != "", F.when(part(1) == "-", -number).otherwise(number))
