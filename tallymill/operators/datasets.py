"""Versioned question sets: normalising sources, prompts, validation, hashes and loading."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.numbering import number_rows

SHOTS = 5
#: The instructions of the two prompt profiles.
DIRECT = "Answer the following multiple choice question. Respond with only the correct option letter.\n\n"
OFFICIAL = 'The following are multiple choice questions (with answers) about {category}. Think step by step and then finish your answer with "the answer is (X)" where X is the correct letter choice.\n'


def _codes(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for code, broken in rules.items())))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def normalize_mmlu(rows: DataFrame) -> DataFrame:
    """Source rows in one form, each with `issues`: the codes of what is wrong (empty for a good row).

    Texts are trimmed, N/A options dropped, 2 to 26 options kept; the answer must be the letter of its index.
    """
    options = F.transform(F.filter("options", lambda x: ~F.equal_null(x, F.lit("N/A"))), lambda x: F.trim(x))
    n = F.size(options)
    answer, index = F.upper(F.trim("answer")), F.col("answer_index").cast("int")
    rules = {
        "empty_question_id": _blank("question_id"), "empty_question": _blank("question"), "empty_category": _blank("category"), "empty_answer": _blank("answer"),
        "invalid_option": F.exists(options, lambda x: F.coalesce(x == "", F.lit(True))), "option_count": ~n.between(2, 26),
        "inconsistent_answer": ~((index >= 0) & (index < n) & (F.char(index + 65) == answer)),
    }
    return rows.select(
        F.trim(F.col("question_id").cast("string")).alias("question_id"), F.trim("question").alias("question"), options.alias("options"), answer.alias("answer"), index.alias("answer_index"), F.trim("category").alias("category"),
        F.coalesce(F.nullif(F.trim("src"), F.lit("")), F.lit("unknown")).alias("src"), F.trim(F.coalesce("cot_content", F.lit(""))).alias("cot_content"), *(c for c in ("line",) if c in rows.columns), _codes(rules).alias("issues"),
    )


def normalize_gpqa(rows: DataFrame) -> DataFrame:
    """Only the columns that are needed, trimmed, the wrong answers in an array, with `issues` for empty ones."""
    need = {"record_id": "Record ID", "question": "Question", "correct_answer": "Correct Answer", "domain": "High-level domain", "subdomain": "Subdomain"}
    wrong = [f"Incorrect Answer {k}" for k in (1, 2, 3)]
    issues = _codes({f"empty_{c.lower().replace(' ', '_').replace('-', '_')}": _blank(f"`{c}`") for c in (*need.values(), *wrong)})
    return rows.select(*(F.trim(f"`{c}`").alias(a) for a, c in need.items()), F.array(*(F.trim(f"`{c}`") for c in wrong)).alias("incorrect_answers"), *(c for c in ("line",) if c in rows.columns), issues.alias("issues"))


def select_groups(rows: DataFrame, column: str, requested: list[str]) -> DataFrame:
    """Rows whose group is asked for, whatever the case of its letters."""
    return rows.where(F.lower(column).isin([r.strip().lower() for r in requested]))


def unknown_groups(rows: DataFrame, column: str, requested: list[str]) -> DataFrame:
    """(requested) without a row."""
    asked = rows.sparkSession.createDataFrame([(r,) for r in requested], "requested STRING")
    return asked.join(rows.select(F.lower(column).alias("have")).distinct(), F.lower(F.trim("requested")) == F.col("have"), "left_anti")


def take_first(rows: DataFrame, order: list[str], n: int, by: str | None = None) -> DataFrame:
    """The first n rows in source order, of each group if `by` is given: the number is what is asked for."""
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def question_block(question: Column, options: Column) -> Column:
    lines = F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x, F.lit("\n"))), "")
    return F.concat(F.lit("Question:\n"), question, F.lit("\nOptions:\n"), lines)


def direct_prompt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prompt", F.concat(F.lit(DIRECT), question_block(F.col("question"), F.col("options")), F.lit("Answer:")))


def few_shot_prompt(rows: DataFrame, validation: DataFrame, order: list[str], shots: int = SHOTS) -> DataFrame:
    """Prompts with the first `shots` validation examples of the row's category; null where there are fewer or one has no reasoning.

    The examples' text, one row a category, is the small side of the join.
    """
    cot = F.replace(F.col("cot_content"), F.lit("A: Let's think step by step."), F.lit("Answer: Let's think step by step."))
    shot = F.when(F.col("cot_content") != "", F.concat(question_block(F.col("question"), F.col("options")), cot, F.lit("\n\n")))
    place = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    firsts = validation.select("category", shot.alias("shot"), place.alias("k")).where(F.col("k") <= shots)
    text = firsts.groupBy("category").agg(F.when(F.count("shot") == shots, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "shot"))), lambda x: x["shot"]), "")).alias("examples"))
    prefix = F.replace(F.lit(OFFICIAL), F.lit("{category}"), F.col("category"))
    prompt = F.concat(prefix, F.col("examples"), question_block(F.col("question"), F.col("options")), F.lit("Answer: Let's think step by step."))
    return rows.join(text, "category", "left").withColumn("prompt", prompt).drop("examples")


def shuffle_choices(rows: DataFrame, seed: int) -> DataFrame:
    """`choices` (letter to text) and `answer`, in an order that a hash of seed, record and place gives: no exchange, the same everywhere."""
    all_of = F.concat(F.array("correct_answer"), F.col("incorrect_answers"))
    place = lambda x, i: F.struct(F.sha2(F.concat(F.lit(f"{seed}\0"), F.col("record_id"), F.lit("\0"), i.cast("string")), 256).alias("h"), i.alias("i"), x.alias("text"))
    dealt = F.array_sort(F.transform(all_of, place))
    letters = F.transform(dealt, lambda x, i: F.char(i + 65))
    right = F.array_position(F.transform(dealt, lambda x: x["i"]), F.lit(0)).cast("int")
    return rows.withColumns({"choices": F.map_from_arrays(letters, F.transform(dealt, lambda x: x["text"])), "answer": F.char(right + 64)})


def to_questions(rows: DataFrame, prefix: str, key: str, metadata: list[str]) -> DataFrame:
    """(id, type, prompt, choices, answer, metadata) from rows with prompt, choices and answer."""
    return rows.select(F.concat(F.lit(f"{prefix}-"), F.col(key)).alias("id"), F.lit("multiple_choice").alias("type"), "prompt", "choices", "answer", F.create_map(*(x for m in metadata for x in (F.lit(m), F.col(m)))).alias("metadata"))


def assign_positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `position`, the place in their group from 0; ranges of rows are numbered, so a large group is no single task's."""
    numbered = number_rows(rows, [group, *order], "__n")
    first = numbered.groupBy(group).agg(F.min("__n").alias("__first")).withColumnRenamed(group, "__group")
    out = numbered.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return out.withColumn("position", F.col("__n") - F.col("__first")).select(*rows.columns, "position")


# -- canonical JSON and hashes -------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Byte-exact: sorted keys, no spaces, non-ASCII as it is; null for what is no JSON."""

    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    return texts.map(one)


def dataset_hash(manifests: DataFrame, questions: DataFrame) -> DataFrame:
    """(dataset_id, dataset_hash): SHA-256 over the canonical manifest and each canonical question in order, a line each.

    manifests: (dataset_id, value); questions: (dataset_id, line, value). Lines of a dataset stream through
    one digest, sorted by the shuffle, so no dataset is put together as one string.
    """
    lines = manifests.select("dataset_id", F.lit(-1).cast("long").alias("line"), canonical_json("value").alias("json")).unionByName(questions.select("dataset_id", F.col("line").cast("long"), canonical_json("value").alias("json")))
    kind = manifests.schema["dataset_id"].dataType.simpleString()

    def digest(batches):
        here, state = None, None
        for pdf in batches:
            out = []
            for key, text in zip(pdf["dataset_id"], pdf["json"]):
                if state is None or key != here:
                    if state is not None:
                        out.append((here, state.hexdigest()))
                    here, state = key, hashlib.sha256()
                state.update((text or "").encode() + b"\n")
            yield pd.DataFrame(out, columns=["dataset_id", "dataset_hash"])
        if state is not None:
            yield pd.DataFrame([(here, state.hexdigest())], columns=["dataset_id", "dataset_hash"])

    return lines.repartition("dataset_id").sortWithinPartitions("dataset_id", "line").mapInPandas(digest, f"dataset_id {kind}, dataset_hash string")


# -- validation ----------------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def jsonl_error(lines: pd.Series) -> pd.Series:
    """The code of what is wrong with a line of JSON objects; null if nothing is."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise KeyError("duplicate_json_key")
        return dict(items)

    def constant(_):
        raise KeyError("non_finite_number")

    def one(line):
        if line is None or not line.strip():
            return "empty_line"
        if len(line.encode("utf-8", "surrogatepass")) > 256 * 1024:
            return "line_too_large"
        try:
            value = json.loads(line, object_pairs_hook=pairs, parse_constant=constant)
            json.dumps(value, ensure_ascii=False).encode()
        except KeyError as e:
            return e.args[0]
        except RecursionError:
            return "json_nesting_too_deep"
        except UnicodeEncodeError:
            return "invalid_unicode"
        except ValueError:
            return "invalid_json"
        return None if isinstance(value, dict) else "object_required"

    return lines.map(one)


MANIFEST_FIELDS = ("schema_version", "id", "name", "version", "description", "dimension", "language", "license", "source", "evaluator", "prompt_template", "question_count")
#: For each question type the fields that a record must have and those that it may have besides.
QUESTION_FIELDS = {
    "exact_match": (("id", "type", "prompt", "answer", "metadata"), ("evaluator_config",)),
    "multiple_choice": (("id", "type", "prompt", "choices", "answer", "metadata"), ()),
    "numeric": (("id", "type", "prompt", "answer", "metadata"), ("evaluator_config",)),
}
ID = r"^[a-z0-9]+(-[a-z0-9]+)*\z"
QUESTION_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
#: Least and greatest length of each text of a manifest, and its form; the texts of a prompt template.
MANIFEST_TEXTS = {
    "id": (1, 80, ID),
    "name": (1, 160, None),
    "version": (1, 64, r"^[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?\z"),
    "description": (1, 4_000, None),
    "dimension": (1, 64, r"^[a-z][a-z0-9_-]*\z"),
    "language": (1, 35, r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*\z"),
    "license": (1, 128, None),
    "source": (1, 2_048, None),
}
TEMPLATE_TEXTS = {"system": (0, 4_000, None), "user": (1, 12_000, None)}
MOST_QUESTIONS = 20_000
#: The evaluator, its version, and the scorer of each question type.
EVALUATOR, EVALUATOR_VERSION = "builtin-objective", "1.0"
MAPPING = {"exact_match": "exact_match_v1", "multiple_choice": "multiple_choice_v1", "numeric": "numeric_v1"}
#: Settings of a scorer that a question may carry.
SWITCHES, TOLERANCES = ("case_sensitive", "normalize_whitespace"), ("absolute_tolerance", "relative_tolerance")


def pointer_part(name: Column) -> Column:
    """A name as a part of a JSON pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


class _Json:
    """Rules over the JSON object in a column; each gives an array of (code, pointer), empty where the rule holds or the field is missing."""

    def __init__(self, column: str):
        self.column, self.value = column, F.try_parse_json(column)

    @staticmethod
    def issue(code: Column | str, pointer: Column | str) -> Column:
        return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(pointer) if isinstance(pointer, str) else pointer).alias("pointer"))

    def at(self, code: Column | str, field: str, broken: Column | None = None) -> Column:
        """broken may be left out where code is null unless the rule is broken."""
        broken = code.isNotNull() if broken is None else F.coalesce(broken, F.lit(False))
        return F.when(broken, F.array(self.issue(code, "/" + field.replace(".", "/"))))

    def get(self, field: str, kind: str = "string") -> Column:
        return F.try_variant_get(self.value, f"$.{field}", kind)

    def kind(self, field: str = "") -> Column:
        return F.schema_of_variant(F.try_variant_get(self.value, f"$.{field}" if field else "$", "variant"))

    def is_object(self, field: str = "") -> Column:
        return F.coalesce(F.startswith(self.kind(field), F.lit("OBJECT")), F.lit(False))

    def is_number(self, field: str) -> Column:
        return self.kind(field).rlike("^(BIGINT|DECIMAL|DOUBLE)")

    def fields(self, need: Column, may: Column, inside: str = "") -> Column:
        """Fields that are missing, and those beside the allowed ones."""
        have = F.coalesce(F.json_object_keys(F.get_json_object(self.column, f"$.{inside}") if inside else F.col(self.column)), F.array().cast("array<string>"))
        base = f"/{inside.replace('.', '/')}/" if inside else "/"
        each = lambda code: lambda k: self.issue(code, F.concat(F.lit(base), pointer_part(k)))
        both = F.concat(F.transform(F.array_except(need, have), each("required_field_missing")), F.transform(F.array_except(have, may), each("additional_field_not_allowed")))
        return F.when(self.is_object(inside), both)

    def an_object(self, field: str) -> Column:
        return self.at("invalid_type", field, ~self.is_object(field) & self.kind(field).isNotNull())

    def a_text(self, field: str, low: int, high: int, form: str | None = None) -> Column:
        return self.at(text_fault(self.kind(field), self.get(field), low, high, form), field)


def text_fault(kind: Column, text: Column, low: int, high: int, form: str | None = None) -> Column:
    """The code of what is wrong with a text of a given kind; null if nothing is, or there is none."""
    found = F.when(kind != "STRING", "invalid_type").when(~F.char_length(text).between(low, high), "string_length_out_of_range")
    return found if form is None else found.when(~text.rlike(form), "pattern_mismatch")


def _names(names) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def _gather(parts: list[Column]) -> Column:
    return F.concat(*(F.coalesce(p, F.array().cast("array<struct<code:string,pointer:string>>")) for p in parts))


def manifest_issues(manifests: DataFrame, schema_version: str | None = None) -> DataFrame:
    """(dataset_id, code, pointer) of manifests (dataset_id, value); schema_version is the one asked for, if any."""
    j = _Json("value")
    count = j.kind("question_count")
    #  braces that stand for themselves are doubled; what is left must be fields
    bare = F.regexp_replace(j.get("prompt_template.user"), r"\{\{|\}\}", "")
    used = F.regexp_extract_all(bare, F.lit(r"\{([^{}]*)\}"), F.lit(1))
    name = lambda x: F.regexp_extract(x, "^[^!:]*", 0)
    known = lambda x: name(x).isin("prompt", "choices")
    open_brace = F.regexp_replace(bare, r"\{[^{}]*\}", "").rlike(r"[{}]")
    user = lambda code, broken: j.at(code, "prompt_template.user", broken & (j.kind("prompt_template.user") == "STRING"))
    rules = [
        j.fields(_names(MANIFEST_FIELDS), _names(MANIFEST_FIELDS)), *(j.a_text(f, *rule) for f, rule in MANIFEST_TEXTS.items()),
        j.at("unsupported_schema_version", "schema_version", F.lit(False) if schema_version is None else j.kind("schema_version").isNotNull() & ~F.equal_null(j.get("schema_version"), F.lit(schema_version))),
        j.at(F.when(count != "BIGINT", "invalid_type").when(~j.get("question_count", "long").between(1, MOST_QUESTIONS), "question_count_out_of_range"), "question_count"),
        j.an_object("evaluator"), j.fields(_names(("name", "version", "mapping")), _names(("name", "version", "mapping")), "evaluator"),
        j.at("unsupported_evaluator", "evaluator.name", j.kind("evaluator.name").isNotNull() & ~F.equal_null(j.get("evaluator.name"), F.lit(EVALUATOR))),
        j.at("unsupported_evaluator_version", "evaluator.version", j.kind("evaluator.version").isNotNull() & ~((j.kind("evaluator.version") == "STRING") & F.equal_null(j.get("evaluator.version"), F.lit(EVALUATOR_VERSION)))),
        j.an_object("evaluator.mapping"), j.fields(_names(MAPPING), _names(MAPPING), "evaluator.mapping"),
        *(j.at("incompatible_evaluator_mapping", f"evaluator.mapping.{t}", j.kind(f"evaluator.mapping.{t}").isNotNull() & ~F.equal_null(j.get(f"evaluator.mapping.{t}"), F.lit(scorer))) for t, scorer in MAPPING.items()),
        j.an_object("prompt_template"), j.fields(_names(TEMPLATE_TEXTS), _names(TEMPLATE_TEXTS), "prompt_template"), *(j.a_text(f"prompt_template.{f}", *rule) for f, rule in TEMPLATE_TEXTS.items()),
        user("invalid_prompt_template", open_brace), user("unsupported_prompt_placeholder", F.exists(used, lambda x: ~known(x))), user("unsupported_prompt_expression", F.exists(used, lambda x: known(x) & (x != name(x)))),
        user("required_prompt_placeholder_missing", ~open_brace & ~F.exists(used, lambda x: name(x) == "prompt")),
    ]
    one = lambda code: F.array(j.issue(code, ""))
    whole = F.when(j.value.isNull(), one("invalid_json")).when(~j.is_object(), one("object_required")).otherwise(_gather(rules))
    return manifests.select("dataset_id", F.explode(whole).alias("i")).select("dataset_id", "i.code", "i.pointer")


def question_issues(questions: DataFrame) -> DataFrame:
    """(dataset_id, line, code, pointer) of question lines (dataset_id, line, value)."""
    j = _Json("value")
    choices = F.map_entries(F.from_json(F.get_json_object("value", "$.choices"), "map<string,variant>"))
    in_choice = lambda code: lambda e: j.issue(code(e), F.concat(F.lit("/choices/"), pointer_part(e["key"])))
    bad = lambda e: text_fault(F.schema_of_variant(e["value"]), F.try_variant_get(e["value"], "$", "string"), 1, 4_000)
    letter = r"^[A-Z]\z"
    answer, is_number = j.get("answer"), j.is_number("answer")
    number = F.when(is_number, F.abs(j.get("answer", "double")) < float("inf")).otherwise((j.kind("answer") == "STRING") & (F.char_length(answer) <= 128) & answer.rlike(NUMBER))
    common = [j.a_text("id", 1, 128, QUESTION_ID), j.a_text("prompt", 1, 20_000), j.an_object("metadata")]
    settings = lambda names: [j.an_object("evaluator_config"), j.fields(_names(()), _names(names), "evaluator_config")]
    own = {
        "exact_match": [j.a_text("answer", 0, 4_000), *settings(SWITCHES), *(j.at("invalid_type", f"evaluator_config.{k}", j.kind(f"evaluator_config.{k}") != "BOOLEAN") for k in SWITCHES)],
        "multiple_choice": [
            j.an_object("choices"), j.at("choices_count_out_of_range", "choices", j.is_object("choices") & ~F.size(choices).between(2, 26)),
            F.transform(F.filter(choices, lambda e: ~e["key"].rlike(letter)), in_choice(lambda e: F.lit("invalid_choice_key"))), F.transform(F.filter(choices, lambda e: bad(e).isNotNull()), in_choice(bad)),
            j.a_text("answer", 1, 1, letter), j.at("answer_not_in_choices", "answer", j.is_object("choices") & (j.kind("answer") == "STRING") & answer.rlike(letter) & ~F.exists(choices, lambda e: e["key"] == answer)),
        ],
        "numeric": [
            j.at("invalid_numeric_answer", "answer", j.kind("answer").isNotNull() & ~F.coalesce(number, F.lit(False))), *settings(TOLERANCES),
            *(j.at(F.when(~j.is_number(f"evaluator_config.{k}"), "invalid_type").when(~j.get(f"evaluator_config.{k}", "double").between(0, 1.7976931348623157e308), "invalid_tolerance"), f"evaluator_config.{k}") for k in TOLERANCES),
        ],
    }
    one = lambda code, pointer: F.array(j.issue(code, pointer))
    kind = F.get_json_object("value", "$.type")
    error = F.col("error")
    whole = F.when(error.isNotNull(), F.array(j.issue(error, ""))).when(kind.isNull(), one("required_field_missing", "/type"))
    for t, (need, may) in QUESTION_FIELDS.items():
        whole = whole.when(kind == t, _gather([j.fields(_names(need), _names(need + may)), *common, *own[t]]))
    rows = questions.select("dataset_id", "line", "value", jsonl_error("value").alias("error"))
    return rows.select("dataset_id", "line", F.explode(whole.otherwise(one("unsupported_question_type", "/type"))).alias("i")).select("dataset_id", "line", "i.code", "i.pointer")


def cross_issues(manifests: DataFrame, questions: DataFrame) -> DataFrame:
    """(dataset_id, line, code, first_line): what questions and their manifest do not agree on.

    A repeated question id (with the line of the first), a question type for which the manifest's mapping has another
    scorer or none, and a count that is not the declared one (line null).
    """
    ids = questions.select("dataset_id", "line", F.get_json_object("value", "$.id").alias("id")).where("id IS NOT NULL")
    first = ids.groupBy("dataset_id", "id").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = ids.join(first, ["dataset_id", "id"]).where("line > first_line").select("dataset_id", F.col("line").cast("long").alias("line"), F.lit("duplicate_question_id").alias("code"), F.col("first_line").cast("long").alias("first_line"))
    found = questions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    counts = manifests.select("dataset_id", F.get_json_object("value", "$.question_count").try_cast("long").alias("declared")).join(found, "dataset_id", "left")
    wrong = counts.where("declared <> coalesce(n, 0)").select("dataset_id", F.lit(None).cast("long").alias("line"), F.lit("question_count_mismatch").alias("code"), F.lit(None).cast("long").alias("first_line"))
    j = _Json("value")
    bad = [F.when(~F.equal_null(j.get(f"evaluator.mapping.{t}"), F.lit(scorer)), F.lit(t)) for t, scorer in MAPPING.items()]
    types = manifests.where(j.is_object("evaluator.mapping")).select("dataset_id", F.explode(F.array_compact(F.array(*bad))).alias("type"))
    typed = questions.select("dataset_id", F.col("line").cast("long").alias("line"), F.get_json_object("value", "$.type").alias("type"))
    unmapped = typed.join(types, ["dataset_id", "type"]).select("dataset_id", "line", F.lit("incompatible_evaluator_mapping").alias("code"), F.lit(None).cast("long").alias("first_line"))
    return again.unionByName(unmapped).unionByName(wrong)


def upsert_dispositions(loaded: DataFrame, stored: DataFrame) -> DataFrame:
    """loaded (slug, version, dataset_hash) with `disposition`: unchanged, conflict (another hash) or created."""
    have = stored.select("slug", "version", F.col("dataset_hash").alias("stored_hash"))
    out = loaded.join(have, ["slug", "version"], "left")
    what = F.when(F.col("stored_hash").isNull(), "created").when(F.col("stored_hash") == F.col("dataset_hash"), "unchanged").otherwise("conflict")
    return out.withColumn("disposition", what).drop("stored_hash")


def created_questions(dispositions: DataFrame, questions: DataFrame, order: list[str]) -> DataFrame:
    """The questions (slug, version, ...) of the sets that upsert_dispositions calls created, with their `position` from 0.

    A load appends just these; sets that are unchanged or in conflict add nothing.
    """
    new = dispositions.where("disposition = 'created'").select("slug", "version").distinct()
    whole = F.to_json(F.struct("slug", "version"))
    placed = assign_positions(questions.join(new, ["slug", "version"], "left_semi").withColumn("__set", whole), "__set", order)
    return placed.drop("__set")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
