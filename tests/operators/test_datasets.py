import json

from tallymill.operators import datasets as ds

MANIFEST = {
    "schema_version": "v1", "id": "a-b", "name": "n", "version": "1.0.0", "description": "d", "dimension": "math", "language": "en-GB", "license": "MIT", "source": "s",
    "evaluator": {"name": "builtin-objective", "version": "1.0", "mapping": dict(ds.MAPPING)}, "prompt_template": {"system": "", "user": "{{x}} {prompt} {choices}"}, "question_count": 3,
}
CHOICE = {"id": "q", "type": "multiple_choice", "prompt": "p", "choices": {"A": "x", "B": "y"}, "answer": "A", "metadata": {}}
EXACT = {"id": "q", "type": "exact_match", "prompt": "p", "answer": "", "metadata": {}, "evaluator_config": {"case_sensitive": True}}
NUMERIC = {"id": "q", "type": "numeric", "prompt": "p", "answer": "1.5e3", "metadata": {}, "evaluator_config": {"absolute_tolerance": 0.1}}


def changed(base, path, value):
    copy = json.loads(json.dumps(base))
    *way, last = path.split("/")
    at = copy
    for k in way:
        at = at[k]
    at[last] = value
    return copy


def test_manifest_rules(spark):
    cases = [
        (MANIFEST, None), (changed(MANIFEST, "schema_version", "v2"), "unsupported_schema_version"), (changed(MANIFEST, "id", "a" * 81), "string_length_out_of_range"), (changed(MANIFEST, "id", "a\n"), "pattern_mismatch"),
        (changed(MANIFEST, "language", "e"), "pattern_mismatch"), (changed(MANIFEST, "source", None), "invalid_type"), (changed(MANIFEST, "question_count", 1.5), "invalid_type"), (changed(MANIFEST, "question_count", 20_001), "question_count_out_of_range"),
        (changed(MANIFEST, "evaluator", []), "invalid_type"), (changed(MANIFEST, "evaluator/version", 1.0), "unsupported_evaluator_version"), (changed(MANIFEST, "evaluator/mapping/numeric", 1), "incompatible_evaluator_mapping"),
        (changed(MANIFEST, "evaluator/mapping", "x"), "invalid_type"), (changed(MANIFEST, "prompt_template/user", "{prompt} }"), "invalid_prompt_template"), (changed(MANIFEST, "prompt_template/user", "{{prompt}}"), "required_prompt_placeholder_missing"),
        (changed(MANIFEST, "prompt_template/user", "{prompt:>3}"), "unsupported_prompt_expression"), (changed(MANIFEST, "prompt_template/system", "s" * 4001), "string_length_out_of_range"), (changed(MANIFEST, "prompt_template/user", 5), "invalid_type"),
        (changed(MANIFEST, "more", 5), "additional_field_not_allowed"), ([1], "object_required"),
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(cases)] + [(99, "{"), (100, None)], "dataset_id int, value string")
    got = sorted((r.dataset_id, r.code) for r in ds.manifest_issues(df, "v1").collect())
    assert got == [(i, c) for i, (_, c) in enumerate(cases) if c] + [(99, "invalid_json"), (100, "invalid_json")]


def test_question_rules(spark):
    cases = [
        (CHOICE, None), (EXACT, None), (NUMERIC, None), (changed(NUMERIC, "answer", 12), None), (changed(NUMERIC, "answer", -1.5), None),
        (changed(CHOICE, "id", "q" * 129), "string_length_out_of_range"), (changed(CHOICE, "prompt", ""), "string_length_out_of_range"), (changed(CHOICE, "prompt", 5), "invalid_type"), (changed(CHOICE, "metadata", []), "invalid_type"),
        (changed(CHOICE, "choices", []), "invalid_type"), (changed(CHOICE, "choices/B", 3), "invalid_type"), (changed(CHOICE, "choices/C", ""), "string_length_out_of_range"), (changed(CHOICE, "choices/AB", "z"), "invalid_choice_key"),
        (changed(CHOICE, "choices", {"A": "x"}), "choices_count_out_of_range"), (changed(CHOICE, "answer", "C"), "answer_not_in_choices"), (changed(CHOICE, "answer", "AB"), "string_length_out_of_range"), (changed(CHOICE, "answer", "a"), "pattern_mismatch"),
        (changed(EXACT, "answer", "x" * 4001), "string_length_out_of_range"), (changed(EXACT, "evaluator_config/case_sensitive", 1), "invalid_type"), (changed(EXACT, "evaluator_config/other", True), "additional_field_not_allowed"), (changed(EXACT, "evaluator_config", 1), "invalid_type"),
        (changed(NUMERIC, "answer", "1,5"), "invalid_numeric_answer"), (changed(NUMERIC, "answer", True), "invalid_numeric_answer"), (changed(NUMERIC, "answer", "1" * 129), "invalid_numeric_answer"), (changed(NUMERIC, "evaluator_config/relative_tolerance", -1), "invalid_tolerance"),
        (changed(NUMERIC, "evaluator_config/relative_tolerance", "1"), "invalid_type"), (changed(NUMERIC, "type", "essay"), "unsupported_question_type"),
    ]
    df = spark.createDataFrame([(1, i, json.dumps(v)) for i, (v, _) in enumerate(cases)], "dataset_id int, line int, value string")
    got = sorted((r.line, r.code) for r in ds.question_issues(df).collect())
    assert got == [(i, c) for i, (_, c) in enumerate(cases) if c]


def test_cross_rules(spark):
    manifests = spark.createDataFrame([(1, json.dumps(changed(MANIFEST, "evaluator/mapping/numeric", "x"))), (2, json.dumps(changed(MANIFEST, "evaluator", None)))], "dataset_id int, value string")
    lines = [(d, i, json.dumps(changed(q, "id", f"q{i}"))) for d in (1, 2) for i, q in enumerate((CHOICE, NUMERIC, EXACT))] + [(2, 3, json.dumps(changed(CHOICE, "id", "q0")))]
    got = ds.cross_issues(manifests, spark.createDataFrame(lines, "dataset_id int, line int, value string")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, "incompatible_evaluator_mapping", None), (2, 3, "duplicate_question_id", 0), (2, None, "question_count_mismatch", None)]


def test_names_are_escaped_in_pointers(spark):
    """A name with / or ~ is one part of the pointer."""
    value = '{"id": "q", "type": "exact_match", "prompt": "p", "answer": "a", "metadata": {}, "a/b": 1, "c~d": 2}'
    choice = '{"id": "q", "type": "multiple_choice", "prompt": "p", "answer": "A", "metadata": {}, "choices": {"A": "x", "B/~": "y"}}'
    questions = spark.createDataFrame([("d", 1, value), ("d", 2, choice)], "dataset_id STRING, line INT, value STRING")
    got = {(r.line, r.code, r.pointer) for r in ds.question_issues(questions).collect()}
    assert got == {(1, "additional_field_not_allowed", "/a~1b"), (1, "additional_field_not_allowed", "/c~0d"), (2, "invalid_choice_key", "/choices/B~1~0")}
