import json

from wayscore.operators import catalog, prompts, tables
from wayscore.sources import logs


def test_logs_are_read_and_routed(spark, tmp_path):
    def put(name, **fields):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"cve": "CVE-1_x", "language": "Java", "model": "m", "prompt_name": "llmpath", **fields}))

    found = {"findings": [{"taint_path": [{"file": "a", "lines": "1-2"}, {"file": "a", "lines": "7"}]}]}
    put("x/good.json", output="```json\n" + json.dumps(found) + "\n```")
    put("x/lines.json", output=json.dumps({"a.py": {"vulnerable_lines": [3, None], "explanation": ""}}))
    put("x/null.json", output='{"findings": null}')
    put("x/bad.json", output="nothing")
    put("x/two.json", cve="CVE-2", output='{"findings": []}')
    put("x/none.json", cve=None, output='{"findings": []}')
    put("x/exception_1.json", output="{}")
    put("y/good.json", output='{"findings": []}', language="Python")
    (tmp_path / "x" / "broken.json").write_text("{")
    cases = spark.createDataFrame([("Java", "CVE-1_x", True), ("Java", "CVE-2a", True), ("Java", "CVE-2b", True), ("Python", "CVE-1_p", True)], "language string, folder string, loaded boolean")
    rows = {r.run_id: r for r in logs.routed(logs.read_logs(spark, str(tmp_path)), cases, cases.limit(0)).collect()}
    reasons = {k: r.reason for k, r in rows.items()}
    assert reasons == {"good": None, "lines": None, "null": None, "bad": "bad_output", "two": "rq1:unmapped", "none": "rq1:no_id", "broken": "load_failure"}
    assert rows["good"].language == "Python" and rows["lines"].output_label == 1 and rows["null"].output_label == 0
    nodes = logs.pred_nodes(logs.normalised(logs.read_logs(spark, str(tmp_path / "x")))).collect()
    assert [(n.run_id, n.node_idx, n.start_line, n.end_line) for n in nodes] == [("good", 0, 1, 2)]


def test_annotations_keep_order(spark):
    body = '{"z": [{"line_number": 3, "file_name": "f", "code_snippet": ""}], "a": [{"line_number": 1, "file_name": "g", "code_snippet": "", "endLine": 4}]}'
    rows = logs.real_nodes(spark.createDataFrame([("c", body)], "folder string, content string")).orderBy("path_ord").collect()
    assert [(r.path_hash, r.start_line, r.end_line) for r in rows] == [("z", 3, 3), ("a", 1, 4)]


def test_prompts(spark):
    files = spark.createDataFrame([("c", "b", "x\ny"), ("c", "a", "z")], "case_id string, path string, content string")
    combos = spark.createDataFrame([("c", 0, ["b", "gone", "a"])], "case_id string, combo int, files array<string>")
    inputs = prompts.prompt_inputs(combos, files)
    assert inputs.first().input == "===== b =====\nL1: x\nL2: y\n\n===== a =====\nL1: z"
    made = prompts.prompt_frame(inputs.selectExpr("*", "'java' language"), spark.createDataFrame([("p", "In $_LANGUAGE")], "prompt string, template string"))
    answered = prompts.respond(made, lambda p, t: p.upper() if t else None)
    assert answered.first().output == "IN JAVA"


def test_last_writer_and_confusion(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, at int, v string")
    assert catalog.last_writer(rows, "key", ["at"]).first().v == "new"
    judged = spark.createDataFrame([("m", "p", 1, 0), ("m", "q", 0, 1)], "model string, prompt string, actual int, predicted int")
    got = {r.prompt: r for r in tables.prompt_comparison(judged, "p").collect()}
    assert got["p"].delta_fp is None and got["q"].delta_fp == -1 and got["q"].mcc == 0.0


def test_entry_survives_without_training_data():
    import __spark_entry__ as e

    assert "model_summary" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_first_and_only_prefix_hits(spark):
    folders = spark.createDataFrame([("J", "CVE-1"), ("J", "CVE-1_a"), ("J", "CVE-12_b"), ("P", "CVE-2_c")], "language string, folder string")
    keys = spark.createDataFrame([("J", "CVE-1"), ("J", "CVE-12"), ("J", "CVE-1_"), ("P", "CVE-2"), ("P", "CVE-1"), ("J", ""), ("J", None)], "language string, case_key string")
    only = {(r.language, r.case_key): r.folder for r in logs.find_case(keys, folders).collect()}
    assert only == {("J", "CVE-1"): None, ("J", "CVE-12"): "CVE-12_b", ("J", "CVE-1_"): "CVE-1_a", ("P", "CVE-2"): "CVE-2_c", ("P", "CVE-1"): None, ("J", ""): None, ("J", None): None}
    first = {(r.language, r.case_key): r.folder for r in logs.find_case(keys, folders, first=True).collect()}
    assert first == only | {("J", "CVE-1"): "CVE-1", ("J", ""): "CVE-1"}


def test_each_log_is_parsed_once(spark, tmp_path):
    """A second run reads the files that came since the first; equal stems go by the last path, as in ``read_logs``."""
    from wayscore.streaming.logs import ingested

    def put(name, body):
        (tmp_path / "logs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "logs" / name).write_text(body)

    def seen():
        found = ingested(spark, str(tmp_path / "logs"), str(tmp_path / "table"))
        assert sorted(map(str, found.collect())) == sorted(map(str, logs.read_logs(spark, str(tmp_path / "logs")).select(found.columns).collect()))
        return sorted((r.run_id, r.model, r._corrupt is None) for r in found.collect()), spark.read.parquet(str(tmp_path / "table" / "parsed")).count()

    put("x/a.json", '{"model": "m"}')
    put("x/bad.json", "{")
    put("x/exception_b.json", "{}")
    assert seen() == ([("a", "m", True), ("bad", None, False)], 3)
    put("y/a.json", '{"model": "n"}')
    assert seen() == ([("a", "n", True), ("bad", None, False)], 4)
    assert seen()[1] == 4
