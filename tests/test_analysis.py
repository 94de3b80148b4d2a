"""From a folder of logs to all tables, through the command line."""

import json

import pytest

from wayscore.__main__ import main, parser
from wayscore.operators import stats
from wayscore.plans import analysis


@pytest.fixture
def folders(tmp_path):
    def put(path, body):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body if isinstance(body, str) else json.dumps(body))

    node = lambda line, file="A.java": {"line_number": line, "file_name": file, "code_snippet": ""}
    for case, cwe in (("CVE-1_x", ["CWE-22"]), ("CVE-2_y", ["CWE-20", "CWE-94"]), ("CVE-3_z", [])):
        home = f"cases/Java/{case}/annotations"
        put(f"{home}/vulnerable_paths.json", {"h": [node(3), node(5), node(9), node(12)]})
        put(f"{home}/cve_metadata.json", {"cve_id": case[:5], "cwe_id": cwe, "project": "o/p"})
        if case != "CVE-3_z":
            put(f"{home}/input_filenames.json", {"files": [["A.java"], ["A.java", "sub/B.java"]]})
        put(f"cases/Java/{case}/source/A.java", "class A {\n}\n")
        put(f"cases/Java/{case}/source/sub/B.java", "class B {}")
    put("samples/Python/file_1/file_1.json", {"actual_label": 0})
    put("samples/Python/file_1/a.py", "x = 1")
    step = lambda lines: {"file": "A.java", "lines": lines, "snippet": ""}
    outputs = {"none": [], "half": [step("3-3"), step("5-6")], "all": [step("3-5"), step("9-9"), step("12-12")], "quarter": [step("12-14")]}
    n = 0
    for case in ("CVE-1", "CVE-2", "CVE-3"):
        for prompt, model, kind in (("llmpath", "m1", "half"), ("llmpath", "m1", "none"), ("baseline", "m1", "quarter"), ("llmpath", "m2", "all")):
            kind = {"CVE-2": "all", "CVE-3": "none"}.get(case, kind) if model == "m1" else kind
            n += 1
            shown = "===== A.java =====\nL1: x" + "\nmore" * n
            put(f"logs/r{n}.json", {"cve": case, "language": "Java", "model": model, "prompt_name": prompt, "input": shown, "output": json.dumps({"findings": [{"taint_path": outputs[kind]}] if outputs[kind] else []}), "usage": {"input_tokens": 100 + n * n, "output_tokens": 5}})
    put("logs/line.json", {"cve": "CVE-1", "language": "Java", "model": "m3", "prompt_name": "llmpath", "input": "", "output": json.dumps({"A.java": {"vulnerable_lines": [3, "9"]}})})
    for k, label in ((1, []), (2, [{"taint_path": [step("1-1")]}])):
        put(f"logs/neg{k}.json", {"task": "negative", "sample_id": "file_1", "language": "Python", "model": "m1", "prompt_name": "Baseline" if k == 1 else "llmpath", "input": "===== a.py =====\nx", "output": json.dumps({"findings": label})})
    put("logs/bad.json", "{")
    put("prompts/llmpath.txt", "Trace $_LANGUAGE")
    return tmp_path


def test_logs_become_all_tables(spark, folders, capsys):
    main(["analyse", "--logs", f"{folders}/logs", "--cases", f"{folders}/cases", "--samples", f"{folders}/samples", "--out", f"{folders}/out", "--model", "m1", "--models", "m1"])
    read = lambda name: spark.read.option("header", True).csv(f"{folders}/out/{name}").collect()
    assert capsys.readouterr().out.split() == sorted(p.name for p in (folders / "out").iterdir() if p.name[0] != "_")
    results = {(r.case_key, r.prompt, r.model): r for r in read("results")}
    assert len(results) == 10 and list(results["CVE-1", "llmpath", "m1"].asDict())[: len(analysis.FIRST)] == list(analysis.FIRST)
    one = results["CVE-1", "llmpath", "m1"]
    assert (one.nor, one.lcnr, one.source_hit, one.sink_hit, one.cwes, one.needed_files, one.n_files) == ("0.5", "0.5", "true", "false", "22", "A.java", "1")
    assert results["CVE-1", "llmpath", "m2"].nor == "1.0" and results["CVE-3", "llmpath", "m1"].nor == "0.0"
    assert (one.out_files, one.n_out_files) == ("A.java", "1") and results["CVE-3", "llmpath", "m1"].n_out_files == "0"
    by_line = results["CVE-1", "llmpath", "m3"]
    assert (by_line.out_files, by_line.n_out_files) == ("A.java", "1")
    assert (by_line.output_format, by_line.nor, by_line.lcnr, by_line.output_label) == ("line", "0.5", "0.0", "1")
    assert {r.model: (r.median_nor, r.runs) for r in read("model_summary")} == {"m1": ("0.5", "3"), "m2": ("1.0", "3"), "m3": ("0.5", "1")}
    assert len(read("best_model")) == 3 and {r.measure for r in read("weakness_table")} == {"median_nor", "median_lcnr", "source_rate", "sink_rate"}
    assert {r.feature for r in read("threshold_tests")} == {stats.LABELS[f] for f in analysis.FEATURES}  # the reader takes the mark away
    assert next((folders / "out" / "threshold_tests").glob("part-*")).read_bytes().startswith("\ufefffeature".encode())
    assert len(read("predictive_power")) == 4
    negative = {r.run_id: r for r in read("negative_results")}
    assert {k: (r.output_label, r.actual_label, r.label_correct, r.sources) for k, r in negative.items()} == {"neg1": ("0", "0", "1", "a.py"), "neg2": ("1", "0", "0", "a.py")}
    compared = {r.prompt: r for r in read("prompt_comparison")}
    assert (compared["LLMPath"].fp, compared["Baseline"].fp, compared["Baseline"].delta_fp) == ("1", "0", "1")
    assert [(r.filename, r.reason) for r in read("excluded")] == [("bad.json", "load_failure")]


def test_prompts_and_catalog(spark, folders):
    main(["prompts", "--cases", f"{folders}/cases", "--templates", f"{folders}/prompts", "--out", f"{folders}/asked"])
    asked = spark.read.json(f"{folders}/asked").collect()
    assert len(asked) == 4 and {r.prompt_text for r in asked} == {"Trace Java"}
    assert any(r.input == "===== A.java =====\nL1: class A {\nL2: }\n\n===== sub/B.java =====\nL1: class B {}" for r in asked)
    main(["catalog", "--cases", f"{folders}/cases", "--name", "shown", "--out", f"{folders}/view"])
    script = "".join(p.read_text() for p in (folders / "view").glob("part-*"))
    assert script.startswith("window.shown = [") and script.count('"case_id"') == 2


def test_folders_are_checked(spark, folders):
    words = ["analyse", "--logs", f"{folders}/nowhere", "--cases", f"{folders}/cases", "--out", f"{folders}/out", "--model", "m1"]
    with pytest.raises(FileNotFoundError, match="nowhere"):
        main(words)
    with pytest.raises(FileNotFoundError, match="gone"):
        main([*words[:2], f"{folders}/logs", *words[3:], "--samples", f"{folders}/gone"])


def test_words_are_checked():
    with pytest.raises(SystemExit):
        parser().parse_args(["analyse", "--logs", "x"])
    with pytest.raises(ValueError):
        analysis.AnalysisConfig("l", "c", None, "o", "m", thresholds=())
