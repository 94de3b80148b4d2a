"""The viewer's dataset from a folder of cases, against a catalog written by hand."""

import json

from wayscore.__main__ import main


def test_dataset_script(spark, tmp_path):
    def put(case, **files):
        for name, body in files.items():
            at = tmp_path / "cases" / case / "annotations" / {"paths": "vulnerable_paths.json", "meta": "cve_metadata.json", "combos": "input_filenames.json"}[name]
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(body if isinstance(body, str) else json.dumps(body))

    node = lambda line, file, **more: {"line_number": line, "file_name": file, **more}
    put("Java/CVE-2_b", paths={"z": [node(3, "f.java", code_snippet="x"), node(4, "", code_snippet=None), node(5, "g.java"), node(6, "f.java")], "a": []}, meta={"cve_id": "CVE-2", "project": "o/p", "html_url": "", "url": "u", "cwe_id": ["CWE-22", 20], "cvss": 7.5, "publish_date": "2020", "details": "told"}, combos={"files": [["f.java"], ["f.java", "g.java"]]})
    put("Python/CVE-1_a_x", paths={}, meta={"html_url": "https://github.com/q/r/commit/9", "project": 5, "cwe_id": None, "cve_description": "", "commit_id": "9"}, combos=[])
    put("Java/CVE-3_c", paths={"k": [node(1, None)]}, meta={"cve_id": "CVE-3"}, combos={"files": None})
    put("Java/CVE-4_d", paths={"k": []}, meta={})  # a file is missing
    put("Java/CVE-5_e", paths="{", meta={}, combos={})  # not readable
    main(["dataset", "--cases", str(tmp_path / "cases"), "--name", "SHOWN", "--out", str(tmp_path / "out")])
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.startswith("window.SHOWN = {") and text.endswith("]};\n")
    made = json.loads(text.removeprefix("window.SHOWN = ").removesuffix(",\n]};\n") + "]}")
    bare = {"project_url": None, "project": None, "commit_url": None, "commit_id": None, "publish_date": None, "cvss": None, "description": "", "cwes": []}
    whole = [
        bare | {"id": "CVE-1", "dir_name": "CVE-1_a_x", "language": "Python", "project": 5, "project_url": "https://github.com/q/r", "commit_url": "https://github.com/q/r/commit/9", "commit_id": "9", "file_combo_count": 0, "path_count": 0, "input_file_combinations": [], "paths": []},
        bare | {
            "id": "CVE-2", "dir_name": "CVE-2_b", "language": "Java", "project": "o/p", "project_url": "https://github.com/o/p", "commit_url": "u", "cwes": ["CWE-22", 20], "cvss": 7.5, "publish_date": "2020", "description": "told",
            "file_combo_count": 2, "path_count": 2, "input_file_combinations": [["f.java"], ["f.java", "g.java"]],
            "paths": [{"hash": "a", "node_count": 0, "files": [], "nodes": []}, {"hash": "z", "node_count": 4, "files": ["f.java", "g.java"], "nodes": [node(3, "f.java", code_snippet="x"), node(4, "", code_snippet=None), node(5, "g.java", code_snippet=""), node(6, "f.java", code_snippet="")]}],
        },
        bare | {"id": "CVE-3", "dir_name": "CVE-3_c", "language": "Java", "file_combo_count": 0, "path_count": 1, "input_file_combinations": None, "paths": [{"hash": "k", "node_count": 1, "files": [], "nodes": [node(1, None, code_snippet="")]}]},
    ]
    assert made["cves"] == whole
    assert made["generated_from"] == str(tmp_path / "cases")
    assert made["summary"] == {"total_cves": 3, "total_paths": 3, "total_nodes": 5, "languages": ["Java", "Python"]}
