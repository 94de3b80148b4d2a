"""Merging manual analyses, against the statement of the two shapes written in plain Python."""

import json
from pathlib import PurePosixPath

import pytest

from wayscore.__main__ import main
from wayscore.operators import manual


def plainly(files):
    """key: (cve, entry) by the statement, later paths replacing earlier ones."""
    out = {}
    entry = lambda v: isinstance(v, dict) and ("real_path" in v or "output_path" in v)
    for path, content in sorted(files, key=lambda f: PurePosixPath(f[0]).parts):
        try:
            value = json.loads(content)
        except ValueError:
            continue
        if isinstance(value, dict) and all(entry(v) for v in value.values()):
            out.update({k: {"cve": k, **v} for k, v in value.items()})
        elif entry(value):
            key = str(value.get("cve") or value.get("cve_id") or PurePosixPath(path).stem)
            out[key] = {"cve": key, **value}
    return out


FILES = [
    ("m/0.json", '{"CVE-1": {"real_path": [1, {"x": null}]}, "CVE-2": {"output_path": {}, "cve": "other"}, "CVE \\"3\\"": {"real_path": 1.5}}'),
    ("m/b.json", '{"real_path": [], "cve": "CVE-1", "note": "later"}'),
    ("m/a/z.json", '{"real_path": [], "cve": "CVE-2", "from": "a folder"}'),
    ("m/a-b/y.json", '{"output_path": [2], "cve": null, "cve_id": "CVE-2"}'),
    ("m/number.v1.json", '{"output_path": null, "cve": 0, "cve_id": 12}'),
    ("m/stem.v1.json", '{"output_path": [], "cve": "", "cve_id": false}'),
    ("m/true.json", '{"real_path": [], "cve": true}'),
    ("m/empty.json", "{}"),
    ("m/list.json", '[{"real_path": []}]'),
    ("m/mixed.json", '{"real_path": {"real_path": []}, "y": 3}'),
    ("m/nested.json", '{"real_path": {"real_path": []}}'),
    ("m/none.json", '{"k": {"path": []}}'),
    ("m/twice.json", '{"k": {"real_path": 1}, "k": {"real_path": 2, "real_path": 3}}'),
    ("m/broken.json", "{"),
    ("m/text.json", '"real_path"'),
    ("m/blank.json", ""),
]


def merged(spark, files):
    rows = manual.merged(manual.manual_entries(spark.createDataFrame(files, "path string, content string"))).collect()
    return {r.key: json.loads(r.entry) for r in rows}, {r.key: r.cve for r in rows}


def test_both_shapes_and_the_last_path(spark):
    entries, cves = merged(spark, FILES)
    expected = plainly(FILES)
    assert entries == expected and entries["k"] == {"cve": "k", "real_path": 3}
    assert entries["CVE-2"] == {"output_path": [2], "cve": None, "cve_id": "CVE-2"}  # folder by folder, m/a/z comes before m/a-b/y
    assert {k: v for k, v in cves.items() if v is not None} == {k: str(v["cve"]) if v["cve"] is not True else "true" for k, v in expected.items() if v["cve"] is not None}


def test_strict_files_raise(spark):
    one = spark.createDataFrame([("m/x.json", '{"k": 1}')], "path string, content string")
    assert manual.manual_entries(one).count() == 0
    with pytest.raises(Exception, match="not a manual analysis: m/x.json"):
        manual.manual_entries(one, strict=True).collect()


def test_no_files(spark):
    assert merged(spark, []) == ({}, {}) and merged(spark, [("x", None)]) == ({}, {})


def test_scripts_by_command_line(spark, tmp_path):
    for path, content in FILES:
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    main(["manual", "--input", str(tmp_path / "m"), "--out", str(tmp_path / "out")])

    def script(name, variable):
        parts = sorted((tmp_path / "out" / name).glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        head, tail = f"window.{variable} = {{\n", "};\n"
        assert text.startswith(head) and text.endswith(tail)
        return json.loads("{" + text[len(head) : -len(tail)].rstrip().rstrip(",") + "}"), text

    data, text = script("manual_analysis_dataset", "MANUAL_ANALYSIS_DATA")
    assert data == plainly(FILES)
    shown, _ = script("manual_analysis_index", "MANUAL_ANALYSIS_INDEX")
    assert shown == {k: True for k in data} and list(shown) == sorted(data)
