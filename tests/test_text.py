from pyspark.sql import functions as F

from wayscore.functions import numeric, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_fences(spark):
    assert one(spark, 'a ```json\n{"k": 1}\n``` b ```{}```', text.fenced) == '{"k": 1}'
    assert one(spark, '```json {"k": 2}', text.fenced) == '{"k": 2}'
    assert one(spark, ' {"k": 3} ', text.fenced) == '{"k": 3}'


def test_line_ranges(spark):
    cases = {"3-5": (3, 5), "3": (None, None), "L3-L5": (None, None), "3-5-9": (3, 5), " 3 - 5 ": (3, 5), "5-3": (5, 3), "": (None, None)}
    for raw, expected in cases.items():
        assert one(spark, raw, lambda c: F.struct(*(x.alias(n) for x, n in zip(text.line_range(c), "ab")))) == expected


def test_lines(spark):
    assert one(spark, "a\r\nb c\n", text.line_count) == 3
    assert one(spark, "", text.line_count) == 0
    assert one(spark, None, text.line_count) == 0
    assert one(spark, "x\ny\n", text.numbered) == "L1: x\nL2: y"


def test_ids_and_files(spark):
    assert one(spark, " CVE-1_x:y", text.case_id) == "CVE-1"
    assert one(spark, "===== a.py =====\n..\n===== b.py =====", lambda c: text.needed_files(F.lit(None).cast("array<string>"), c)) == ["a.py", "b.py"]
    assert one(spark, ["CWE-22 cwe_79", "CWE 22"], text.cwe_numbers, "array<string>") == [22, 79]


def test_bins_disagree_at_the_edges(spark):
    assert [one(spark, v, numeric.bin_left, "double") for v in (0.25, 0.75)] == ["partial", "high"]
    assert [one(spark, v, numeric.bin_right, "double") for v in (0.25, 0.75)] == ["low", "partial"]


def test_presentation(spark):
    assert [one(spark, v, numeric.shown_p, "double") for v in (0.5, 1.0, 0.034, None)] == ["0.5", "1", "0.034", ""]
    shown = one(spark, -0.2, lambda c: numeric.shown_effect(c, numeric.cliffs_label(c)), "double")
    assert shown == "0.20 (S)"
    assert one(spark, "x", numeric.number) == 0.0 and one(spark, -1.0, numeric.unsentinel, "double") == 0.0


def test_weakness_values_of_any_shape(spark):
    """Against the recursive statement: a whole number is itself, a list the union of its items, anything else the numbers its text mentions."""
    import json
    import re

    def plainly(v):
        if v is None:
            return set()
        if isinstance(v, int) and not isinstance(v, bool):
            return {v}
        if isinstance(v, list):
            return set().union(*map(plainly, v)) if v else set()
        return {int(n) for n in re.findall(r"cwe[\s\-_]*?(\d+)", str(v), re.I)}

    values = [79, "CWE-89", [79, ["CWE-20"]], None, [], [[[]], [[5, [6, ["cwe_7 CWE 8"]]]]], {"a": "CWE-1", "b": [2, {"c": 3}], "CWE-4": 5}, [{"x": [9]}, 10], -3, 1.5, [2.0, 3e2], 'quote " CWE-11 \\', "é\u2028 CWE-12", [True, "79"], "79"]
    raw = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(98, None), (99, "")]
    got = {r.i: r.found for r in spark.createDataFrame(raw, "i int, raw string").select("i", text.cwe_values(F.col("raw")).alias("found")).collect()}
    assert {i: set(f) for i, f in got.items()} == {i: plainly(v) for i, v in enumerate(values)} | {98: set(), 99: set()}
    assert all(len(f) == len(set(f)) for f in got.values())
