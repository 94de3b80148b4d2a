"""Command lines: ``python -m wayscore analyse | prompts | catalog | dataset | run | manual``."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wayscore", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("analyse", help="result tables from run logs")
    a.add_argument("--logs", required=True)
    a.add_argument("--cases", required=True)
    a.add_argument("--samples")
    a.add_argument("--out", required=True)
    a.add_argument("--model", required=True, help="the model that the detailed tables are about")
    a.add_argument("--models", nargs="*", default=[], help="models of the prompt comparison")
    a.add_argument("--thresholds", nargs="*", type=float, default=[0.25, 0.5, 0.75, 1.0])
    a.add_argument("--targets", nargs="*", type=int, default=[22, 20, 94, 502])
    a.add_argument("--no-recursive", action="store_true")
    a.add_argument("--incremental", action="store_true", help="parse only logs that came since the last run")
    b = verbs.add_parser("prompts", help="prompts of the cases, as JSON")
    b.add_argument("--cases", required=True)
    b.add_argument("--templates", required=True, help="folder of prompt files")
    b.add_argument("--mode", help="the one template to take")
    b.add_argument("--case", help="the one case to take")
    b.add_argument("--out", required=True)
    c = verbs.add_parser("catalog", help="script for the viewer")
    c.add_argument("--cases", required=True)
    c.add_argument("--name", default="catalog")
    c.add_argument("--out", required=True)
    v = verbs.add_parser("dataset", help="script of the whole dataset for the viewer, with its totals")
    v.add_argument("--cases", required=True)
    v.add_argument("--name", default="DATASET")
    v.add_argument("--out", required=True)
    r = verbs.add_parser("run", help="run prompts and log the answers")
    r.add_argument("--data", required=True, help="folder of the cases, or of the negative samples")
    r.add_argument("--negative", action="store_true", help="the data are negative samples")
    r.add_argument("--templates", required=True, help="folder of prompt files")
    r.add_argument("--mode", default="all", help="the one template to take")
    r.add_argument("--case", help="the one case to take")
    r.add_argument("--responder", required=True, help="module:function that answers (prompt, input)")
    r.add_argument("--model", required=True)
    r.add_argument("--provider", default="")
    r.add_argument("--waves", type=int, default=1, help="parts that are committed one by one")
    r.add_argument("--out", required=True)
    d = verbs.add_parser("manual", help="scripts of the manual analyses for the viewer")
    d.add_argument("--input", required=True, help="a JSON file, or a folder of them")
    d.add_argument("--strict", action="store_true", help="a file of another shape is an error")
    d.add_argument("--out", required=True)
    return top


def main(words: list[str] | None = None) -> None:
    from wayscore.operators import catalog, manual
    from wayscore.operators.prompts import RunConfig, load_prompts
    from wayscore.plans import analysis
    from wayscore.sources import logs

    told = parser().parse_args(words)
    spark = SparkSession.builder.appName("wayscore").getOrCreate()
    if told.verb == "analyse":
        config = analysis.AnalysisConfig(told.logs, told.cases, told.samples, told.out, told.model, tuple(told.models), tuple(told.thresholds), targets=tuple(told.targets), recursive=not told.no_recursive, incremental=told.incremental)
        print(*analysis.analyse(spark, config), sep="\n")
    elif told.verb == "prompts":
        config = RunConfig(case=told.case, all_cases=told.case is None)
        logs.write_json(analysis.case_prompts(spark, config, told.cases, load_prompts(spark, told.templates, told.mode)), told.out)
    elif told.verb == "dataset":
        cases = catalog.nested_catalog(analysis.case_files(spark, told.cases))
        logs.write_catalog_script(cases, catalog.summary(cases), told.name, told.cases, told.out)
    elif told.verb == "run":
        module, _, function = told.responder.partition(":")
        config = RunConfig(case=told.case, all_cases=not told.negative and told.case is None, negative=told.negative)
        print(analysis.run_prompts(spark, config, told.data, load_prompts(spark, told.templates, told.mode), getattr(importlib.import_module(module), function), told.out, told.model, told.provider, told.waves))
    elif told.verb == "manual":
        entries = manual.merged(manual.manual_entries(manual.read_manual(spark, told.input), told.strict))
        logs.write_object_script(entries, "MANUAL_ANALYSIS_DATA", f"{told.out}/manual_analysis_dataset")
        logs.write_object_script(manual.index(entries), "MANUAL_ANALYSIS_INDEX", f"{told.out}/manual_analysis_index")
    else:
        logs.write_script(analysis.viewer(spark, told.cases), told.name, told.out)


if __name__ == "__main__":
    main()
