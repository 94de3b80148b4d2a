"""From folders of run logs and annotated cases to the result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore.functions.text import cwe_values, headed, line_count, prompt_name
from wayscore.operators import best, catalog, nodes, prompts, stats, tables
from wayscore.operators.model import predictive_power
from wayscore.sources import logs, run_logs
from wayscore.streaming.logs import ingested

# Names of the files of a case, below <language>/<case>/annotations/.
PATHS, META, COMBOS = "vulnerable_paths.json", "cve_metadata.json", "input_filenames.json"
FEATURES = ("real_len", "n_files", "input_tokens", "n_lines")
#: Columns of the results that come first, in this order; the rest follow.
FIRST = ("case_key", "run_id", "prompt", "model", "language", "filename", "output_format", "output_label", "actual_label", "nor", "overlap_nodes", "real_len", "out_len", "lcnr", "lcs_len", "lcs_real_len", "lcs_out_len")


@dataclass(frozen=True)
class AnalysisConfig:
    """Folders of an analysis, and what its tables are about."""

    logs: str
    cases: str
    samples: str | None
    out: str
    model: str
    models: tuple[str, ...] = ()
    thresholds: tuple[float, ...] = stats.THRESHOLDS
    features: tuple[str, ...] = FEATURES
    targets: tuple[int, ...] = (22, 20, 94, 502)
    recursive: bool = True
    #: Keep the parsed logs below ``out`` and read only files that came since the last run; logs that were deleted stay.
    incremental: bool = False

    def __post_init__(self):
        if not (self.logs and self.cases and self.out and self.model):
            raise ValueError("logs, cases, out and model must be given")
        if not self.thresholds:
            raise ValueError("give at least one threshold")


def case_id(language: str = "language", folder: str = "folder") -> F.Column:
    return F.concat_ws("/", language, folder)


def case_files(spark: SparkSession, path: str) -> DataFrame:
    """(language, folder, paths, meta, combos): the contents of the three annotation files of each case, null where one is missing."""
    found = None
    for name, column in ((PATHS, "paths"), (META, "meta"), (COMBOS, "combos")):
        rows = logs.read_json_files(spark, path, name).groupBy("language", "folder").agg(F.min_by("content", "path").alias(column))
        found = rows if found is None else found.join(rows, ["language", "folder"], "full")
    return found


def samples_of(spark: SparkSession, path: str | None) -> DataFrame:
    """(language, folder, loaded, sources, label) of negative samples; label from the sample's metadata file, null where it has none."""
    if path is None:
        return spark.createDataFrame([], "language string, folder string, loaded boolean, sources array<string>, label int")
    files = logs.sample_files(spark, path)
    told = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    told = told.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("_at"), F.get_json_object("value", "$.actual_label").cast("int").alias("label"))
    files = files.withColumn("_at", F.regexp_replace("metadata_file", "^file:/+", "/"))
    return files.join(told, "_at", "left").select("language", "folder", F.lit(True).alias("loaded"), "sources", "label")


def runs_of(spark: SparkSession, config: AnalysisConfig) -> DataFrame:
    """Every log with its routing and the columns of run records."""
    files = case_files(spark, config.cases)
    readable = F.json_object_keys("paths").isNotNull() & F.json_object_keys("meta").isNotNull()
    cases = files.where(F.coalesce(F.col("paths"), F.col("meta")).isNotNull()).select("language", "folder", F.coalesce(readable, F.lit(False)).alias("loaded"))
    samples = samples_of(spark, config.samples)
    found = ingested(spark, config.logs, f"{config.out.rstrip('/')}/_logs", config.recursive) if config.incremental else logs.read_logs(spark, config.logs, config.recursive)
    rows = logs.routed(found, cases, samples.select("language", "folder", "loaded"))
    told = files.select("language", "folder", F.to_json(F.try_variant_get(F.try_parse_json("meta"), "$.cwe_id", "variant")).alias("tags"))
    rows = rows.join(told, ["language", "folder"], "left").join(samples.drop("loaded"), ["language", "folder"], "left")
    actual = F.when(F.col("negative"), F.coalesce("actual_label", "label", F.lit(0))).otherwise(F.coalesce("actual_label", F.lit(1)))
    return rows.select(
        "run_id", "filename", "reason", "negative", "language", "model", "prompt", "findings", "lines", "has_findings", "output_label", "sources",
        F.col("key").alias("case_key"), case_id().alias("case_id"), F.col("needed").alias("needed_files"), F.when(F.col("has_findings"), "path").otherwise("line").alias("output_format"),
        actual.alias("actual_label"), (F.col("output_label") == actual).cast("int").alias("label_correct"), F.size("needed").alias("n_files"), line_count(F.col("input")).alias("n_lines"),
        F.col("usage.input_tokens").alias("input_tokens"), F.col("usage.output_tokens").alias("output_tokens"), cwe_values(F.col("tags")).alias("cwes"),
    )


def line_results(runs: DataFrame, real: DataFrame, pred_lines: DataFrame) -> DataFrame:
    """As ``best.results``, for runs of the by-file form: they have no runs of nodes and no end hits."""
    found = nodes.line_matches(pred_lines, real, runs).groupBy("run_id")
    found = found.agg(F.max_by(F.struct("nor", "overlap_nodes", "real_len", "matched_files"), F.struct("nor", -F.col("path_ord"))).alias("m"))
    lengths = nodes.path_lengths(real).groupBy("case_id").agg(F.median("real_len").alias("real_median"))
    joined = runs.join(lengths, "case_id", "left").join(found, "run_id", "left")
    zero, off = F.lit(0.0), F.lit(False)
    files = F.coalesce("m.matched_files", F.array().cast("array<string>"))
    real_len = F.coalesce(F.col("m.real_len").cast("double"), "real_median", zero)
    return joined.select(
        *runs.columns, F.coalesce("m.nor", zero).alias("nor"), F.coalesce("m.overlap_nodes", F.lit(0)).cast("double").alias("overlap_nodes"), real_len.alias("real_len"), zero.alias("out_len"), zero.alias("lcnr"),
        zero.alias("lcs_len"), real_len.alias("lcs_real_len"), zero.alias("lcs_out_len"), off.alias("source_hit"), off.alias("sink_hit"),
        files.alias("out_files"), F.size(files).cast("bigint").alias("n_out_files"),
    )


def scored_runs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Results of all accepted positive runs, in both output forms; one row per case, prompt and model."""
    real = logs.real_nodes(files.where(F.col("paths").isNotNull()).select(case_id().alias("folder"), F.col("paths").alias("content")))
    good = runs.where("reason is null and not negative")
    plain = [c for c in good.columns if c not in ("findings", "lines", "sources", "has_findings", "reason", "negative")]
    by_path, by_line = good.where("has_findings"), good.where("not has_findings")
    shared = real.drop("path_hash")
    first = best.results(by_path.select(plain), shared, logs.pred_nodes(by_path))
    second = line_results(by_line.select(plain), shared, logs.pred_lines(by_line))
    doubles = {c: F.col(c).cast("double") for c in ("nor", "overlap_nodes", "real_len", "out_len", "lcnr", "lcs_len", "lcs_real_len", "lcs_out_len")}
    both = first.withColumns(doubles).unionByName(second.withColumns(doubles))
    kept = best.one_per_group(both, ["case_key", "prompt", "model"], ["run_id"])
    return kept.select(*FIRST, *(c for c in kept.columns if c not in FIRST))


def result_tables(spark: SparkSession, config: AnalysisConfig) -> dict[str, DataFrame]:
    """All tables by name; a table whose rows are missing is empty.

    Logs are parsed once: the routed runs are stored as ``_runs`` below
    ``config.out``, the scored ones as ``_scored``, and the tables made from those.
    """

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{config.out.rstrip('/')}/{name}")
        return spark.read.schema(df.schema).parquet(f"{config.out.rstrip('/')}/{name}")

    runs = stored(runs_of(spark, config), "_runs")
    scored = stored(scored_runs(runs, case_files(spark, config.cases)), "_scored")
    one = scored.where((F.col("model") == config.model) & (F.col("prompt") == "llmpath"))
    negative = runs.where("reason is null and negative").drop("findings", "lines")
    features = list(config.features)
    labels = lambda df: df.select("model", prompt_name(F.col("prompt")).alias("prompt"), F.col("actual_label").alias("actual"), F.col("output_label").alias("predicted"))
    models = list(config.models) or [config.model]
    judged = labels(tables.single_file_positives(scored, models)).unionByName(labels(negative.where(F.col("model").isin(models))))
    return {
        "results": scored,
        "model_summary": tables.model_summary(scored),
        "best_model": one,
        "weakness_table": tables.weakness_table(one, config.targets),
        "threshold_tests": stats.presented(stats.all_tests(one, features, config.thresholds, "nor"), config.thresholds, stats.LABELS),
        "predictive_power": predictive_power(one, features, config.thresholds, "nor"),
        "negative_results": negative.select("case_key", "run_id", "prompt", "model", "language", "filename", "output_label", "actual_label", "label_correct", "input_tokens", "output_tokens", "n_files", "n_lines", "needed_files", "sources"),
        "prompt_comparison": tables.prompt_comparison(judged, "LLMPath", models, ["LLMPath", "Baseline"]),
        "excluded": runs.where("reason is not null").select("filename", "reason"),
    }


def flat(df: DataFrame) -> DataFrame:
    """Lists as text, so that a table can be written as CSV."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ";") for c, kind in df.dtypes if kind.startswith("array")})


def analyse(spark: SparkSession, config: AnalysisConfig) -> list[str]:
    """Writes every table as CSV below ``config.out``; returns their names.  The table of tests starts with a byte-order mark, for spreadsheets."""
    logs.require(spark, config.logs, config.cases, *([config.samples] if config.samples else []))
    made = result_tables(spark, config)
    for name, df in made.items():
        df = flat(df)
        logs.write_csv(df.withColumnRenamed("feature", "﻿feature") if name == "threshold_tests" else df, f"{config.out.rstrip('/')}/{name}")
    return sorted(made)


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, path, content) of the source texts of all cases, by their paths below <language>/<case>/source/."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{java,py}").text(path, wholetext=True)
    at = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)/source/(.+)$", 1)
    return rows.select(at.alias("case_id"), F.regexp_extract(F.col("_metadata.file_path"), r"/source/(.+)$", 1).alias("path"), F.col("value").alias("content")).where("path <> ''")


def case_prompts(spark: SparkSession, config: prompts.RunConfig, cases: str, templates: DataFrame) -> DataFrame:
    """The prompts of the chosen cases: every combination of files with every template."""
    files = case_files(spark, cases).where(F.col("combos").isNotNull())
    chosen = config.targets(files.withColumn("case_id", F.col("folder"))).select(F.concat_ws("/", "language", "folder").alias("folder"), "language", F.col("combos").alias("content"))
    inputs = prompts.prompt_inputs(logs.combinations(chosen), source_files(spark, cases))
    return prompts.prompt_frame(inputs.join(chosen.select(F.col("folder").alias("case_id"), "language"), "case_id"), templates)


def sample_prompts(spark: SparkSession, config: prompts.RunConfig, samples: str, templates: DataFrame) -> DataFrame:
    """The prompts of negative samples: the first source of each with every template; ``about`` tells its files and metadata."""
    chosen = config.targets(logs.sample_files(spark, samples).withColumn("case_id", F.col("folder")))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    texts = spark.read.option("recursiveFileLookup", True).text(samples, wholetext=True)
    texts = texts.select(plain(F.col("_metadata.file_path")).alias("at"), "value")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    source = texts.where(F.col("at").rlike(r"\.(py|java)$")).select(F.element_at(F.split("at", "/"), -3).alias("language"), F.element_at(F.split("at", "/"), -2).alias("folder"), name("at").alias("source_file"), F.col("value").alias("content"))
    told = texts.select("at", F.try_parse_json("value").alias("metadata"))
    rows = chosen.join(source, ["language", "folder", "source_file"]).withColumn("at", plain("metadata_file")).join(told, "at", "left")
    about = F.struct("source_file", name("metadata_file").alias("metadata_file"), "metadata")
    inputs = rows.select(F.col("folder").alias("subject"), F.lit(0).alias("combo"), "language", headed(F.col("source_file"), F.col("content")).alias("input"), about.alias("about"))
    return prompts.prompt_frame(inputs, templates)


def run_prompts(spark: SparkSession, config: prompts.RunConfig, data: str, templates: DataFrame, responder, out: str, model: str, provider: str = "", waves: int = 1) -> int:
    """Runs the prompts of the chosen cases, or of the negative samples, below ``data`` and logs the answers below ``out``; returns how many calls were due."""
    logs.require(spark, data)
    if templates.isEmpty():
        raise ValueError("no prompts were found")
    if config.negative:
        asked = sample_prompts(spark, config, data, templates)
    else:
        made = case_prompts(spark, config, data, templates)
        files = case_files(spark, data).where(F.col("combos").isNotNull()).select(F.concat_ws("/", "language", "folder").alias("folder"), F.col("combos").alias("content"))
        made = made.join(logs.combinations(files), ["case_id", "combo"])
        subject = F.split_part(F.element_at(F.split("case_id", "/"), -1), F.lit("_"), F.lit(1))
        asked = made.select(subject.alias("subject"), "combo", "language", "prompt", "prompt_text", "input", F.struct(F.col("files").alias("file_combination")).alias("about"))
        if config.case is not None:
            asked = asked.where(F.col("subject") == config.case.split("_")[0])
    if asked.isEmpty():
        raise ValueError(f"nothing to run below {data} for {', '.join(config.languages)}")
    return run_logs.run(asked, responder, out, model, provider, 0 if config.negative else 1, "negative" if config.negative else "rq1", waves)


def viewer(spark: SparkSession, cases: str) -> DataFrame:
    """The catalog of cases that have all three annotation files."""
    files = case_files(spark, cases).where("paths is not null and meta is not null and combos is not null").withColumn("case_id", case_id())
    real = logs.real_nodes(files.select(F.col("case_id").alias("folder"), F.col("paths").alias("content"))).drop("path_hash")
    told = files.select("case_id", "language", F.get_json_object("meta", "$.cve_id").alias("name"), F.get_json_object("meta", "$.project").alias("project"), F.get_json_object("meta", "$.html_url").alias("commit"))
    return catalog.catalog(told, real)
