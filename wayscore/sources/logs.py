"""Reading run logs, annotated cases and samples; routing; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayscore.functions.text import case_id, fenced, line_list, line_range, needed_files, or_default, output_label, strip

LOG_SCHEMA = """task string, cve string, item_id string, group_key string, sample_id string, source_file string, metadata_file string, metadata string,
file_combination array<string>, needed_files array<string>, prompt_name string, language string, model string, provider string, prompt string, input string,
output string, reasoning_content string, actual_label int, usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>, timestamp string, _corrupt string"""
PATH_FORM = "struct<findings:array<struct<taint_path:array<struct<file:string,lines:string,snippet:string>>>>>"
LINE_FORM = "map<string,struct<vulnerable_lines:string,explanation:string>>"
REAL_FORM = "map<string,array<struct<line_number:int,file_name:string,code_snippet:string,endLine:int>>>"


def require(spark: SparkSession, *paths: str) -> None:
    """Raises FileNotFoundError for the first path that isn't there, on whatever file system."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(f"there is no {path}")


def read_logs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per ``*.json`` log, names with ``exception`` left out; of equal file stems the last path wins."""
    raw = (
        spark.read.schema(LOG_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    return last_of_each(raw.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename")))


def last_of_each(rows: DataFrame) -> DataFrame:
    """Parsed logs by run_id, the file's stem; names with ``exception`` are left out, and of equal stems the last path wins."""
    rows = rows.where(~F.col("filename").contains("exception")).withColumn("run_id", F.regexp_replace("filename", r"\.json$", ""))
    last = Window.partitionBy("run_id").orderBy(F.desc("path"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def normalised(logs: DataFrame) -> DataFrame:
    """Defaults, case ids and the parsed output (as findings or as lines by file)."""
    body = fenced(F.coalesce("output", F.lit("")))
    keys = F.json_object_keys(body)
    path_form, line_form = F.from_json(body, PATH_FORM), F.from_json(body, LINE_FORM)
    has_findings = F.coalesce(F.array_contains(keys, "findings"), F.lit(False))
    lines = F.when(~has_findings, F.transform_values(line_form, lambda _, v: line_list(v["vulnerable_lines"])))
    return logs.withColumns(
        {
            "task": or_default(F.col("task"), "rq1"),
            "prompt": or_default(F.col("prompt_name"), "unknown"),
            "model": or_default(F.col("model"), "unknown"),
            "language": strip(F.coalesce("language", F.lit(""))),
            "case_key": case_id(F.col("cve"), F.col("item_id"), F.col("group_key")),
            "sample_id": strip("sample_id"),
            "needed": needed_files(F.col("needed_files"), F.col("input")),
            "is_object": keys.isNotNull(),
            "has_findings": has_findings,
            "findings": F.coalesce(path_form["findings"], F.expr("cast(array() as array<struct<taint_path:array<struct<file:string,lines:string,snippet:string>>>>)")),
            "lines": lines,
        }
    ).withColumn("output_label", output_label(F.col("findings"), F.col("has_findings"), F.col("lines")))


def find_case(keys: DataFrame, folders: DataFrame, key: str = "case_key", first: bool = False) -> DataFrame:
    """Adds folder: the one folder of the language whose name starts with the key; null where there is none or more than one.

    With ``first``, the first of them by name.  A folder meets keys by its beginnings
    of those lengths that keys have.
    """
    lengths = keys.select("language", F.length(key).alias("_n")).distinct()
    starts = folders.select("language", "folder").join(lengths, "language").where(F.length("folder") >= F.col("_n"))
    found = keys.join(starts.select("language", "folder", F.left("folder", "_n").alias(key)), ["language", key], "left")
    one = found.groupBy(*keys.columns).agg(F.count("folder").alias("_n"), F.min("folder").alias("folder"))
    return one.drop("_n") if first else one.withColumn("folder", F.when(F.col("_n") == 1, F.col("folder"))).drop("_n")


def reason(negative: Column, corrupt: Column, parsed: Column, key: Column, language: Column, folder: Column, loaded: Column, shape: Column) -> Column:
    """Why a log is left out; null for accepted ones."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    kind = F.when(negative, "negative").otherwise("rq1")
    why = (
        F.when(blank(key), F.concat(kind, F.lit(":no_id")))
        .when(blank(language), F.concat(kind, F.lit(":no_language")))
        .when(folder.isNull(), F.concat(kind, F.lit(":unmapped")))
        .when(~F.coalesce(loaded, F.lit(False)), F.concat(kind, F.lit(":load_error")))
        .when(~negative & ~F.coalesce(shape, F.lit(False)), F.concat(kind, F.lit(":unsupported")))
    )
    return F.when(corrupt, "load_failure").when(~F.coalesce(parsed, F.lit(False)), "bad_output").otherwise(why)


def routed(logs: DataFrame, cases: DataFrame, samples: DataFrame) -> DataFrame:
    """Normalised logs with folder and reason; cases and samples: (language, folder, loaded)."""
    rows = normalised(logs).withColumn("negative", F.col("task") == "negative").withColumn("key", F.when(F.col("negative"), F.col("sample_id")).otherwise(F.col("case_key")))
    keys = rows.where("not negative").select("language", "case_key").distinct()
    mapped = find_case(keys, cases).join(cases, ["language", "folder"], "left").select("language", F.col("case_key").alias("key"), "folder", "loaded", F.lit(False).alias("negative"))
    plain = samples.select("language", F.col("folder").alias("key"), "folder", "loaded", F.lit(True).alias("negative"))
    out = rows.join(mapped.unionByName(plain), ["language", "key", "negative"], "left")
    shape = F.col("has_findings") | F.col("lines").isNotNull()
    return out.withColumn("reason", reason(F.col("negative"), F.col("_corrupt").isNotNull(), F.col("is_object"), F.col("key"), F.col("language"), F.col("folder"), F.col("loaded"), shape))


def pred_nodes(runs: DataFrame) -> DataFrame:
    """Nodes of predicted paths whose lines are a readable ``a-b``; their numbers stay those of the output."""
    ops = runs.select("run_id", F.posexplode("findings").alias("op_idx", "f"))
    nodes = ops.select("run_id", "op_idx", F.posexplode("f.taint_path").alias("node_idx", "n"))
    start, end = line_range(F.col("n.lines"))
    return nodes.select("run_id", "op_idx", "node_idx", F.col("n.file").alias("file"), start.alias("start_line"), end.alias("end_line")).where("start_line is not null")


def pred_lines(runs: DataFrame) -> DataFrame:
    """Reported lines of the by-file form that are numbers."""
    files = runs.select("run_id", F.explode("lines").alias("file", "ls"))
    return files.select("run_id", "file", F.explode("ls").alias("l")).select("run_id", "file", F.col("l").try_cast("int").alias("line")).where("line is not null")


def read_json_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, folder, language, content) of every file called ``name`` below ``path``/<language>/<folder>/."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = rows.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"), parts.alias("_p"))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    at = F.array_position("_p", root).cast("int")
    return rows.select("path", "content", F.get("_p", at).alias("language"), F.get("_p", at + 1).alias("folder"))


def real_nodes(files: DataFrame) -> DataFrame:
    """Reference nodes of annotated-path files (folder, content): the order of paths and nodes is kept, of repeated path keys the last stays."""
    paths = files.select(F.col("folder").alias("case_id"), F.from_json("content", REAL_FORM).alias("m"))
    rows = paths.select("case_id", F.posexplode(F.map_entries("m")).alias("path_ord", "e")).select("case_id", "path_ord", F.col("e.key").alias("path_hash"), F.col("e.value").alias("nodes"))
    last = Window.partitionBy("case_id", "path_hash").orderBy(F.desc("path_ord"))
    rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    nodes = rows.select("case_id", "path_ord", "path_hash", F.posexplode("nodes").alias("node_idx", "n"))
    return nodes.select(
        "case_id", "path_ord", "path_hash", "node_idx", F.col("n.file_name").alias("file"), F.col("n.line_number").alias("start_line"), F.coalesce("n.endLine", "n.line_number").alias("end_line")
    )


def combinations(files: DataFrame) -> DataFrame:
    """File combinations (folder, content) -> case_id, combo, files; rows without a list of lists vanish."""
    parsed = F.from_json("content", "struct<files:array<array<string>>>")["files"]
    return files.select(F.col("folder").alias("case_id"), F.posexplode(parsed).alias("combo", "files"))


def case_folders(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(language, folder) of all folders two levels below ``path``, from the files' paths."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.split(F.col("path"), "/").alias("p"))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    at = F.array_position("p", root).cast("int")
    out = rows.select(F.get("p", at).alias("language"), F.get("p", at + 1).alias("folder")).where("folder is not null")
    return out.where(F.col("folder").startswith(prefix)).distinct().orderBy("language", "folder")


def sample_files(spark: SparkSession, path: str) -> DataFrame:
    """Per sample folder: its metadata file (its own name first, else the first ``*.json``), first source and all sources by name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.split(F.col("path"), "/").alias("p"))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    at = F.array_position("p", root).cast("int")
    rows = rows.select("path", F.get("p", at).alias("language"), F.get("p", at + 1).alias("folder"), F.element_at("p", -1).alias("name"))
    meta, source = F.col("name").endswith(".json"), F.col("name").rlike(r"\.(py|java)$")
    own = F.col("name") == F.concat("folder", F.lit(".json"))
    made = rows.groupBy("language", "folder").agg(
        F.min_by("path", F.when(meta, F.struct((~own).alias("o"), F.col("name").alias("n")))).alias("metadata_file"),
        F.min(F.when(source, F.col("name"))).alias("source_file"),
        F.sort_array(F.collect_list(F.when(source, F.col("name")))).alias("sources"),
    )
    return made.where("source_file is not null")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header; small tables come as one part, large ones are written by many tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    stamped = df.withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))) if "timestamp" in df.columns else df
    stamped.write.mode("overwrite").json(path)


def _write_lines(body: DataFrame, opening: str, closing: str, path: str) -> None:
    """Rows (key, value) in order of key as text parts, between an opening and a closing line; the parts in order of their names are the text."""
    ends = body.sparkSession.createDataFrame([(0, "", opening), (2, "", closing)], "part int, key string, value string")
    lines = body.select(F.lit(1).alias("part"), "key", "value").unionByName(ends)
    lines.orderBy("part", "key").select("value").write.mode("overwrite").text(path)


def write_script(df: DataFrame, name: str, path: str) -> None:
    """``window.<name> = [<rows as JSON, one a line>];`` for the viewer, in ordered parts."""
    row = F.to_json(F.struct(*df.columns))
    _write_lines(df.select(row.alias("key"), F.concat(row, F.lit(",")).alias("value")), f"window.{name} = [", "];", path)


def write_object_script(df: DataFrame, name: str, path: str) -> None:
    """``window.<name> = {<key: entry, one a line>};`` of rows (key, entry), entries being JSON, in ordered parts."""
    quoted = F.regexp_extract(F.to_json(F.array("key")), r"(?s)^\[(.*)\]$", 1)
    _write_lines(df.select("key", F.concat(quoted, F.lit(": "), "entry", F.lit(",")).alias("value")), f"window.{name} = {{", "};", path)


def write_catalog_script(cases: DataFrame, summary: DataFrame, name: str, source: str, path: str) -> None:
    """``window.<name> = {generated_from, summary, cves: [<one case a line>]};``, cases in order of id, language and folder, in ordered parts."""
    head = summary.select(F.lit(source).alias("generated_from"), F.struct(*summary.columns).alias("summary"))
    opening = head.select(F.to_json(F.struct(*head.columns))).first()[0]
    body = cases.select(F.concat_ws("\x01", "id", "language", "dir_name").alias("key"), F.concat(F.to_json(F.struct(*cases.columns), {"ignoreNullFields": "false"}), F.lit(",")).alias("value"))
    _write_lines(body, f'window.{name} = {opening[:-1]},"cves":[', "]};", path)
