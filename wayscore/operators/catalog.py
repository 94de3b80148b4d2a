"""Viewer catalogs: nested case summaries and last-writer merges of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.functions.text import project_url
from wayscore.functions.variants import field, first_that_says, says


def path_summaries(real: DataFrame) -> DataFrame:
    """Per path: node count, distinct files in order of first appearance, and the nodes."""
    files = real.groupBy("case_id", "path_ord", "file").agg(F.min("node_idx").alias("at")).groupBy("case_id", "path_ord")
    files = files.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("files"))
    nodes = real.groupBy("case_id", "path_ord").agg(F.count("*").alias("node_count"), F.sort_array(F.collect_list(F.struct("node_idx", "file", "start_line", "end_line"))).alias("nodes"))
    return nodes.join(files, ["case_id", "path_ord"])


def catalog(cases: DataFrame, real: DataFrame) -> DataFrame:
    """Cases (case_id, language, ...) with their paths nested, ordered; cases without paths are left out."""
    paths = path_summaries(real).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("path_ord", "node_count", "files", "nodes"))).alias("paths"))
    return cases.join(paths, "case_id").orderBy("case_id")


def totals(cases: DataFrame, real: DataFrame) -> DataFrame:
    """Counts of cases, paths, nodes and distinct languages."""
    per_case = real.groupBy("case_id").agg(F.count_distinct("path_ord").alias("paths"), F.count("*").alias("nodes"))
    both = cases.join(per_case, "case_id")
    return both.agg(F.count("*").alias("cases"), F.sum("paths").alias("paths"), F.sum("nodes").alias("nodes"), F.count_distinct("language").alias("languages"))


def last_writer(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key by ``order``, all columns."""
    whole = F.struct(*records.columns)
    return records.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def _path(key: Column, nodes: Column) -> Column:
    """A path of the catalog: its key, number of nodes, files in order of first appearance, nodes."""
    items = F.coalesce(F.try_variant_get(nodes, "$", "array<variant>"), F.array().cast("array<variant>"))
    names = F.filter(F.transform(items, lambda n: field(n, "file_name", "string")), lambda x: F.coalesce(x != "", F.lit(False)))
    node = lambda n: F.struct(field(n, "line_number").alias("line_number"), field(n, "file_name").alias("file_name"), F.coalesce(field(n, "code_snippet"), F.parse_json(F.lit('""'))).alias("code_snippet"))
    return F.struct(key.alias("hash"), F.size(items).alias("node_count"), F.array_distinct(names).alias("files"), F.transform(items, node).alias("nodes"))


def nested_catalog(files: DataFrame) -> DataFrame:
    """One row a case from its annotation files (language, folder, paths, meta, combos; JSON): what the viewer shows, paths nested in order of their keys.

    Cases without one of the files, or with one that isn't readable, are left out;
    a case without paths stays.  Of a key that a file repeats the last value counts;
    for that the session's ``spark.sql.variant.allowDuplicateKeys`` is set.
    """
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = files.select("language", "folder", *(F.try_parse_json(c).alias(c) for c in ("paths", "meta", "combos"))).where("paths is not null and meta is not null and combos is not null")
    rows = rows.withColumn("paths", F.try_variant_get("paths", "$", "map<string,variant>")).where("paths is not null")
    meta, text = F.col("meta"), lambda name: field(F.col("meta"), name, "string")
    empty = F.parse_json(F.lit("[]"))
    combos = F.coalesce(field(F.col("combos"), "files"), empty)
    listed = F.transform(F.array_sort(F.map_keys("paths")), lambda k: _path(k, F.col("paths")[k]))
    project = F.when(F.schema_of_variant(field(meta, "project")) == "STRING", text("project"))
    return rows.select(
        F.when(says(field(meta, "cve_id")), text("cve_id")).otherwise(F.split_part("folder", F.lit("_"), F.lit(1))).alias("id"), F.col("folder").alias("dir_name"), "language", field(meta, "project").alias("project"),
        project_url(project, text("html_url")).alias("project_url"), first_that_says(field(meta, "html_url"), field(meta, "url")).alias("commit_url"), field(meta, "commit_id").alias("commit_id"),
        F.coalesce(first_that_says(field(meta, "cwe_id")), empty).alias("cwes"), field(meta, "publish_date").alias("publish_date"), field(meta, "cvss").alias("cvss"),
        F.coalesce(first_that_says(field(meta, "cve_description"), field(meta, "details")), F.parse_json(F.lit('""'))).alias("description"),
        F.coalesce(F.size(F.try_variant_get(combos, "$", "array<variant>")), F.lit(0)).alias("file_combo_count"), F.size("paths").alias("path_count"), combos.alias("input_file_combinations"), listed.alias("paths"),
    )


def summary(cases: DataFrame) -> DataFrame:
    """Totals of ``nested_catalog``: cases, paths, nodes and the languages in order."""
    nodes = F.aggregate("paths", F.lit(0).cast("bigint"), lambda s, p: s + p["node_count"])
    per = cases.groupBy("language").agg(F.count("*").alias("n"), F.sum("path_count").alias("paths"), F.sum(nodes).alias("nodes"))
    return per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{t}") for c, t in (("n", "cves"), ("paths", "paths"), ("nodes", "nodes"))), F.sort_array(F.collect_list("language")).alias("languages"))
