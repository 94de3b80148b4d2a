"""Manual analyses: JSON files of two shapes, merged into one record a key.

A file is one entry, or an object whose every value is an entry; an entry is an
object with ``real_path`` or ``output_path``.  Contents are read as VARIANT, so
entries keep whatever else they hold; the order of their fields isn't kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore.functions.variants import field, says, shown

ENTRY = "struct<key:string,cve:string,entry:string>"


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a JSON file, or of every ``*.json`` below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def is_entry(value: Column) -> Column:
    """Whether a VARIANT is an object with one of the two paths; a path that is null counts as given."""
    return F.coalesce(field(value, "real_path").isNotNull() | field(value, "output_path").isNotNull(), F.lit(False))


def _told(value: Column, name: str) -> Column:
    """A field as text, null where it is missing or says nothing."""
    found = field(value, name)
    text = shown(found)
    return F.when(says(found), F.when(F.schema_of_variant(found) == "BOOLEAN", F.initcap(text)).otherwise(text))


def _entry(key: Column, value: Column) -> Column:
    """An entry under its key; without a ``cve`` of its own it gets the key."""
    quoted = F.regexp_extract(F.to_json(F.array(key)), r"(?s)^\[(.*)\]$", 1)
    body = F.to_json(value)
    own = field(value, "cve")
    filled = F.when(own.isNotNull(), body).otherwise(F.concat(F.lit('{"cve":'), quoted, F.lit(","), F.substr(body, F.lit(2))))
    cve = F.when(own.isNull(), key).otherwise(shown(own))
    return F.struct(key.alias("key"), cve.alias("cve"), filled.alias("entry"))


def manual_entries(files: DataFrame, strict: bool = False) -> DataFrame:
    """The entries of every file (path, content): path, key, cve, entry (JSON).

    In an object of entries the names are the keys.  A single entry's key is its
    ``cve``, else its ``cve_id``, else the file's name less its ending.  Unreadable
    files and those of another shape are left out, or an error if ``strict``; an
    empty object has no entries.  Of a name that an object repeats the last
    value counts; for that the session's ``spark.sql.variant.allowDuplicateKeys`` is set.
    """
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    value = F.col("_v")
    rows = files.select("path", F.try_parse_json("content").alias("_v")).withColumn("_m", F.try_variant_get(value, "$", "map<string,variant>"))
    many = F.forall(F.map_values("_m"), is_entry)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?s)(?<=.)\.[^.]*$", "")
    key = F.coalesce(_told(value, "cve"), _told(value, "cve_id"), stem)
    listed = F.transform(F.map_entries("_m"), lambda e: _entry(e["key"], e["value"]))
    other = F.raise_error(F.concat(F.lit("not a manual analysis: "), F.col("path"))).cast(f"array<{ENTRY}>") if strict else F.lit(None).cast(f"array<{ENTRY}>")
    found = F.when(F.col("_m").isNotNull() & many, listed).when(is_entry(value), F.array(_entry(key, value))).otherwise(other)
    return rows.select("path", F.explode(found).alias("_e")).select("path", "_e.*")


def merged(entries: DataFrame) -> DataFrame:
    """One row a key: the entry of the last path, folder by folder."""
    last = F.max_by(F.struct("path", "cve", "entry"), F.split("path", "/"))
    return entries.groupBy("key").agg(last.alias("_l")).select("key", "_l.*")


def index(entries: DataFrame) -> DataFrame:
    """(key, entry) of all keys, with true for an entry."""
    return entries.select("key").distinct().withColumn("entry", F.lit("true"))
