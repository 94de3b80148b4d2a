"""Prompt frames: file sections, templates by language, and a replaceable responder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore.functions.text import headed

LANGUAGE_MARK = "$_LANGUAGE"


@dataclass(frozen=True)
class RunConfig:
    """What to run: one case or all of them, on positive or on negative samples."""

    case: str | None = None
    all_cases: bool = False
    negative: bool = False
    prompts: tuple[str, ...] = ("llmpath", "baseline")
    languages: tuple[str, ...] = ("Java", "Python")
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.negative and (self.case or self.all_cases):
            raise ValueError("negative samples take no case")
        if not self.negative and bool(self.case) == self.all_cases:
            raise ValueError("give one case or all of them")

    def targets(self, cases: DataFrame) -> DataFrame:
        chosen = cases.where(F.col("language").isin(list(self.languages)))
        # a case is told by its folder, or by the folder's name up to the first underscore
        return chosen if self.case is None else chosen.where((F.col("case_id") == self.case) | (F.split_part("case_id", F.lit("_"), F.lit(1)) == self.case))


def prompt_inputs(combos: DataFrame, files: DataFrame) -> DataFrame:
    """Input text per (case_id, combo): sections of its readable files, in the order of the combination.

    combos: case_id, combo, files array<string>; files: case_id, path, content.
    Unreadable files are left out.
    """
    wanted = combos.select("case_id", "combo", F.posexplode("files").alias("at", "path"))
    found = wanted.join(files, ["case_id", "path"])
    made = found.groupBy("case_id", "combo").agg(F.sort_array(F.collect_list(F.struct("at", headed(F.col("path"), F.col("content")).alias("part")))).alias("parts"))
    return made.select("case_id", "combo", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("input"))


def prompt_frame(inputs: DataFrame, templates: DataFrame) -> DataFrame:
    """Every input with every template (prompt, template), the language put in; inputs have a language column.

    Templates come as one array, in order of their names, and are exploded beside each input.
    """
    names = templates.agg(F.sort_array(F.collect_list(F.struct("prompt", "template")))).scalar()
    rows = inputs.withColumn("_t", F.explode(names)).select(*inputs.columns, "_t.prompt", "_t.template")
    whole = F.replace("template", F.lit(LANGUAGE_MARK), F.initcap(F.trim("language")))
    return rows.withColumn("prompt_text", whole).drop("template")


def load_prompts(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """(prompt, template) of the ``*.txt`` and ``*.md`` files of a folder, named by their stems; ``mode`` takes the one of that name, ``all`` (or none) takes every one."""
    rows = spark.read.option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    rows = rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.(txt|md)$", "").alias("prompt"), F.col("value").alias("template"))
    return rows if mode is None or mode.lower() == "all" else rows.where(F.lower("prompt") == mode.lower())


def respond(prompts: DataFrame, responder: Callable[[str, str], str]) -> DataFrame:
    """Adds ``output`` by calling ``responder(prompt_text, input)`` in the workers; an error gives null and doesn't stop the rest."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*prompts.schema.fields, StructField("output", StringType())])

    def call(frames: Iterator) -> Iterator:
        for f in frames:
            answers = []
            for prompt, text in zip(f["prompt_text"], f["input"]):
                try:
                    answers.append(responder(prompt, text))
                except Exception:  # noqa: BLE001 - one failed call is one missing answer
                    answers.append(None)
            yield f.assign(output=answers)

    return prompts.mapInPandas(call, schema)
