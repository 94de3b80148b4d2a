"""Running prompts and keeping one JSON log a call.

Logs are written by a data source of two phases: a task writes its files into a
folder of its own below ``_staging-<job>``, and the commit, on the driver, renames
the folders of the tasks that counted.  Tasks that died, ran twice or belong to a
failed job leave nothing that ``read_logs`` sees.  A run that is started again
skips the calls that have a log.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from wayscore.functions.text import log_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

FORMAT = "run_logs"
KEY = ["task", "subject", "model", "prompt", "language", "combo"]


@dataclass
class Part(WriterCommitMessage):
    """A task's folder, and how many logs are in it."""

    folder: str
    logs: int


class RunLogWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator) -> Part:
        """Writes rows (name, body) as files of a folder that only this attempt knows."""
        files, root = self._at()
        folder, n = f"_staging-{self.job}/{uuid.uuid4().hex}", 0
        for row in iterator:
            if not n:
                files.create_dir(f"{root}/{folder}", recursive=True)
            with files.open_output_stream(f"{root}/{folder}/{row.name}") as out:
                out.write(row.body.encode())
            n += 1
        return Part(folder, n)

    def commit(self, messages: list) -> None:
        files, root = self._at()
        for i, part in enumerate(m for m in messages if m is not None and m.logs):
            files.move(f"{root}/{part.folder}", f"{root}/part-{self.job}-{i:05d}")
        self._forget(files, root)

    def abort(self, messages: list) -> None:
        self._forget(*self._at())

    def _forget(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/_staging-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_staging-{self.job}")


class RunLogSource(DataSource):
    """``df.write.format("run_logs").mode("append").save(path)`` of rows (name, body); ``path`` is a folder all executors share."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> RunLogWriter:
        if overwrite:
            raise ValueError("logs are only ever added")
        if [f.name for f in schema.fields] != ["name", "body"]:
            raise ValueError("run logs have the columns name and body")
        return RunLogWriter(self.options["path"])


ANSWER = "output string, reasoning_content string, input_tokens bigint, output_tokens bigint, total_tokens bigint"


def answered(asked: DataFrame, responder: Callable) -> DataFrame:
    """Adds what ``responder(prompt_text, input)`` says; rows whose call fails are left out.

    It returns a text, or a dict with output, and reasoning_content and usage (input_tokens,
    output_tokens, total_tokens) if it has them.  A task that Spark runs again calls again.
    """
    from pyspark.sql.types import StructType

    schema = StructType([*asked.schema.fields, *StructType.fromDDL(ANSWER).fields])
    at = {c: i for i, c in enumerate(asked.columns)}

    def call(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):  # an answer leaves as soon as it is there
                prompt, text = (batch.column(at[c])[i].as_py() for c in ("prompt_text", "input"))
                try:
                    said = responder(prompt, text)
                    said = {"output": said} if said is None or isinstance(said, str) else dict(said)
                    if said.get("output") is None:
                        continue
                except Exception as error:  # noqa: BLE001 - one failed call is one missing log
                    print(f"no answer: {error}", file=sys.stderr)
                    continue
                usage = said.get("usage") or {}
                made = [said["output"], said.get("reasoning_content"), *(usage.get(k) for k in ("input_tokens", "output_tokens", "total_tokens"))]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([v], k) for v, k in zip(made, kinds))], schema.names)

    return asked.mapInArrow(call, schema)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The keys of the calls that have a log below ``path``; none where the folder isn't there yet."""
    fields = "task string, cve string, sample_id string, model string, prompt_name string, language string, combo bigint"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "task string, subject string, model string, prompt string, language string, combo bigint")
    rows = spark.read.schema(fields).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.select("task", F.coalesce("cve", "sample_id").alias("subject"), "model", F.col("prompt_name").alias("prompt"), "language", F.coalesce("combo", F.lit(0)).cast("bigint").alias("combo")).distinct()


def run(asked: DataFrame, responder: Callable, path: str, model: str, provider: str, actual_label: int, task: str, waves: int = 1) -> int:
    """Calls ``responder`` for every row of ``asked`` without a log yet and adds the logs to ``path``; returns how many calls were due.

    ``asked`` has subject, combo, language, prompt, prompt_text and input, and a struct
    ``about`` with whatever else the logs shall hold.  Names end with the number of the
    combination and the time, so that no two calls of a run share one.  Each of ``waves``
    is committed by itself, so a later failure costs no earlier answer.
    """
    spark = asked.sparkSession
    spark.dataSource.register(RunLogSource)
    keyed = asked.withColumns({"task": F.lit(task), "model": F.lit(model), "combo": F.col("combo").cast("bigint")})
    due = keyed.join(committed(spark, path), KEY, "left_anti")
    n = due.count()
    for wave in range(waves):
        rows = due.where(F.pmod(F.xxhash64(*KEY), F.lit(waves)) == wave) if waves > 1 else due
        said = answered(rows, responder)
        id_name = "sample_id" if task == "negative" else "cve"
        body = F.to_json(
            F.struct(
                "task", F.col("subject").alias(id_name), "combo", F.col("prompt").alias("prompt_name"), "language", "model", F.lit(provider).alias("provider"), F.col("prompt_text").alias("prompt"), "input", "output",
                "reasoning_content", F.lit(actual_label).alias("actual_label"), F.struct("input_tokens", "output_tokens", "total_tokens").alias("usage"),
                F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "about.*",
            ),
            {"ignoreNullFields": "false"},
        )
        name = log_name([F.col("subject"), F.col("model"), F.lit("run"), F.col("prompt"), F.col("language"), F.col("combo").cast("string")], F.current_timestamp())
        said.select(name.alias("name"), body.alias("body")).write.format(FORMAT).mode("append").save(path)
    return n


def preview(asked: DataFrame) -> DataFrame:
    """What is about to be sent: the first 200 characters of each prompt and 500 of its input, with dots where there is more."""
    short = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(F.col(c))
    return asked.withColumns({"prompt_text": short("prompt_text", 200), "input": short("input", 500)})
