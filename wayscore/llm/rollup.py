"""Operator 8: token totals kept up to date by signed deltas.

A batch of changes is reduced to one signed row per source, language and
tokenizer version and committed as one table under the batch id: an insert adds
a document's counts, a delete takes them away, a revision does both.  A batch
id that was committed before changes nothing, so a batch can be sent again
after any failure.  Totals are the sums over committed batches.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore.llm.common import home_dir

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "bytes")
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint, bytes bigint"


class TokenLedger:
    """Committed batches in ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> dict[str, str]:
        """The folder of each committed batch, by batch id."""
        top = self._of(self.path)
        if not self._fs.exists(top):
            return {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(top))
        found = {}
        for n in names:
            if n.startswith("commit-"):
                stream = self._fs.open(self._of(f"{self.path}/{n}"))
                try:
                    found[n.removeprefix("commit-")] = stream.readUTF()
                finally:
                    stream.close()
        return found

    def committed(self) -> list[str]:
        return sorted(self._markers())

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds ``deltas`` (KEYS, sign, tokens, bytes) as one batch; False if that batch was there.

        The reduced batch is written to a folder of its own, whoever writes it.
        The commit is the rename of a marker file that names this folder to
        the batch id, which fails where the id is taken: a reader sees all of
        a batch or nothing, and of two writers of one batch id one commits
        (where the file system renames atomically, as HDFS does).  Null keys
        are keys of their own, null counts count as zero, an empty batch is
        committed too.
        """
        if not re.fullmatch(r"[\w.\-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        marker = self._of(f"{self.path}/commit-{batch}")
        if self._fs.exists(marker):
            return False
        unique = uuid.uuid4().hex
        data, staged = f"data-{batch}-{unique}", self._of(f"{self.path}/staged-{unique}")
        signed = [F.coalesce(F.sum(F.col("sign") * F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "bytes")]
        reduced = deltas.groupBy(*KEYS).agg(F.sum("sign").cast("bigint").alias("docs"), *signed)
        reduced.select(*KEYS, *SUMS).write.parquet(f"{self.path}/{data}")
        stream = self._fs.create(staged, True)
        try:
            stream.writeUTF(data)
        finally:
            stream.close()
        if self._fs.exists(marker) or not self._fs.rename(staged, marker):
            self._fs.delete(staged, False)
            self._fs.delete(self._of(f"{self.path}/{data}"), True)
            return False
        return True

    def totals(self) -> DataFrame:
        """Current totals; keys whose documents are all gone again are left out."""
        paths = [f"{self.path}/{folder}" for folder in self._markers().values()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return summed.where("docs <> 0 or tokens <> 0 or bytes <> 0")

    def compact(self, batch: str) -> DataFrame:
        """Totals as one row set labelled with the last batch they hold, to start another ledger from."""
        return self.totals().withColumn("as_of", F.lit(batch))


#: What counts as a token, by tokenizer version.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[\p{L}\p{M}]+|[0-9]+|[^\p{L}\p{M}0-9\s]"}


def all_counts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, bytes, and tokens by tokenizer version (a map).

    words-1: runs of anything but ASCII white space.  words-2: words, numbers
    and single signs.  Null texts count as empty; repeated rows count each
    time; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.create_map(*(x for v, pattern in VERSIONS.items() for x in (F.lit(v), F.regexp_count(text, F.lit(pattern)).cast("bigint"))))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.octet_length(text).cast("bigint").alias("bytes"), tokens.alias("tokens")
    )


def of_version(counts: DataFrame, version: str) -> DataFrame:
    """Rows of ``all_counts`` under one tokenizer version."""
    return counts.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.col("tokens")[version].alias("tokens"), "bytes")


def counted(docs: DataFrame, version: str) -> DataFrame:
    """Counts per document under a tokenizer version."""
    return of_version(all_counts(docs), version)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace counts: the old ones leave, the new ones come."""
    return signed(old, -1).unionByName(signed(new, 1))


def fresh_ledger(spark: SparkSession, name: str) -> TokenLedger:
    return TokenLedger(spark, f"{home_dir(spark)}/ledger-{name}-{uuid.uuid4().hex}")
