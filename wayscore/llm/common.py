"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Only a local session, whose executors are this process, may fall back to
    a temporary folder; on a cluster an unset ``spark.checkpoint.dir`` is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayscore-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def home_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; ``discard`` removes it."""
    return f"{shared_dir(spark)}/wayscore/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str, instead: DataFrame | None = None) -> DataFrame:
    """Cuts lineage through a table in the shared folder: it is computed once and a lost executor takes nothing away.

    ``instead`` is an earlier table that nothing reads any more once this one stands; it is deleted.
    """
    spark = df.sparkSession
    path = f"{home_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    dropped(instead)
    return out


def dropped(table: DataFrame | None) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    if path := getattr(table, "written_path", None):
        _delete(table.sparkSession, path)


def discard(spark: SparkSession) -> None:
    """Deletes every table this application has written in the shared folder; results not stored elsewhere go with them."""
    _delete(spark, home_dir(spark))


#: Rows to an Arrow batch, in every operator alike: whole texts may be long, and few of them bound a worker's memory.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fitted(rows: DataFrame, fit) -> bytes:
    """``fit`` of the bounded table ``rows`` (as Arrow), run in one task, so that neither rows nor work are the driver's.

    ``fit`` returns any picklable model, and the bytes of it come back; the
    caller guarantees the bound on ``rows``.
    """

    def run(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], ["model"])

    return bytes(rows.repartition(1).mapInArrow(run, "model binary").first().model)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges`` (a, b), as (id, component).

    Alternates the large-star and small-star steps until the edge set stands
    still.  Only fingerprints of the edge set reach the driver.  Vertices
    without an edge, self loops and null ends are absent from the result.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    kept = edges.where("a is not null and b is not null and a <> b")
    now = written(kept.select(most.alias("u"), least.alias("v")).distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(low).distinct(), "edges", instead=now)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
