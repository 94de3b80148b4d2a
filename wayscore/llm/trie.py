"""Operator 13: the prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns, named by its depth and its
smallest member.  At each depth the live conversations, those that share their
node, are grouped by (node, next turn).  A conversation alone in its node is live
no more: the chain below it follows from its length.  Levels of shared nodes are
then joined in reverse to add up leaves and savings.  Only hashes of turns are
shuffled, and tables between levels are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayscore.llm.common import dropped, written

#: Turn numbers of a conversation that one task puts in order.
SLICE = 1024
#: Ids whose text is one row on the way to a digest, and depths of a chain that are one array.
CHUNK = 1 << 16
STRETCH = 4096
NONE_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no bytes
LEVEL = "conv_id bigint, len bigint, depth bigint, node bigint, parent bigint, n bigint, words bigint"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, key, words): the turns of each conversation counted from one, a SHA-256 of role and text, and the text's words.

    Turns go by number, null first, those of one number by their key.  A null
    role or text is empty.  Rows without a conv_id are left out.  A long
    conversation is dealt by slices of turn numbers; rows of one conversation
    with one number are ordered in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")
    )
    rows = rows.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(2**60))))
    inside = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), "key")
    rows = rows.withColumn("at", F.row_number().over(inside).cast("bigint"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("size")).select("conv_id", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return rows.join(sizes, ["conv_id", "slice"]).select("conv_id", (F.col("at") + F.col("before")).alias("depth"), "key", "words")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("depth").alias("len"))


def regrafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations rebuilt to share beginnings: the first h turns of conversation c - c % 20, then c's own after its first h; h is crc32 of c % 4 (% as in SQL: its sign is c's)."""
    own = lengths(turns)
    c = F.col("conv_id")
    convs = own.withColumns({"base": c - c % 20, "h": F.crc32(c.cast("string").cast("binary")) % 4})
    convs = convs.join(own.select(c.alias("base"), F.col("len").alias("base_len")), "base", "left").withColumn("head", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len")), "grafts")
    tails = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("head")).alias("depth"), "key", "words")
    first = turns.where("depth <= 3").withColumnRenamed("conv_id", "base")
    heads = convs.where("head > 0").join(first, "base").where("depth <= head").select("conv_id", "depth", "key", "words")
    return tails.unionByName(heads), convs.select("conv_id", "len")


def _levels(turns: DataFrame, convs: DataFrame) -> list[DataFrame]:
    """A table for each depth down to the first without a shared node: the conversations that shared the node above, with their nodes, those nodes' sizes and parents."""
    whole = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    if not whole.n:
        return []
    zero = F.lit(0).cast("bigint")
    top = convs.select("conv_id", "len", zero.alias("depth"), F.lit(whole.node).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(whole.n).cast("bigint").alias("n"), zero.alias("words"))
    made = [written(top, "trie")]
    shared = whole.n > 1
    while shared:
        d = len(made)
        live = made[-1].where(f"n > 1 and len >= {d}").select("conv_id", "len", F.col("node").alias("parent"))
        here = live.join(turns.where(f"depth = {d}"), "conv_id")
        groups = written(here.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).where("n > 1"), "groups")
        level = here.join(groups, ["parent", "key"], "left").select("conv_id", "len", "depth", F.coalesce("node", "conv_id").alias("node"), "parent", F.coalesce("n", F.lit(1)).cast("bigint").alias("n"), "words")
        made.append(written(level, "trie"))
        shared = not groups.isEmpty()
        dropped(groups)
    return made


def _together(tables: list[DataFrame]) -> DataFrame:
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.written_path for t in tables))


def _rolled_up(levels: list[DataFrame]) -> list[DataFrame]:
    """Shared nodes of each depth with children, leaves and savings, from the deepest level up."""
    made: list[DataFrame] = []
    for at in reversed(range(len(levels) - 1)):
        nodes = levels[at].where("n > 1 and conv_id = node").select("node", "parent", "depth", "n", "words")
        one = F.lit(1).cast("bigint")
        kids = levels[at + 1].where("n = 1").select("parent", one.alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
        if made:
            kids = kids.unionByName(made[-1].select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        sums = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        none = F.lit(0).cast("bigint")
        rolled = nodes.join(sums, "node", "left").select(
            F.col("node").alias("conv_id"), "depth", "parent", F.col("n").alias("n_convs"), F.coalesce("n_children", none).alias("n_children"),
            F.coalesce("leaves", one).alias("n_leaves"), ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", none)).alias("saved_tokens"),
        )
        made.append(written(rolled, "rolled"))
    return made


def _chunked(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def row():
        return pa.RecordBatch.from_pydict({"node": pa.array([now[0]], pa.int64()), "depth": pa.array([now[1]], pa.int64()), "first": pa.array([held[0]], pa.int64()), "ids": [",".join(map(str, held))]})

    now, held, out = None, [], []
    for batch in batches:
        for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, depth) != now or len(held) == CHUNK:
                if held:
                    out.append(row())
                now, held = (node, depth), []
            held.append(conv)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if held:
        yield row()


def _digested(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    now, state, out = None, None, []

    def flushed():
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([r[0] for r in out], pa.int64()), "depth": pa.array([r[1] for r in out], pa.int64()), "ends_sha256": [r[2] for r in out]})

    for batch in batches:
        for node, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, depth) != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (node, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield flushed()
            out = []
    if now is not None:
        out.append((*now, state.hexdigest()))
        yield flushed()


def ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ``ends`` (node, depth, conv_id): SHA-256 of a node's ids, ascending, joined by commas.

    Ids are put in order over many tasks and leave them as texts of up to 65,536 ids; only these texts stream, in order, through the task of their node.
    """
    ordered = ends.select("node", "depth", "conv_id").repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    texts = ordered.mapInArrow(_chunked, "node bigint, depth bigint, first bigint, ids string")
    dealt = texts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "ids")
    return dealt.mapInArrow(_digested, "conv_id bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns`` (conv_id, depth, key, words; depth counted from one without a gap), the root included.

    ``convs`` (conv_id, len) has each conversation once, those without turns too.
    Returns conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs (members), n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (over the subtree, members less one times the last text's words)
    and ends_sha256 (of the members that end here).  Equal conversations share
    all their nodes; without conversations there is no node.
    """
    by_depth = written(turns.select("conv_id", "depth", "key", "words").repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "turns")
    levels = _levels(by_depth, convs)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    if not levels:
        return turns.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in columns))
    every = _together(levels)
    # chains of conversations that are alone
    stretches = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("len") - F.col("depth")) / STRETCH)))
    low = F.col("depth") + F.col("stretch") * STRETCH
    alone = every.where("n = 1").select("conv_id", "len", F.col("depth").alias("top"), "parent", "depth", stretches.alias("stretch"))
    alone = alone.select("conv_id", "len", "top", "parent", F.explode(F.sequence(low, F.least("len", low + STRETCH - 1))).alias("depth"))
    one, last = F.lit(1).cast("bigint"), F.col("depth") == F.col("len")
    chains = alone.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NONE_SHA).alias("ends_sha256"),
    )
    rolled = _rolled_up(levels)
    if not rolled:
        return chains
    ends = ends_digest(every.where("n > 1 and len = depth"))
    nodes = _together(rolled).withColumnRenamed("parent", "parent_conv_id").join(ends, ["conv_id", "depth"], "left")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE_SHA))).select(*columns).unionByName(chains)
