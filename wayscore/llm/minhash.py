"""Operator 1: near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys, A and B, hold ``m`` entries each; a half
key joins two minhash values.  The table keys are all pairs (A_i, B_j): m*m
tables from 4*m minhash values, where independent tables would need 4*m*m.
At Jaccard s a pair meets in a table with probability (1 - (1 - s**2)**m)**2;
m is the least that makes this RECALL at the threshold: 6 at 0.85, 8 at 0.8.
Every candidate is verified on its full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayscore.llm.common import SPACE, connected_components, fitted, small_batches, written

#: Least probability that a pair exactly at the threshold is proposed.
RECALL = 0.999
#: Bits of the table of shingle counts that orders prefixes (4 MB).  The order decides how much is compared, never what is found.
SLOT_BITS = 20
#: Pairs of one document to a task: one that has more is dealt to several.  No more documents than MANY are, so the list of
#: them can be broadcast; where pairs are many, a task gets more of one document's, but never more than a share of 1 / MANY of all.
SPLIT, MANY = 256, 10_000
SEED = 0x9E3779B97F4A7C15
#: Most bits of the broadcast filter of ids, as a power of two (16 MB).
FILTER_BITS = 27


def halves_for(percent: int, recall: float = RECALL) -> int:
    """Half keys on either side, so that a pair at the threshold meets with probability ``recall``."""
    s, m = percent / 100, 1
    while s < 1 and (1 - (1 - s * s) ** m) ** 2 < recall:
        m += 1
    return m


def _digest(key: bytes) -> tuple[int, int]:
    import xxhash

    digest = xxhash.xxh3_128_intdigest(key)
    return (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63


def _shingler(size: int):
    """A function from a text to (words joined by a blank, sorted distinct shingle hashes)."""
    import numpy as np
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) > 300_000:  # memory bound; forgotten words are hashed again
                self.clear()
            found = self[word] = xxhash.xxh3_64_intdigest(word)
            return found

    hashes = Hashes()
    mult = np.random.default_rng(11).integers(1, 2**63, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(text):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return b"", np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(size, len(words))
        n = len(words) - width + 1
        mixed = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            mixed = (mixed ^ h[k : k + n]) * mult[k]
            mixed ^= mixed >> np.uint64(29)
        return b" ".join(words), np.unique(mixed)

    return shingles


def _signatures(size: int, m: int, salt: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingles = _shingler(size)
        rng = np.random.default_rng(salt & 0xFFFFFFFF)
        mult = rng.integers(1, 2**63, size=4 * m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        flip = rng.integers(0, 2**63, size=4 * m, dtype=np.uint64)
        for batch in batches:
            n_sh, hi, lo, halves = [], [], [], []
            for text in batch.column(1).to_pylist():
                key, own = shingles(text)
                n_sh.append(len(own))
                if not len(own):
                    hi.append(None)
                    lo.append(None)
                    halves.append(None)
                    continue
                high, low = _digest(key)
                hi.append(high)
                lo.append(low)
                least = np.empty(4 * m, dtype=np.uint64)
                for j in range(4 * m):
                    least[j] = ((own ^ flip[j]) * mult[j]).min()
                half = (least[0::2] * mult[0] ^ (least[1::2] >> np.uint64(7))) * mult[1]
                halves.append((half ^ (half >> np.uint64(31))).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_sh, pa.int64()),
                    pa.array(hi, pa.int64()),
                    pa.array(lo, pa.int64()),
                    pa.array(halves, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "class_hi", "class_lo", "halves"],
            )

    return run


def _sets(size: int):
    """(rep, class_hi, class_lo, text) -> (rep, sh), for texts of the class asked for."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingles = _shingler(size)
        for batch in batches:
            reps, sets = [], []
            for rep, high, low, text in zip(*(c.to_pylist() for c in batch.columns)):
                key, own = shingles(text)
                if _digest(key) == (high, low):
                    reps.append(rep)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "sh"])

    return run


def _may_be_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in ``ids``, and few others: a broadcast bitmap of at most 2**FILTER_BITS bits keeps texts out of shuffles.

    Beyond some ten million ids it fills up and lets more rows through; the
    exact join that follows decides.
    """
    bits = 1 << min(FILTER_BITS, max(15, math.ceil(math.log2(64 * max(1, ids.count())))))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    bitmaps = ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bitmap"))
    bit = F.bitmap_bit_position(at).cast("int")
    probed = rows.withColumns({"_bucket": F.bitmap_bucket_number(at), "_bit": bit}).join(F.broadcast(bitmaps), "_bucket")
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return probed.where(F.getbit(byte, F.col("_bit") % 8) == 1).select(rows.columns)


def _shingle_sets(reps: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Full shingle sets (rep, sh) of the classes named in ``reps`` (rep), as a table; one text stands for each class."""
    asked = reps.distinct().join(classes.select("rep", "doc_id", "class_hi", "class_lo"), "rep")
    # an inner join: a semi join would be moved below the filter, and whole texts shuffled
    chosen = _may_be_in(texts, asked.select("doc_id").distinct()).join(asked, "doc_id")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = chosen.withColumn("_same", F.xxhash64(F.filter(F.split(lower, f"{SPACE}+"), lambda w: w != "")))
    chosen = chosen.dropDuplicates(["doc_id", "rep", "_same"]).select("rep", "class_hi", "class_lo", "text")
    return written(chosen.mapInArrow(_sets(size), "rep bigint, sh array<bigint>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds ``linked`` to ``pairs`` (a, b), from their full shingle sets; a document in many pairs is dealt to several tasks."""
    given, split = pairs, max(SPLIT, pairs.count() // MANY)
    for x, y in ("ab", "ba"):
        # a row for at most MANY documents; where there is none the joins with it vanish from the plan
        parts = F.ceil(F.count("*") / split).cast("int").alias("parts")
        many = given.sparkSession.createDataFrame(given.groupBy(x).agg(parts).where("parts > 1").collect(), f"{x} bigint, parts int")
        parts = F.coalesce("parts", F.lit(1))
        held = sets.select(F.col("rep").alias(x), F.col("sh").alias(f"s{x}")).join(F.broadcast(many), x, "left")
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        dealt = pairs.join(F.broadcast(many), x, "left").withColumn("part", F.pmod(F.xxhash64(y), parts).cast("int")).drop("parts")
        pairs = dealt.join(held, [x, "part"]).drop("part")
    both = pairs.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("bigint"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return written(both.select("a", "b", (100 * F.col("common") >= percent * union).alias("linked")), "checked")


def _slots(h):
    import numpy as np

    return ((h.view(np.uint64) * np.uint64(SEED)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for batch in batches:
        counts += np.bincount(_slots(np.asarray(batch.column(0).flatten(), dtype=np.int64)), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])


def _prefixes(counts, percent: int):
    """The rarest shingles of each set: two sets that reach the threshold share one of them, whatever the order is based on."""

    def run(batches: Iterator) -> Iterator:
        import pickle

        import numpy as np
        import pyarrow as pa

        often = pickle.loads(counts.value)
        for batch in batches:
            made = []
            for own in batch.column(1).to_pylist():
                h = np.asarray(own, dtype=np.int64)
                most = len(h) - -(-percent * len(h) // 100) + 1
                made.append(h[np.lexsort((h, often[_slots(h)]))[:most]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["rep", "prefix"])

    return run


def _prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that may reach the threshold, by exact prefix and position filters.

    Shingles are ordered from rare to frequent by counts in a table of fixed
    size, which is all that is broadcast.
    """
    spark = sets.sparkSession
    rows = sets.select("sh").mapInArrow(_slot_counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))

    def table(found):
        import numpy as np

        counts = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        if found is not None and found.num_rows:
            counts[np.asarray(found.column("slot"))] = np.minimum(np.asarray(found.column("n")), 2**31 - 1)
        return counts

    counts = spark.sparkContext.broadcast(fitted(rows, table))
    prefixes = sets.mapInArrow(_prefixes(counts, percent), "rep bigint, prefix array<bigint>")
    rows = prefixes.join(labels, "rep").select("rep", "n", "label", F.posexplode("prefix").alias("pos", "shingle"))
    mixed = rows.groupBy("shingle").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("shingle")
    rows = written(rows.join(mixed, "shingle"), "prefixes")
    left, right = (rows.select("shingle", *(F.col(c).alias(f"{c}_{e}") for c in ("rep", "n", "label", "pos"))) for e in "ab")
    # seen from the first shingle that two sets share, what can still follow bounds their overlap
    most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    reach = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    met = left.join(right, "shingle").where("label_a < label_b").where(_in_range("n_a", "n_b", percent) & reach)
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _in_range(x: str, y: str, percent: int) -> F.Column:
    """Sizes between which the threshold can be reached."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, halves: int | None = None, salt: int = SEED) -> DataFrame:
    """Components of documents linked by shingle Jaccard >= ``percent`` / 100.

    Returns doc_id, n_shingles, component_id, kept, one row per input row.

    Texts are lower-cased (A-Z) and cut at ASCII white space.  Null or empty
    texts have an empty set and are linked with nothing; a text shorter than a
    shingle is one shingle.  Equal word sequences form a class, so copies
    never meet in pairs.  Each class is first tried against the most central
    class that shares a bucket with it.  Classes that then still share a
    bucket with another component are compared across components wherever an
    exact prefix filter lets a pair reach the threshold.  No candidate is
    capped.  Rows with a null doc_id are linked with nothing, get a null
    component and are kept.  Rows repeated under one doc_id share its
    component, whether or not their texts are alike: a doc_id with several
    texts links what each of them is linked with; only a row without words
    stays alone there too.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    m = halves or halves_for(percent)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, class_hi bigint, class_lo bigint, halves array<bigint>"
    base = written(texts.mapInArrow(_signatures(shingle_words, m, salt), schema), "signatures")
    usable = base.where("doc_id is not null and class_hi is not null")
    one = ["class_hi", "class_lo"]
    # a class goes by its smallest doc_id; one whose smallest doc_id has several texts, by a number that its digest makes
    several = usable.groupBy("doc_id").agg(F.min(F.struct(*one)).alias("x"), F.max(F.struct(*one)).alias("y")).where("x <> y").select("doc_id")
    several = written(several, "several")
    unique = several.isEmpty()  # then every class goes by its smallest doc_id, and the steps for others fall away
    classes = usable.groupBy(*one).agg(F.min("doc_id").alias("doc_id")).withColumn("rep", F.col("doc_id"))
    if not unique:
        classes = classes.join(several.withColumn("_several", F.lit(True)), "doc_id", "left")
        classes = classes.withColumn("rep", F.when(F.col("_several"), F.xxhash64(*one, F.lit("class"))).otherwise(F.col("doc_id")))
    classes = written(classes.select(*one, "doc_id", "rep"), "classes")
    # one row per class: the row of its smallest doc_id, halves and all
    reps = (
        usable.join(classes, [*one, "doc_id"])
        .groupBy(*one)
        .agg(F.first("rep").alias("rep"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"))
        .select("rep", "n", "halves")
    )
    a, b = F.slice("halves", 1, m), F.slice("halves", m + 1, m)
    tables = F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.xxhash64(x, y, i, j))))
    keyed = reps.select("rep", "n", F.explode(tables).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 < r1")
    buckets = written(keyed.join(shared.select("key", "size"), "key"), "buckets")

    # each class is tried once against the most central class that it meets
    score = buckets.groupBy("rep").agg(F.sum("size").alias("score"))
    ranked = buckets.select("key", "rep").join(score, "rep")
    heads = ranked.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("m"))).alias("h"))
    hubs = buckets.select("key", "rep", "n").join(heads, "key").groupBy("rep").agg(F.max("n").alias("n"), (-F.max("h")["m"]).alias("hub"))
    sizes = buckets.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n")).distinct()
    spokes = hubs.where("rep <> hub").join(sizes, "hub").where(_in_range("n", "hub_n", percent)).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    spokes = written(spokes, "spokes")
    ids = spokes.select(F.col("a").alias("rep")).union(spokes.select("b"))
    stars = _verified(spokes, _shingle_sets(ids, classes, texts, shingle_words), percent).where("linked").select("a", "b")
    if not unique:  # texts under one doc_id belong together
        held = usable.join(several, "doc_id").select("doc_id", *one).distinct().join(classes.drop("doc_id"), one)
        first = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
        stars = stars.union(held.join(first, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))
    labels = written(connected_components(stars), "labels")

    # classes that still meet a class of another component
    placed = buckets.join(labels.select(F.col("id").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key")
    open_ = written(placed.join(mixed, "key", "left_semi").select("rep", "n", "label").distinct(), "open")
    if not open_.isEmpty():
        sets = _shingle_sets(open_.select("rep"), classes, texts, shingle_words)
        more = _verified(written(_prefix_pairs(sets, open_, percent), "rest"), sets, percent).where("linked")
        labels = connected_components(stars.union(more.select("a", "b")))
    component = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(*one, "doc_id", "rep", F.coalesce("component", "rep").alias("component_id"))
    if not unique:
        # a component with a class that doesn't go by a doc_id takes its smallest doc_id
        component = written(component, "components")
        numbered = component.where("rep <> doc_id").select("component_id").distinct()
        renamed = component.join(numbered, "component_id").groupBy("component_id").agg(F.min("doc_id").alias("least"))
        component = component.join(renamed, "component_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    component = component.select(*one, "component_id")
    return (
        base.select("doc_id", "n_shingles", *one)
        .join(component, one, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each near-duplicate group, all columns as they came.

    Where a doc_id that stays is repeated, the row whose text has the smallest
    hash stays; rows with a null doc_id all stay.  An empty table gives no rows.
    """
    kept = near_duplicates(docs, **params).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    named = named.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("row")).select("doc_id", "row.*")
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
