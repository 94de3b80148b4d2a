"""Term vectors of whole texts, shared by the quality classifier and the mixer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import small_batches

#: Slots for words, and for the shapes of words with the last three for repetition.
WORDS, SHAPES = 3072, 1024
TERMS = WORDS + SHAPES


def featurizer():
    """A function from a text to (term vector, words).

    Every word counts three terms: itself (lower-cased, without signs at its
    ends), its shape (runs of capitals, other letters, digits and single signs),
    and whether it repeats the word one, two or three places before.  Terms are
    hashed into slots; the vector holds square roots of their shares of the
    words, so length cancels out.  A null or blank text has the zero vector.
    """
    import re

    import numpy as np
    import xxhash

    kind = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
    runs = re.compile(rb"(.)\1+", re.S)
    signs = bytes(b for b in range(33, 127) if not chr(b).isalnum())

    class Codes(dict):
        def __missing__(self, word):
            if len(self) > 300_000:  # memory bound; forgotten words are coded again
                self.clear()
            slot = xxhash.xxh3_64_intdigest(word.strip(signs).lower()) % WORDS
            shape = xxhash.xxh3_64_intdigest(runs.sub(rb"\1", word.translate(kind))) % (SHAPES - 3)
            found = self[word] = xxhash.xxh3_64_intdigest(word) >> 33 << 32 | shape << 16 | slot
            return found

    codes = Codes()

    def features(text):
        out = np.zeros(TERMS)
        words = (text or "").encode("utf-8", "surrogatepass").split()
        n = len(words)
        if not n:
            return out, 0
        c = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=n)
        out[:WORDS] = np.bincount(c & 0xFFFF, minlength=WORDS)
        out[WORDS:-3] = np.bincount(c >> 16 & 0xFFFF, minlength=SHAPES - 3)
        out[-3:] = [np.count_nonzero(c[k:] == c[:-k]) for k in (1, 2, 3)]
        return np.sqrt(out / n), n

    return features


def _vectors(batches: Iterator) -> Iterator:
    import pyarrow as pa

    features = featurizer()
    for batch in batches:
        made = [features(t)[0].astype("float32") for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.list_(pa.float32()))], [*batch.schema.names[1:], "x"])


def labelled_vectors(docs: DataFrame, labels: DataFrame, label: Column, classes: int, per_class: int) -> DataFrame:
    """(doc_id, y, x) of a bounded sample: term vectors of at most ``per_class`` documents of each label 0 to ``classes`` - 1.

    The documents are chosen by a hash of doc_id, whatever the size of the
    input.  Of contradictory labels of one doc_id the larger holds; of rows
    repeated under one doc_id, the text that is last in order stands for it.
    A label outside the range is an error, null labels and doc_ids are left out.
    """
    small_batches(docs.sparkSession)
    found = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.cast("int").alias("y"))
    found = found.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = F.when(F.col("y").between(0, classes - 1), F.col("y")).otherwise(F.raise_error(F.lit(f"a label is outside 0 to {classes - 1}")).cast("int"))
    found = found.select("doc_id", known.alias("y"))
    counts = {r.y: r.n for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each class
    parts = []
    for y in range(classes):
        # of many rows only some four times the sample leave their tasks; these hold the least hashes
        share = min(1.0, (4 * per_class + 100) / max(1, counts.get(y, 0)))
        few = found.where((F.col("y") == y) & (F.xxhash64("doc_id") <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63)))))
        parts.append(few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(reduce(DataFrame.union, parts)), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    return met.select("text", "doc_id", "y").mapInArrow(_vectors, "doc_id bigint, y int, x array<float>")


def as_arrays(table):
    """Term vectors and labels of a table of ``labelled_vectors``, in order of doc_id."""
    import numpy as np

    if table is None or not table.num_rows:
        return np.zeros((0, TERMS), dtype=np.float32), np.zeros(0, dtype=int)
    table = table.sort_by("doc_id")
    x = np.array(table.column("x").combine_chunks().flatten(), dtype=np.float32)
    return x.reshape(-1, TERMS), np.asarray(table.column("y"), dtype=int)
