"""Operator 10: a quality score by nearest-neighbour voting in a latent space.

A bounded, hash-chosen sample of labelled documents is laid out as terms (words
and their shapes), weighted by inverse document frequency and projected on its
leading singular vectors.  The labelled latent vectors are broadcast; every document takes its
exact cosines with all of them, in blocks, and its nearest neighbours vote
with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import fitted, small_batches
from wayscore.llm.features import as_arrays, featurizer, labelled_vectors

#: Labelled documents of each class that may be broadcast.
PER_CLASS = 1500
LATENT = 96
NEIGHBOURS = 15
THRESHOLD = 0.3


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def latent_space(x, y, latent: int) -> dict:
    """Term weights, projection on the leading singular vectors, and the labelled vectors in it, at unit length."""
    import numpy as np

    if not len(y):
        return {"project": None}
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    # subspace iteration from a fixed start: the leading right singular vectors, without a full decomposition
    q = np.random.default_rng(5).standard_normal((x.shape[1], latent + 16)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    project = (q @ vt[:latent].T).astype(np.float32)
    return {"project": idf[:, None] * project, "z": _unit(x @ project), "y": (y > 0).astype(np.float64)}


def _unit(z):
    import numpy as np

    return z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)


def votes(z, known, y, neighbours: int):
    """Share of label 1 among each row's nearest of ``known`` by cosine, weighted by the fourth power of the cosine.

    All cosines are computed, in blocks.  Of equally near ones the first in order of doc_id votes.
    """
    import numpy as np

    k = min(neighbours, len(known))
    out = np.empty(len(z))
    for at in range(0, len(z), 1024):
        cos = z[at : at + 1024] @ known.T
        edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
        above, level = cos > edge, cos == edge
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
        w = np.where(above | level, np.clip(cos, 1e-3, None).astype(np.float64) ** 4, 0.0)
        out[at : at + 1024] = (w @ y) / w.sum(axis=1)
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, latent: int = LATENT) -> bytes:
    """The pickled latent space of at most ``per_class`` rows of each label, found in one task."""

    def run(table):
        return latent_space(*as_arrays(table), latent)

    return fitted(labelled_vectors(docs, labels, (F.col("quality") > 0), 2, per_class), run)


def _scores(model, neighbours: int):
    def run(batches: Iterator) -> Iterator:
        import pickle

        import numpy as np
        import pyarrow as pa

        m = pickle.loads(model.value)
        features = featurizer()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score = np.full(len(texts), 0.5)
            if m["project"] is not None and texts:
                x = np.stack([features(t)[0].astype(np.float32) for t in texts])
                score = votes(_unit(x @ m["project"]), m["z"], m["y"], neighbours)
                score[~x.any(axis=1)] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD, training: DataFrame | None = None) -> DataFrame:
    """Scores every row of ``docs``: doc_id, held_out, score, predicted.

    Only labels of rows that aren't held out (crc32 of the doc_id as text, mod
    5) are learned; ids, labels, language and source are no inputs.  A null or
    blank text scores 0.  Without any usable label every text scores 0.5; of
    contradictory labels the larger holds.  Repeated rows are scored alike; a
    row without doc_id is scored and never held out.  An empty table gives no
    rows, other columns are ignored, texts are read whole.  ``training`` holds the labelled texts if they aren't in ``docs``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    learn = labels.where(~held_out("doc_id"))
    model = spark.sparkContext.broadcast(fit(docs if training is None else training, learn))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(model, neighbours), "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
