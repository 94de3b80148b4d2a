"""Operator 5: cross-entropy difference between a target and a background model.

Both are interpolated bigram models over every word of the corpus, and matched:
they share the vocabulary, and the background's counts are brought to the
target's number of tokens, so that smoothing weighs on both alike.  A document
is scored by what the rest of the corpus holds: its own counts are taken away
first.

Texts are coded once, in chunks; a chunk sends its distinct words and pairs, as
hashes with counts, to buckets of the hash space, and each bucket sends their
totals back to the chunks that asked.  No vocabulary or model is gathered or
broadcast: buckets and chunks grow in number with the input, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import small_batches, written

#: Tokens after which a chunk is closed, and bytes of text to a bucket of the hash space.
CHUNK, BUCKET = 1_000_000, 2_000_000
#: Bits of a hash besides those that name its bucket: of a bucket's keys, some two in 10**5 share theirs, at any size.
KEY_BITS = 34
#: Most bitmaps of 4 KB that mark target ids and may be broadcast (16 MB, 134 million ids where they are dense).
MARKS = 4096


def _planes(values) -> bytes:
    """Integers byte plane by byte plane, as the high ones are mostly zero and compress."""
    import pyarrow as pa

    data = values.view("u1").reshape(len(values), values.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _plain(data: bytes, kind: str):
    import numpy as np
    import pyarrow as pa

    found = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(found, "u1").reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _steps(keys) -> bytes:
    """Keys by their differences, which are small where they are sorted; exact in any order, modulo 2**64."""
    import numpy as np

    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes):
    import numpy as np

    return np.cumsum(_plain(data, "<u8"), dtype=np.uint64)


def _mixed(h):
    """The splitmix64 finaliser, a bijection."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pairs(hashes, tokens, lengths, shift):
    """Distinct pairs of a chunk in the order of their keys: keys, both words, and each token's pair.

    Word 0 stands before each text.  Hashes are numbers of 64 - ``shift`` bits.
    """
    import numpy as np

    before = np.append(np.zeros(1, tokens.dtype), tokens[:-1])[: len(tokens)].astype(np.int64)
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    code, at = np.unique(before * len(hashes) + tokens, return_inverse=True)
    a, b = code // len(hashes), code % len(hashes)
    keys = _mixed(_mixed(hashes[a] ^ np.uint64(0x9E3779B97F4A7C15)) + hashes[b]) >> np.uint64(shift)
    order = np.argsort(keys, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return keys[order], a[order], b[order], place[at.reshape(-1)]


def _ranks(often):
    """Place of each word by how often it occurs in its chunk, so that most tokens are small numbers; word 0 stays."""
    import numpy as np

    place = np.empty(len(often), dtype=np.int64)
    place[np.append(0, 1 + np.argsort(-often[1:], kind="stable"))] = np.arange(len(often))
    return place


def _shift(bits: int) -> int:
    """Low bits of a 64-bit hash that are dropped, with 2**``bits`` buckets."""
    return max(0, 64 - bits - KEY_BITS)


def _coded(bits: int, chunk_tokens: int):
    """Chunks of texts: one row of its coded documents (bucket -1), and its keys with counts by bucket (words from 0, pairs from 2**bits)."""
    names = ["chunk", "bucket", "keys", "counts", "docs", "background", "target"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        class Words(dict):
            def __missing__(self, word):
                self[word] = found = len(self) + 1
                return found

        base = TaskContext.get().partitionId() << 32
        made = 0
        shift = _shift(bits)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

        def closed(words, parts, ids, chosen):
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            tokens = np.concatenate([np.zeros(0, np.int64), *parts])
            # word 0 has a hash of its own; sorted hashes make the codes independent of the order of words
            raw = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)) >> np.uint64(shift)
            order = np.argsort(raw, kind="stable")
            place = np.empty(len(raw) + 1, dtype=np.int64)
            place[order + 1], place[0] = np.arange(1, len(raw) + 1), 0
            hashes = np.append(np.uint64(0x5851F42D4C957F2D >> shift), raw[order])
            tokens = place[tokens]
            keys, a, b, at = _pairs(hashes, tokens, lengths, shift)
            inside = np.repeat(np.array(chosen, dtype=bool), lengths)
            pair = [np.bincount(x, minlength=len(keys)) for x in (at, at[inside])]
            word = [np.bincount(w, n, len(hashes)).astype(np.int64) for w in (b, a) for n in pair]
            # keys of words are looked up in the order of their own sorted hashes
            first = np.argsort(hashes, kind="stable")
            nulls = np.array([i is None for i in ids], dtype=np.int64)
            numbers = np.array([i or 0 for i in ids], dtype=np.int64)
            often = np.bincount(tokens, minlength=len(hashes))
            coded = np.append(often, _ranks(often)[tokens]).astype(np.int32)
            yield base + made, -1, _steps(hashes), _planes(coded), _planes(np.concatenate((numbers, nulls, lengths, np.array(chosen, dtype=np.int64)))), len(tokens), int(inside.sum())
            for offset, own, counts in ((0, hashes[first], [w[first] for w in word]), (1 << bits, keys, pair)):
                bucket = (own >> np.uint64(64 - shift - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for i, j in zip(cuts, [*cuts[1:], len(own)]):
                    yield base + made, offset + int(bucket[i]), _steps(own[i:j]), _planes(np.concatenate([c[i:j] for c in counts]).astype(np.int32)), None, 0, 0

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        words, parts, ids, chosen, held = Words(), [], [], [], 0
        for batch in batches:
            for doc, text, inside in zip(*(c.to_pylist() for c in batch.columns)):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                parts.append(np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found)))
                ids.append(doc)
                chosen.append(inside)
                held += len(found)
                if held >= chunk_tokens or len(ids) >= chunk_tokens:
                    yield table(list(closed(words, parts, ids, chosen)))
                    made += 1
                    words, parts, ids, chosen, held = Words(), [], [], [], 0
        if ids:
            yield table(list(closed(words, parts, ids, chosen)))

    return run


def _summed(table):
    """Keys of a bucket with their totals, and each part's place among them."""
    import numpy as np

    parts = [_keys(k) for k in table.column("keys").to_pylist()]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    ends = np.cumsum([len(p) for p in parts])
    counts = [_plain(c, "<i4").reshape(-1, len(p)) for c, p in zip(table.column("counts").to_pylist(), parts)]
    total = np.stack([np.bincount(at, x, len(keys)).astype(np.int64) for x in np.concatenate(counts, axis=1)])
    return keys, total, np.split(at.reshape(-1), ends[:-1])


def _answered(table):
    """What a bucket sends back: the totals of the keys of each chunk, in the chunk's order."""
    import pyarrow as pa

    _, total, parts = _summed(table)
    out = [_planes(total[:, p].reshape(-1)) for p in parts]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "keys": pa.nulls(len(out), pa.binary()), "counts": pa.array(out, pa.binary()), "docs": pa.nulls(len(out), pa.binary())})


def _distinct(table):
    import numpy as np
    import pyarrow as pa

    return pa.table({"n": pa.array([len(np.unique(np.concatenate([_keys(k) for k in table.column("keys").to_pylist()])))], pa.int64())})


def _losses(bits: int, tokens_of: tuple[int, int], size: int, weight: float):
    def run(table):
        import numpy as np
        import pyarrow as pa

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "keys", "counts", "docs"))), key=lambda r: r[0])
        _, hashes, tokens, docs = rows[0]
        hashes = _keys(hashes)
        often, tokens = np.split(_plain(tokens, "<i4").astype(np.int64), [len(hashes)])
        tokens = np.argsort(_ranks(often))[tokens]
        ids, nulls, lengths, chosen = _plain(docs, "<i8").reshape(4, -1)
        n = len(ids)
        keys, a, b, at = _pairs(hashes, tokens, lengths, _shift(bits))
        none = np.zeros((2, 0), np.int64)
        word = np.concatenate([_plain(c, "<i8").reshape(4, -1) for k, _, c, _ in rows[1:] if k < 1 << bits], axis=1)
        pair = np.concatenate([none, *(_plain(c, "<i8").reshape(2, -1) for k, _, c, _ in rows[1:] if k >= 1 << bits)], axis=1)
        back = np.empty_like(word)
        back[:, np.argsort(hashes, kind="stable")] = word
        # the distinct pairs of each document, and what the document itself has of them, of their contexts and of their words
        code, times = np.unique(np.repeat(np.arange(n), lengths) * max(1, len(keys)) + at, return_counts=True)
        doc, which = code // max(1, len(keys)), code % max(1, len(keys))
        a, b = a[which], b[which]

        def own(w):
            _, place = np.unique(doc * len(hashes) + w, return_inverse=True)
            return np.bincount(place.reshape(-1), times)[place.reshape(-1)]

        own_context, own_word = own(a), own(b)
        means = []
        for k, share in ((0, tokens_of[1] / max(1, tokens_of[0])), (1, 1.0)):
            # of the background everything is the document's own, of the target only what it gave to it
            mine = 1 if k == 0 else chosen[doc]
            left = tokens_of[k] - (lengths if k == 0 else lengths * chosen)
            single = (share * (back[k, b] - mine * own_word) + 1.0) / (share * left[doc] + size)
            context = back[2 + k, a] - mine * own_context
            # the weight of a context grows with what was seen of it
            trust = share * context / (share * context + weight)
            loss = -np.log(trust * (pair[k, which] - mine * times) / np.maximum(context, 1) + (1 - trust) * single)
            means.append(np.bincount(doc, loss * times, n) / np.maximum(lengths, 1))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=nulls == 1), "n_tokens": pa.array(lengths), "target_loss": pa.array(means[1]), "background_loss": pa.array(means[0])})

    return run


def _flagged(rows: DataFrame, ids: DataFrame, marks: int) -> DataFrame:
    """(doc_id, text, chosen) of every row, chosen where its doc_id is in ``ids``.

    Ids that fit into ``marks`` bitmaps are broadcast as such, so that texts
    stay where they are; beyond that, texts are shuffled to an exact join.
    """
    bucket, position = F.bitmap_bucket_number("doc_id"), F.bitmap_bit_position("doc_id")
    if ids.select(bucket).distinct().limit(marks + 1).count() > marks:
        found = rows.join(ids.distinct().withColumn("chosen", F.lit(True)), "doc_id", "left")
        return found.select("doc_id", "text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    bitmaps = ids.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bitmap"))
    probed = rows.withColumns({"bucket": bucket, "bit": position.cast("int")}).join(F.broadcast(bitmaps), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return probed.select("doc_id", "text", F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False)).alias("chosen"))


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, words: int | None = None, classes: int = 1, weight: float = 50.0, marks: int = MARKS, chunk_tokens: int = CHUNK, bucket_chars: int = BUCKET
) -> DataFrame:
    """Scores every row of ``docs`` by mean loss under the target model less that under the background model.

    Returns doc_id, n_tokens, target_loss, background_loss, difference; lower
    is more like the target.  The background is every row, the target the rows
    whose doc_id is in ``target_ids``; from both, the row that is scored is
    left out.  The background's counts are multiplied by the target's share of
    its tokens.  Every word and pair of the corpus is counted as itself.
    Single words are smoothed by one over ``words`` (those of the corpus, where
    not more are given) and ``classes`` unseen ones.

    Null and empty texts have no tokens and zero losses.  Repeated rows count
    each time, so a row's copies stay when it is left out.  Null doc_ids are
    scored and never belong to the target.  Without any target row both models
    are flat and differences zero.  An empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, -(-chars // bucket_chars) - 1).bit_length()
    schema = "chunk bigint, bucket bigint, keys binary, counts binary, docs binary, background bigint, target bigint"
    coded = written(_flagged(rows, ids, marks).mapInArrow(_coded(bits, chunk_tokens), schema), "chunks")
    tokens_of = tuple(coded.agg(F.coalesce(F.sum("background"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first())
    coded = coded.drop("background", "target")
    asked = coded.where("bucket >= 0")
    seen = asked.where(F.col("bucket") < 1 << bits).select("bucket", "keys").groupBy("bucket").applyInArrow(_distinct, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    size = max(seen - 1, words or 0) + classes  # word 0 is none of the corpus
    answers = asked.groupBy("bucket").applyInArrow(_answered, coded.schema)
    scored = coded.where("bucket < 0").unionByName(answers).groupBy("chunk").applyInArrow(
        _losses(bits, tokens_of, size, weight), "doc_id bigint, n_tokens bigint, target_loss double, background_loss double"
    )
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
