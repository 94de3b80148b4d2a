"""Operator 4: packing token sequences by the sum-of-squares rule.

A document gives whole windows of its own and one tail.  Tails are placed
online: the fill level that a tail is put on is the one that makes the sum of
squared counts of partly filled windows smallest, with the counts held in one
array of fill levels, a few tokens wide each.  A window is closed when it is
full to the last token: a tail may overshoot it, and what overshoots is placed
next.  Each Spark partition runs its own instance, in a
fixed order, so a task that is run again gives the same rows.  When a
partition's tails are all placed, the few windows still partly filled are laid
end to end and cut at the window size; what is left over is cut at powers of
two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import small_batches

WINDOW = 2048
END_ID = 1
#: Fill levels that windows are told apart by.
LEVELS = 64
#: Price, in squared counts, of cutting a document by a level or more.
CUT = 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _rank_encoder(path: str):
    """The same vocabulary as a rank table, with the bytes of each id; or None where its merges don't stand in the order of their ids."""
    import json

    import numpy as np
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    # byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    if any(a >= b for a, b in zip(merged, merged[1:])) or len(ranks) != 256 + len(merged):
        return None
    length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    length[list(ranks.values())] = [len(token) for token in ranks]
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, length


def token_encoder(path: str):
    """A function from a list of texts to a list of uint32 id arrays.

    Ordinary texts are cut at blanks with Arrow and each distinct piece is
    encoded once per task; the vocabulary's pre-tokenizer never joins text
    across those cuts.  Texts with other white space, runs of three, or
    special tokens go to the tokenizer whole.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    odd = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    odd += [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
    odd += [a + b + c for a in " \n" for b in " \n" for c in " \n"]
    ranked = _rank_encoder(path)
    state: dict = {}

    def whole(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    def fresh():
        state.update(index={}, pool=np.zeros(1 << 16, dtype=np.uint32), used=0, start=np.zeros(0, dtype=np.int64), size=np.zeros(0, dtype=np.int64))
        learn(["", "\n"])

    def encoded(pieces):
        """Ids of all pieces end to end, and the number of each piece's ids."""
        plain = [p for p in pieces if p and p[0] != "\r" and p != "\n"] if ranked else []
        rest = [p for p in pieces if not (p and p[0] != "\r" and p != "\n")] if ranked else pieces
        ids, sizes = [], []
        if plain:
            # each begins with white space of its own, so together they are cut as they are alone
            spelled = [p if p[0] == "\n" else " " + p for p in plain]
            encode, length = ranked
            ids = encode("".join(spelled))
            ends = np.cumsum(np.asarray(pc.binary_length(pa.array(spelled, pa.large_string()))))
            last = np.searchsorted(np.cumsum(length[ids]), ends)
            sizes = np.diff(last, prepend=-1).tolist()
        for p in rest:
            own = whole(p[1:] if p[:1] == "\r" else p if p == "\n" else " " + p)
            ids.extend(own)
            sizes.append(len(own))
        return plain + rest, ids, sizes

    def learn(pieces):
        names, ids, sizes = encoded(pieces)
        first, sizes = len(state["start"]), np.asarray(sizes, dtype=np.int64)
        state["index"].update(zip(names, range(first, first + len(names))))
        state["start"] = np.append(state["start"], state["used"] + np.cumsum(sizes) - sizes)
        state["size"] = np.append(state["size"], sizes)
        while state["used"] + len(ids) > len(state["pool"]):
            state["pool"] = np.concatenate([state["pool"], np.zeros_like(state["pool"])])
        state["pool"][state["used"] : state["used"] + len(ids)] = ids
        state["used"] += len(ids)

    fresh()

    def encode(texts):
        out = [None] * len(texts)
        every = "\0".join(texts)
        found = [x for x in odd if x in every]
        plain = []
        for i, text in enumerate(texts):
            if text[-2:].isspace() and len(text) > 1 or found and any(x in text for x in found):
                out[i] = np.asarray(whole(text), dtype=np.uint32)
            else:
                plain.append(i)
        if not plain:
            return out
        # a first piece is marked by \r, a line's first by \n, all others had a blank before them
        lists = pc.split_pattern(pa.array(["\r" + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
        bounds = np.asarray(lists.offsets)
        coded = lists.values.dictionary_encode()
        codes = np.asarray(coded.indices)
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(state["index"]) > 400_000:  # memory bound; forgotten pieces are encoded again
            fresh()
        index = state["index"]
        if new := [u for u in units if u not in index]:
            learn(new)
        at = np.fromiter(map(index.__getitem__, units), dtype=np.int64, count=len(units))
        sizes = state["size"][at][codes]
        ends = np.cumsum(sizes)
        source = np.arange(int(ends[-1])) + np.repeat(state["start"][at][codes] - (ends - sizes), sizes)
        ids = state["pool"][source]
        cuts = np.concatenate([[0], ends])[bounds]
        for k, i in enumerate(plain):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        return out

    return encode


def _windows(path: str, window: int, end_id: int):
    """Per document: its pieces of a window at most, with their ids."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = token_encoder(path)
        names = ["doc_id", "start", "doc_tokens", "ids"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = ([], [], [], [])
            held = 0
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    for column, value in zip(rows, (doc, start, len(ids), ids[start : start + window].tobytes())):
                        column.append(value)
                held += len(ids)
                if held > 4_000_000:  # few long texts to a batch
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)
                    rows, held = ([], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    return run


class SumOfSquares:
    """Online placing of sizes below ``window`` into windows, by an array of ``levels`` fill levels.

    A size goes on the level that makes the sum of squared counts of partly
    filled windows smallest, or into a new window; of equal changes on the
    fullest level.  It may overshoot its window: the window is then full, and
    what overshoots comes back to be placed next.  By a level or more that
    costs CUT besides, so it happens where windows of one level pile up, as
    with sizes that don't add up to a window, and no level holds many.
    """

    def __init__(self, window: int, levels: int = LEVELS):
        import numpy as np

        self.np, self.window = np, window
        self.grain = -(-window // levels)
        self.levels = -(-window // self.grain)
        self.counts = np.zeros(self.levels + 1, dtype=np.int64)  # the last stands for full windows and stays 0
        #: Fill of the window that is next on each level.
        self.next = np.zeros(self.levels, dtype=np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(self.levels)]

    def level(self, size: int) -> int | None:
        """The level that ``size`` goes on; None for a new window."""
        np, counts = self.np, self.counts
        after = self.next + size
        to = np.minimum(after, self.window) // self.grain
        to[after >= self.window] = self.levels
        change = 2 * (counts[to] - counts[:-1]) + 2
        change[to == self.levels] -= 1  # a full window adds to no level
        change[to == np.arange(self.levels)] = 0
        change[after >= self.window + self.grain] += CUT
        change = np.where(counts[:-1] > 0, change, np.iinfo(np.int64).max)
        best = int(self.levels - 1 - np.argmin(change[::-1]))
        return best if change[best] <= 2 * counts[size // self.grain] + 1 else None

    def place(self, size: int, item) -> tuple[list, int] | None:
        """Places ``item``; for a window that it fills, returns that window's items and by how much the last overshoots."""
        at = self.level(size)
        fill, held = 0, []
        if at is not None:
            fill, held = self.open[at].pop()
            self.counts[at] -= 1
            self.next[at] = self.open[at][-1][0] if self.open[at] else 0
        held.append(item)
        if fill + size >= self.window:
            return held, fill + size - self.window
        to = (fill + size) // self.grain
        self.open[to].append((fill + size, held))
        self.counts[to] += 1
        self.next[to] = fill + size
        return None

    def rest(self) -> list[list]:
        """The items of the windows that are still partly filled, the fullest first."""
        return [held for level in self.open[::-1] for _, held in level]


def _packed(window: int, levels: int):
    fields = ["doc_id", "start", "doc_tokens", "sequence_id", "offset", "placed", "ids"]
    kinds = ["int64"] * 5 + ["bool_", "binary"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        made = held = 0
        rule = SumOfSquares(window, levels)
        out: list[tuple] = []

        def close(items: list, placed: bool) -> None:
            nonlocal made, held
            offset = 0
            for doc, start, n, ids in items:
                out.append((doc, start, n, base + made, offset, placed, ids))
                offset += len(ids) // 4
            made, held = made + 1, held + offset

        def flush():
            nonlocal held
            columns = list(zip(*out)) or [()] * len(fields)
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, getattr(pa, k)()) for c, k in zip(columns, kinds)], fields)

        def cut(item, size: int) -> tuple:
            doc, start, n, ids = item
            return (doc, start, n, ids[: 4 * size]), (doc, start + size, n, ids[4 * size :])

        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns)):
                while item:
                    size = len(item[3]) // 4
                    if size == window:
                        close([item], True)
                        break
                    full = rule.place(size, item)
                    item = None
                    if full:
                        items, over = full
                        if over:
                            items[-1], item = cut(items[-1], len(items[-1][3]) // 4 - over)
                        close(items, True)
            if held > 1_000_000:
                yield flush()
        # the last windows, still partly filled: end to end, cut at the window, the remainder at powers of two
        queue = [item for items in rule.rest() for item in items][::-1]
        left = sum(len(item[3]) // 4 for item in queue)
        while left:
            room = window if left >= window else 1 << (left.bit_length() - 1)
            items, need = [], room
            while need:
                item = queue.pop()
                if len(item[3]) // 4 > need:
                    item, later = cut(item, need)
                    queue.append(later)
                items.append(item)
                need -= len(item[3]) // 4
            close(items, False)
            left -= room
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = END_ID, levels: int = LEVELS) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text) into sequences of at most ``window`` ids.

    Returns one row per piece: doc_id, start (its document's ids before it),
    doc_tokens, sequence_id, offset, placed (false for the pieces of the last
    windows of a partition, which are cut end to end), and ids, the piece's
    ids as little-endian unsigned 32-bit integers.

    A null or empty text is the end id alone.  Repeated rows and null doc_ids
    are packed like any other.  An empty table gives no rows.  Other columns
    are ignored.  Sequence ids are unique, not dense.  Pieces are dealt by a
    hash of doc_id, start and ids, so no source or group of copies gathers in
    a task, and each task holds the few open windows of each level, whatever it
    reads.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_windows(path, window, end_id), "doc_id bigint, start bigint, doc_tokens bigint, ids binary")
    keys = ("doc_id", "start", F.xxhash64("ids"))
    dealt = pieces.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys)
    out = "doc_id bigint, start bigint, doc_tokens bigint, sequence_id bigint, offset bigint, placed boolean, ids binary"
    return dealt.mapInArrow(_packed(window, levels), out)


def digested(pieces: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The pieces with the length and checksum of their ids, and the ids themselves where ``keep_ids``."""
    length = (F.octet_length("ids") / 4).cast("bigint").alias("length")
    columns = ["doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "placed"]
    return pieces.select(*columns, *(["ids"] if keep_ids else []))
