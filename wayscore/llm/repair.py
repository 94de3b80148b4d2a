"""Operator 11: repair of conversation structure by a rank-compressed dynamic programme.

Turns are kept, reroled or deleted and empty turns are inserted, so that the
roles read ``(s?(ua)+)?`` at the least cost; of equally cheap repairs the one
whose audit (the edits' initials in order) is least in ASCII counts.

A layer of the programme is a turn, its macro edits are a run of inserts and
the turn's own edit.  Their codes, such as ``IK``, end with the one letter that
isn't ``I``: no audit of a layer is a prefix of another one, so appending codes
never changes their order.  Hence four costs and four ranks stand for the audits
of a layer, and parent pointers give the chosen one back in the end.  Layers that
differ by a constant cost are one state of an automaton, whose steps are cached.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import small_batches, written

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  What a role leads to, and the role that each state waits for.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WAITS = "uuau"
NAMES = {"u": "user", "a": "assistant"}
SOUND, GONE, OPEN = 0, 1, 2  # a turn's fault: none, must be deleted, truncated
AUDITS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def macro_edits(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, code): the best macro edit of a turn between each two states.

    Runs of up to two inserts reach every state that longer ones reach, at less cost.
    """
    best: dict = {}
    for before in range(4):
        mid = before
        for run in range(3):
            ways = [(mid, DELETE, "D")]
            if fault != GONE:
                extra = CUT_OFF if fault == OPEN else 0
                ways.append((NEXT[mid, WAITS[mid]], REROLE + extra, "R"))
                if (mid, initial) in NEXT:
                    ways.append((NEXT[mid, initial], KEEP + extra, "K"))
            for after, cost, letter in ways:
                found = (INSERT * run + cost, "I" * run + letter)
                best[before, after] = min(best.get((before, after), found), found)
            mid = NEXT[mid, WAITS[mid]]
    return [(before, after, cost, code) for (before, after), (cost, code) in best.items()]


class Layers:
    """Steps of the programme; a layer is ((cost, rank) or None for each state), costs less their minimum."""

    START = ((0, 0), None, None, None)

    def __init__(self):
        self._moves: dict = {}
        self._steps: dict = {}

    def step(self, layer: tuple, initial: str, fault: int) -> tuple:
        """(next layer, what its costs are less, (state before, code) of each state)."""
        if (layer, initial, fault) in self._steps:
            return self._steps[layer, initial, fault]
        if (initial, fault) not in self._moves:
            self._moves[initial, fault] = macro_edits(initial, fault)
        won: list = [None] * 4
        for before, after, cost, code in self._moves[initial, fault]:
            if layer[before] is not None:
                base, rank = layer[before]
                found = (base + cost, rank, code, before)
                won[after] = found if won[after] is None else min(won[after], found)
        least = min(w[0] for w in won if w)
        order = sorted(w[1:3] for w in won if w)
        made = tuple(w and (w[0] - least, order.index(w[1:3])) for w in won)
        out = self._steps[layer, initial, fault] = (made, least, tuple(w and (w[3], w[2]) for w in won))
        return out

    @staticmethod
    def finish(layer: tuple) -> tuple[int, int, str]:
        """(cost, state, code of the inserts at the end) of the best way to a complete pattern."""
        ends = [(layer[s][0] + INSERT * run, layer[s][1], s, "I" * run) for s, run in ((0, 0), (3, 0), (2, 1), (1, 2)) if layer[s] is not None]
        cost, _, state, code = min(ends)
        return cost, state, code


def audit_of(turns, layers: Layers) -> tuple[int, str]:
    """Cost and audit of the best repair of (initial, fault) pairs."""
    layer, total, back = Layers.START, 0, []
    for initial, fault in turns:
        layer, least, parents = layers.step(layer, initial, fault)
        total += least
        back.append(parents)
    cost, state, code = Layers.finish(layer)
    codes = [code]
    for parents in reversed(back):
        state, code = parents[state]
        codes.append(code)
    return total + cost, "".join(reversed(codes))


def _facts(turns: DataFrame, gone: Column | None) -> DataFrame:
    """conv_id, turn, gone, role, text, a digest that orders turns of one number, and what the text shows: 1 blank, 2 truncated."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), (F.lit(False) if gone is None else gone).alias("gone"), role.alias("role"), text.alias("text"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    shown = F.when(trimmed == "", 1).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256), 1, 32))
    return rows.where("conv_id is not null").withColumns({"digest": digest, "shown": shown.cast("tinyint")})


#: Nulls come first.
ORDER = ("turn", "digest")


def _audited(batches: Iterator) -> Iterator:
    import pyarrow as pa

    layers, now, rows = Layers(), None, []
    names = [f.split()[0] for f in AUDITS.split(", ")]

    def closed():
        cost, audit = audit_of(pairs, layers)
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        return (now, gaps, *counts, illegal, cost, audit)

    def flushed():
        kinds = [pa.string() if n == "audit" else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for conv, turn, gone, initial, digest, shown in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now:
                if now is not None:
                    rows.append(closed())
                now, pairs, seen, counts, illegal, before, turns = conv, [], set(), [0, 0, 0], 0, None, [0, 0, 0]
            if gone:
                continue
            if turn is not None:
                turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns[2] else [turn, turn, 1]
            kind = 0 if shown == 1 else 1 if digest in seen else 2 if shown == 2 else None
            seen.add(digest)
            if kind is not None:
                counts[kind] += 1
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            pairs.append((initial, SOUND if kind is None else OPEN if kind == 2 else GONE))
        if rows:
            yield flushed()
            rows = []
    if now is not None:
        rows.append(closed())
        yield flushed()


def audits(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """The faults of each conversation of ``turns`` (conv_id, turn, role, text), and the cost and audit of its best repair.

    Faults: blank (nothing but white space), duplicate (role and text of an
    earlier turn of the conversation), truncated (the last visible character
    is none of ``.!?``); the first that holds counts.  Blank and duplicate turns
    must be deleted; a truncated one that stays costs more.  Turns go by their
    number, null first, those of one number by a digest of role and text.
    Null roles and texts count as one space.  A role whose first letter isn't
    s, u or a (an empty one too) can't stay as it is.  Rows without a conv_id
    belong to no conversation; rows marked by ``gone`` only show that theirs
    exists.  Other columns are ignored; an empty table gives no rows.

    A task holds some 200 bytes a turn of one conversation at a time, no texts.
    """
    rows = _facts(turns, gone).select("conv_id", "turn", "gone", F.left("role", F.lit(1)).alias("initial"), "digest", "shown")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return dealt.mapInArrow(_audited, AUDITS)


def _repaired(batches: Iterator) -> Iterator:
    import pyarrow as pa

    out: list = []
    now, edits, state, at = None, iter(""), 0, 0

    def put(conv, letter, role, text):
        nonlocal state, at
        out.append((conv, at, letter, role, text))
        state, at = NEXT[state, role[0]], at + 1

    def inserted_until_turn(conv):
        """The edit of the next turn, after the inserts before it; None at the end."""
        for letter in edits:
            if letter != "I":
                return letter
            put(conv, "I", NAMES[WAITS[state]], "")
        return None

    for batch in batches:
        for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                inserted_until_turn(now)
                now, edits, state, at = conv, iter(audit), 0, 0
                continue
            letter = inserted_until_turn(conv)
            if letter != "D":
                put(conv, letter, role if letter == "K" else NAMES[WAITS[state]], text)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("conv_id", "at", "edit", "role", "text"), zip(*out))), schema=_schema())
            out = []
    inserted_until_turn(now)
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(("conv_id", "at", "edit", "role", "text"), zip(*out))), schema=_schema())


def _schema():
    import pyarrow as pa

    return pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repaired(turns: DataFrame, audited: DataFrame, gone: Column | None = None) -> DataFrame:
    """The turns of the repaired conversations: conv_id, at (from zero), edit (K, R or I), role, text.

    Each audit comes before the texts of its conversation, which stream past
    it: no task holds a conversation.  The turns of a conversation follow each
    other in one partition.
    """
    small_batches(turns.sparkSession)
    body = _facts(turns, gone).where("not gone").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "digest", "role", "text")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("digest", "binary"), ("role", "string"), ("text", "string"))]
    dealt = audited.select("conv_id", "audit", *none).unionByName(body).repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER)
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(_repaired, "conv_id bigint, at bigint, edit string, role string, text string")


def _hashed(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    now, state, rows = None, None, []

    def flushed():
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "repaired_sha256": pa.array([r[1] for r in rows], pa.string())})

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now:
                if now is not None:
                    rows.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if rows:
            yield flushed()
            rows = []
    if now is not None:
        rows.append((now, state.hexdigest()))
        yield flushed()


def repair_report(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """``audits`` with a SHA-256 of each repaired conversation, its turns as ``role:text`` joined by line feeds."""
    told = written(audits(turns, gone), "audits")
    hashes = repaired(turns, told, gone).select("conv_id", "role", "text").mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")
    return told.join(hashes, "conv_id", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32(``conv_id:turn``) % 20: 0 marks a row as gone, 1 empties its text, 2 takes away its ``.!?``, 3 repeats it, 4 makes its role user.

    Nulls in role, text and the hashed turn become one space.
    """
    kind = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), copies.alias("copy")).drop("copy")
