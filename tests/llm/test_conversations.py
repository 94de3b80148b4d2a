"""Repair of conversations and the prefix trie, against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from wayscore.llm import repair, trie
from wayscore.llm.common import written

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, audit, repaired turns and faults of (role, text) rows, by search over all edits."""
    seen, faults = set(), []
    for row in rows:
        shown = row[1].strip(BLANK)
        faults.append("b" if not shown else "d" if row in seen else "" if shown[-1] in ".!?" else "t")
        seen.add(row)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if (i, roles) in done:
            continue
        done.add((i, roles))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out, faults
        ways = [(cost + 5, audit + "I", i, roles + n[0], (*out, (n, ""))) for n in ("user", "assistant") if len(roles) < 2 * len(rows) + 3]
        if i < len(rows):
            role, text = rows[i]
            ways.append((cost + 2, audit + "D", i + 1, roles, out))
            if faults[i] not in ("b", "d"):
                more = cost + 5 * (faults[i] == "t")
                if role:
                    ways.append((more, audit + "K", i + 1, roles + role[0], (*out, rows[i])))
                ways += [(more + 1, audit + "R", i + 1, roles + n[0], (*out, (n, text))) for n in ("user", "assistant")]
        for way in ways:
            if re.fullmatch("(s?(ua)*u?)?", way[3]):
                heapq.heappush(heap, way)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()[:16]))


def reported(table):
    """op11's rows by brute force, from (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in table:
        if conv is None:
            continue
        kept = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in found.items():
        rows = in_order(rows)
        cost, audit, made, faults = cheapest([r[1:] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def report(spark, df):
    rows = repair.repair_report(repair.damaged(df), F.col("gone")).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_programme_against_search():
    rng, layers = random.Random(5), repair.Layers()
    kinds = {"": 0, "b": 1, "d": 1, "t": 2}
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", " ", "user", "assistant"]), rng.choice(["a.", "b", "c!", "", "d?", "x y.", "q"])) for _ in range(rng.randint(0, 6))]
        cost, audit, _, faults = cheapest(rows)
        assert repair.audit_of([(role[:1], kinds[f]) for (role, _), f in zip(rows, faults)], layers) == (cost, audit), rows


def test_repair_of_hostile_rows(spark):
    rng = random.Random(7)
    roles, texts = ["system", "user", "assistant", None, "tool", "", "user", "assistant"], ["a.", "b", None, "", " \t", "c?\n", "é!", "d\x0b.", "long " * 3000 + "."]
    rows = [(c, rng.choice([None, 0, 1, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 6))]
    rows += rows[:20] + [(None, 1, "user", "x."), (-5, None, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"gone": F.lit("extra"), "audit": F.lit(1), "kind": F.lit(2)}).repartition(5)
    assert report(spark, df) == reported(rows)


def test_repair_of_the_tables_and_repaired_turns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert report(spark, df) == reported(rows)
    turns = repair.damaged(df)
    out = repair.repaired(turns, repair.audits(turns, F.col("gone")), F.col("gone")).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    for conv, made in by.items():
        assert [r["at"] for r in made] == list(range(len(made)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in made))
        assert all(r.text == "" for r in made if r.edit == "I")


def test_repair_of_empty_tables_and_whole_losses(spark):
    assert report(spark, spark.createDataFrame([], SCHEMA)) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    got = report(spark, spark.createDataFrame([(lost, 1, "user", "a.")], SCHEMA))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_long_conversation(spark):
    rows = [(3, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(5000) if t % 7]
    got = report(spark, spark.createDataFrame(rows, SCHEMA))[3]
    assert len(got[6].replace("I", "")) == sum(1 if zlib.crc32(f"3:{t}".encode()) % 20 not in (0, 3) else 2 * (zlib.crc32(f"3:{t}".encode()) % 20 == 3) for _, t, _, _ in rows)


# -- the trie -----------------------------------------------------------------


def nodes_of(table):
    convs: dict = {}
    for conv, turn, role, text in table:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role or "", text or ""))
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest())
    convs = {c: [r[1:] for r in sorted(v, key=key)] for c, v in convs.items()}
    made = {c: tuple(convs.get(c - int(math.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)]) + tuple(v[h:]) for c, v in convs.items()}
    members: dict = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids: dict = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if made[c] == p))).encode()).hexdigest()
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], ends)
    return out


def trie_of(spark, df):
    rows = trie.prefix_trie(*trie.regrafted(written(trie.numbered(df), "numbered"))).collect()
    assert len({r[:2] for r in rows}) == len(rows)
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}


def test_trie_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert trie_of(spark, df) == nodes_of([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_hostile_rows(spark, monkeypatch):
    """Ties, nulls, copies, turnless conversations, a base that is absent, and slices and chunks of a few rows."""
    monkeypatch.setattr(trie, "SLICE", 3)
    monkeypatch.setattr(trie, "CHUNK", 2)
    monkeypatch.setattr(trie, "STRETCH", 2)
    rng = random.Random(11)
    rows = [(c, rng.choice([None, 0, 1, 2, 2, 5, 8]), rng.choice(["user", None, "a"]), rng.choice(["x", "x y", None, "z\tz z", ""])) for c in range(0, 90) for _ in range(rng.randint(1, 4))]
    rows += [(c, t, "u", f"w {t}") for c in range(200, 220) for t in range(6)] + [(900, t, "u", f"w {t}") for t in range(40)]
    rows += [(None, 1, "u", "x"), (1007, 1, "u", "a"), (-3, 1, "u", "b c")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "depth": F.lit("extra"), "words": F.lit(0)}).repartition(3)
    assert trie_of(spark, df) == nodes_of(rows)


def test_trie_of_one_conversation_and_of_none(spark):
    assert trie_of(spark, spark.createDataFrame([], SCHEMA)) == {}
    one = [(41, 1, "u", "x")]
    assert trie_of(spark, spark.createDataFrame(one, SCHEMA)) == nodes_of(one)
