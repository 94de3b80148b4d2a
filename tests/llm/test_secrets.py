"""The secret scan: likelihood and decoding against brute force, patterns against the statement, planted and clean texts."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayscore.llm import secret_spans as S


def scored(tags, scores, moves):
    """The score of a tagging, written out; None where an inside follows an outside."""
    total, last = 0.0, 0
    for tag, (b, i) in zip([*tags, 0], [*scores, (0, 0)]):
        if tag == 2:
            if not last:
                return None
            total += moves[last] + i
        else:
            total += (0, moves[3], moves[4])[last] + (moves[0] + b if tag else 0)
        last = tag
    return total


def test_viterbi_against_all_taggings():
    rng = np.random.default_rng(3)
    for _ in range(300):
        scores, moves = rng.normal(size=(rng.integers(1, 6), 2)) * 2, rng.normal(size=5)
        every = [v for t in itertools.product(range(3), repeat=len(scores)) if (v := scored(t, scores, moves)) is not None]
        assert scored(S.viterbi(scores.tolist(), moves), scores, moves) == pytest.approx(max(every))


def test_likelihood_against_all_taggings_and_differences():
    rng = np.random.default_rng(4)
    rows, starts = rng.integers(0, 12, size=(11, 3)), np.array([0, 3, 4, 8])
    tags, w, m = np.array([0, 1, 2, 0, 1, 2, 2, 1, 0, 1, 1]), rng.normal(size=(12, 2)), rng.normal(size=5)
    value, grad_w, grad_m = S.likelihood(w, m, rows, starts, tags)
    expected = 0.0
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        scores = w[rows[a:b]].sum(axis=1)
        every = [v for t in itertools.product(range(3), repeat=b - a) if (v := scored(t, scores, m)) is not None]
        expected += scored(tags[a:b], scores, m) - np.logaddexp.reduce(every)
    assert value == pytest.approx(expected)
    for at in np.ndindex(w.shape):
        near = w.copy()
        near[at] += 1e-6
        assert (S.likelihood(near, m, rows, starts, tags)[0] - value) / 1e-6 == pytest.approx(grad_w[at], abs=1e-3)
    for at in range(5):
        near = m.copy()
        near[at] += 1e-6
        assert (S.likelihood(w, near, rows, starts, tags)[0] - value) / 1e-6 == pytest.approx(grad_m[at], abs=1e-3)


def test_patterns():
    a, k, h = "password: 'abcdefghijkl'", "AKIA" + "B" * 14, "0123456789abcdef"
    text = f"é {a} {k} x{h}g AKIA123 deadbeef token=short API-key = {h} api_key\"  =  {h}"
    found = [(kind, text[s:e]) for s, kind, e in S.base_spans(text)]
    assert ("assign", a[:-1]) in found and ("access", k) in found and found.count(("hex", h)) == 3
    assert ("assign", f'api_key"  =  {h}') in found and len(found) == 6
    # a failing match takes its characters with it
    assert S.base_spans("token=shortſecret=abcdefghijklm")[0:0] == [] and S.base_spans("ſecret=abcdefghijklm") == []


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def field(spark, texts):
    import pickle

    return S.Field(*pickle.loads(S.fit(texts.where("doc_id % 5 <> 0"))))


def test_planted_secrets_of_held_out_documents(field, texts):
    """Keys of many alphabets in texts that were not learned from, behind words that no pattern knows."""
    rng, decoder = np.random.default_rng(9), S.Decoder(field)
    held = [r.text for r in texts.where("doc_id % 5 = 0 and text is not null").collect()]
    clean = [t for t in held if not S.base_spans(t) and len(t.split()) > 20][:120]
    marked = sum(bool(decoder.spans(t)) for t in clean)
    hits = exact = 0
    for t in clean:
        words, key = t.split(" "), S.random_secret(rng)
        at = int(rng.integers(1, len(words)))
        planted = " ".join([*words[:at], f'key: "{key}"', *words[at:]])
        where = planted.index(key)
        spans = decoder.spans(planted)
        hits += any(a < where + len(key) and b > where for a, b in spans)
        exact += (where, where + len(key)) in spans
    assert len(clean) > 50 and marked <= 0.02 * len(clean)
    assert hits >= 0.9 * len(clean) and exact >= 0.8 * len(clean)


def test_bounds_lose_nothing(field, texts):
    """Decoding every chunk gives what decoding the chunks above the bound gives, in parts or whole."""

    class All(S.Decoder):
        def _decoded(self, *args):
            self.bound[:] = 1e9
            return super()._decoded(*args)

    class Parts(S.Decoder):
        KEPT = 64

    held = [r.text for r in texts.where("text is not null").limit(150).collect()] + ['x key="' + "aB3" * 9 + '", y']
    fast, every, parts = S.Decoder(field), All(field), Parts(field)
    assert all(fast.spans(t) == every.spans(t) == parts.spans(t) for t in held)


def test_hostile_texts(spark, texts):
    key = "3f9A" * 10
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, f"secret: {key}"), (4, f"token = '{key}'"), (4, f"token = '{key}'"), (5, "wort " * 30000 + f'é key="{key}"'), (6, "a" * 200_000), (7, "=" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"spans": F.lit(1), "kind": F.lit("x"), "h": F.lit(2)})
    got = S.digested(S.secret_spans(df, training=texts)).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7]
    assert [r.n_assign for r in got] == [1, 0, 0, 0, 1, 1, 0, 0, 0]
    assert [r.n_hex for r in got] == [0, 0, 0, 0, 0, 0, 0, 1, 0]
    assert got[1].spans == "" and got[1].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    start = 150_000 + 7
    assert re.fullmatch(rf"field:{start}:{start + 40}", got[6].spans)
    assert S.secret_spans(df.limit(0)).count() == 0


def test_digests_by_statement(spark, texts):
    import hashlib

    some = texts.where("text is not null").limit(200)
    for r, text in zip(S.digested(S.secret_spans(some)).orderBy("doc_id").collect(), [x.text for x in some.orderBy("doc_id").collect()]):
        found = [(m.start(), 0, m.end()) for m in S.ASSIGN.finditer(text) if len(m.group(2)) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
        base = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if not x.startswith("field")] == base.split(",")
