"""Small fixtures against brute force, and hostile inputs for every operator."""

import itertools
import math
import re
import zlib

import pytest

from wayscore.llm import html, minhash, mixing, outliers, packing, quality, rollup, scoring, urls, vectors

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(i, n=80):
    return " ".join(f"w{(i * 7919 + k * k * 31 + k) % 997}" for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i), "en", "s0", 0) for i in range(1, 40)]
    rows += [(100 + i, "JUNK!! " * 60, "en", "s0", 0) for i in range(8)]
    rows += [(200, prose(1) + " tail", "en", "s1", 0), (201, prose(1).upper(), None, None, None), (201, prose(1).upper(), None, None, None)]
    rows += [(300, None, "en", "s0", None), (301, "", "en", "s0", 0), (302, " \n\t", None, "s0", 3), (303, "one two", "de", "s0", 7), (None, prose(2), "en", "s0", 0)]
    rows += [(400, prose(5, 30_000), "en", "s0", 0), (401, "a<|endoftext|>b  \t é　ü\n\n\n'ts", "fr", "s2", 0)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as rep", "1 as n", "0 as kept", "'x' as h")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, i % 2) for i in range(1, 30)] + [(100 + i, 0, 0) for i in range(8)] + [(None, 1, 0), (5, None, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


def brute_components(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = [x.lower() for x in WORD.findall(text or "")]
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_op1_equals_brute_force(docs):
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(got) == docs.count()
    expected = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == expected
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 200, 201)").count() == 1


def test_op1_doc_id_with_several_texts(spark):
    a, b, c = prose(1), prose(50), prose(90)
    rows = [(1, a), (5, a), (5, b), (9, b), (5, b.upper()), (7, c), (-3, c + " end"), (11, c), (11, prose(120)), (20, prose(120)), (30, prose(140)), (30, prose(150)), (31, None), (31, prose(150))]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == {(1, 1, True), (5, 1, False), (9, 1, False), (7, -3, False), (-3, -3, True), (11, -3, False), (20, -3, False), (30, 30, True), (31, 30, False), (31, 31, True)}
    kept = minhash.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len({r.doc_id for r in kept}) == len(kept)


def test_op1_halves_reach_the_recall():
    assert [minhash.halves_for(p) for p in (85, 80)] == [6, 8]
    for p in (30, 60, 80, 95, 100):
        m, s = minhash.halves_for(p), p / 100
        assert (1 - (1 - s * s) ** m) ** 2 >= 0.999


def test_op1_hot_hub_is_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SPLIT", 5)
    test_op1_star_of_variants(spark)


def test_op1_star_of_variants(spark):
    base = prose(3, 200).split()
    rows = []
    for i in range(60):
        words = list(base)
        for k in range(i % 9):
            words[(i * 13 + k * 17) % 200] = f"edit{i}x{k}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(rows, 3, 85)


def test_op2_meets_targets(docs, labels):
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    total = [sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS]
    assert all(abs(t / sum(total) - w) < 0.01 for t, w in zip(total, mixing.WEIGHTS.values()))
    assert {r.rate for r in rows if r.tokens == 0} == {1.0}


def test_op3_unlike_rows_of_one_vector(spark):
    """Whatever their order, the least row that can be linked stands for a vec_id."""
    rows = [(1, [1.0, 0.0]), (1, None), (1, []), (1, [float("nan"), 1.0]), (1, [0.0, 0.0]), (1, [2.0, 5.0]), (2, [1.0, 0.01])]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(order, "vec_id bigint, embedding array<double>").coalesce(1)).collect()}
        assert got == {1: (1, 1, True), 2: (1, 1, False)}


def test_op3_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(4, 16))
    x = [list(map(float, centre[i % 4] + rng.normal(size=16) * (0.02 if i % 3 else 0.35))) for i in range(150)] + [[0.0] * 16, [1.0, float("nan")] + [0.0] * 14, [1.0, 2.0], None, []]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(0, x[0], 5), (None, x[1], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as n", "2 as rep")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()}
    unit = np.array(x[:150], dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = list(range(150))
    for _ in range(150):
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(150)]
    expected = {i: (int(near[i].sum()) - 1, label[i], label[i] == i) for i in range(150)}
    assert {k: v for k, v in got.items() if k is not None and k < 150} == expected
    assert all(got[i] == (0, i, True) for i in range(150, 155)) and got[None] == (0, None, True)


def test_op4_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.digested(packing.pack(docs)).collect()
    whole = {}
    for r in pieces:
        whole.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        own = sorted(whole[r.doc_id], key=lambda p: (p.start, p.sequence_id))
        copies = 2 if r.doc_id == 201 else 1
        assert sum(p.length for p in own) == copies * len(ids) and {p.doc_tokens for p in own} == {len(ids)}
        for p in own:
            part = b"".join(i.to_bytes(4, "little") for i in ids[p.start : p.start + p.length])
            assert zlib.crc32(part) == p.ids_crc32
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op4_rule_prefers_balance():
    rule = packing.SumOfSquares(10, 10)
    assert rule.place(6, "a") is None and rule.place(6, "b") is None
    assert rule.place(4, "c") == (["b", "c"], 0) and rule.place(4, "d") == (["a", "d"], 0) and rule.rest() == []


def test_op4_rule_equals_brute_force():
    import random

    rng = random.Random(4)
    for window, levels in ((12, 12), (64, 8), (40, 7)):
        rule = packing.SumOfSquares(window, levels)
        for _ in range(400):
            size = rng.randint(1, window - 1)
            fills = [[fill for fill, _ in level] for level in rule.open]

            def squares(choice, size=size, fills=fills, rule=rule):
                counts = [len(f) for f in fills] + [0]
                fill = 0
                if choice is not None:
                    counts[choice] -= 1
                    fill = fills[choice][-1]
                if fill + size < rule.window:
                    counts[(fill + size) // rule.grain] += 1
                return sum(c * c for c in counts) + (packing.CUT if fill + size >= rule.window + rule.grain else 0)

            fits = [k for k, f in enumerate(fills) if f]
            least = min(map(squares, [None, *fits]))
            at = rule.level(size)
            assert (at is None or at in fits) and squares(at) == least
            assert at == max((k for k in fits if squares(k) == least), default=None)
            rule.place(size, size)
        held = [fill for level in rule.open for fill, _ in level]
        assert len(held) <= 5 * levels and all(0 < f < window for f in held)
    rule = packing.SumOfSquares(100, 10)
    for _ in range(1000):  # no two of them fit a window
        rule.place(60, "x")
    assert len(rule.rest()) <= 10


def test_op4_places_most_tails_by_the_rule(spark):
    rows = [(i, prose(i, 20 + (i * 37) % 400)) for i in range(600)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr("placed", "octet_length(ids) as n", "sequence_id").collect()
    assert sum(r.n for r in pieces if r.placed) > 0.8 * sum(r.n for r in pieces)
    full = {}
    for r in pieces:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.n // 4
    assert all(n == 2048 or n & (n - 1) == 0 for n in full.values())


def test_op5_prefers_the_target(spark):
    rows = [(i, "alpha beta gamma " * 20 if i % 2 else "delta epsilon zeta " * 20) for i in range(20)] + [(None, "alpha"), (50, None), (51, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 20, 2)] + [(None,)], "doc_id bigint")
    got = {r.doc_id: r for r in scoring.cross_entropy_difference(frame, target).collect()}
    assert max(got[i].difference for i in range(1, 20, 2)) < min(got[i].difference for i in range(0, 20, 2))
    assert (got[50].n_tokens, got[51].difference) == (0, 0.0)
    assert scoring.cross_entropy_difference(frame.limit(0), target).count() == 0


@pytest.mark.parametrize("marks", [scoring.MARKS, 0])
def test_op5_equals_brute_force(spark, marks):
    from collections import Counter

    texts = {i: prose(i, 30 + i) for i in range(1, 16)} | {-3: prose(2, 12), 40_000: "a b a b", 32_768: "b a", 50: None, 51: ""}
    chosen = {1, 4, -3, 40_000, 77}
    frame = spark.createDataFrame([*texts.items(), (None, "a b c"), (4, texts[4])], "doc_id bigint, text string")
    target = spark.createDataFrame([(i,) for i in [*chosen, 4, None]], "doc_id bigint")
    classes, weight = 1, 50.0
    rows = [(i, (t or "").lower().split()) for i, t in [*texts.items(), (None, "a b c"), (4, texts[4])]]
    vocabulary = {w for _, ws in rows for w in ws}
    size = len(vocabulary) + classes

    n_target = sum(len(ws) for i, ws in rows if i in chosen)
    ratio = n_target / sum(len(ws) for _, ws in rows)

    def loss(of, words, share):
        pairs = Counter(p for ws in of for p in zip(["", *ws], ws))
        single, context = Counter(), Counter()
        for (a, b), n in pairs.items():
            single[b] += n
            context[a] += n
        total = share * sum(single.values()) + size
        found = []
        for a, b in zip(["", *words], words):
            trust = share * context[a] / (share * context[a] + weight)
            found.append(-math.log(trust * pairs[a, b] / max(context[a], 1) + (1 - trust) * (share * single[b] + 1) / total))
        return sum(found) / len(found) if found else 0.0

    got = scoring.cross_entropy_difference(frame, target, words=len(vocabulary), classes=classes, weight=weight, marks=marks).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for k, (i, ws) in enumerate(rows):
        rest = [r for j, r in enumerate(rows) if j != k]
        want = loss([w for j, w in rest if j in chosen], ws, 1.0), loss([w for _, w in rest], ws, ratio)
        assert (by_id[i].target_loss, by_id[i].background_loss) == pytest.approx(want, abs=1e-5)


def test_op5_counts_every_word(spark):
    # 3000 words once each: left out, a row finds nothing of its own anywhere; a copy of a row is found word by word
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(150)] + [(500, " ".join(words[2000:2020]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(5)], "doc_id bigint")
    got = {r.doc_id: r for r in scoring.cross_entropy_difference(frame, target).collect()}
    alone = [r.difference for i, r in got.items() if 5 <= i < 150 and i != 100]
    assert max(alone) - min(alone) < 1e-9 and got[100].difference > max(alone) + 0.05 and got[500].difference > max(alone) + 0.05
    # the same scores from many chunks and buckets
    cut = scoring.cross_entropy_difference(frame, target, chunk_tokens=100, bucket_chars=500)
    assert {r.doc_id: (r.n_tokens, round(r.difference, 9)) for r in cut.collect()} == {i: (r.n_tokens, round(r.difference, 9)) for i, r in got.items()}


def test_op6_base_statistics(docs):
    from collections import Counter

    got = {r.doc_id: r for r in outliers.quality_rules(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        g = got[r.doc_id]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == expected
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert not got[300].kept and got[1].kept


def test_op6_rejects_an_outlier(spark):
    rows = [(i, prose(i), "en", "s") for i in range(60)] + [(99, " ".join(w + "###" for w in prose(3).split()), "en", "s")]
    got = {r.doc_id: r.kept for r in outliers.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[99] and sum(got.values()) == 60


def test_op6_salted_and_broadcast_agree(docs):
    row = lambda r: (r.doc_id or -1, r.n_words, r.kept, round(r.distance, 9) if r.distance is not None else -1.0)
    near, far = (sorted(map(row, outliers.quality_rules(docs, min_rows=5, broadcast_cells=n).collect())) for n in (outliers.CELLS, 0))
    assert near == far and any(r[3] >= 0 for r in near)


def test_op6_withstands_two_fifths_junk(spark):
    import random

    rng = random.Random(5)
    junk = lambda i: " ".join(w + "#$" * (rng.random() < 0.5) for w in prose(i).split())
    rows = [(i, prose(i), "en", "s") for i in range(120)] + [(i, junk(i), "en", "s") for i in range(200, 280)]
    got = {r.doc_id: r.kept for r in outliers.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(120)) == 120 and not any(got[i] for i in range(200, 280))


def test_op7_rules_and_trees(spark):
    rows = [(1, "https://a.example.com/en/71"), (2, "http://X.COM/en/8"), (3, "https://b.example.net/de/8"), (4, "http://spam-farm.example.org/fr/1"), (5, None), (6, "no scheme"), (7, "https://plain.example.net/fr/2?x=1#y"), (7, "https://plain.example.net/fr/2?x=1#y")]
    rows += [(100 + i, f"https://host{i % 7}.example.net/en/{i}") for i in range(60)] + [(200 + i, f"https://m.cheap-pills.example.org/en/{i}") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' as host", "'y' as suffix")
    got = {r.page_id: r for r in urls.judge_urls(pages, urls.seed_labels(pages)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3)] == [
        ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("x.com", "/en/8", "com/en/", "block"),
        ("b.example.net", "/de/8", "example.net/de/8", "block"),
    ]
    assert got[4].verdict == "block" and got[7].verdict == "allow" and (got[5].host, got[6].path, got[7].path) == ("", "", "/fr/2")
    assert urls.judge_urls(pages.limit(0), urls.seed_labels(pages.limit(0))).count() == 0


def test_op8_batches_are_idempotent(spark, docs):
    ledger = rollup.fresh_ledger(spark, "test")
    first = rollup.counted(docs, "words-1")
    assert ledger.commit("b0", rollup.signed(first, 1)) and not ledger.commit("b0", rollup.signed(first, 1))
    before = {(r.source, r.lang): r.docs for r in ledger.totals().collect()}
    assert sum(before.values()) == docs.count() and (None, None) in before
    assert ledger.commit("b1", rollup.revised(first, rollup.counted(docs, "words-2")))
    assert {r.tokenizer for r in ledger.totals().collect()} == {"words-2"}
    ledger.commit("b2", rollup.signed(rollup.counted(docs, "words-2"), -1))
    assert ledger.totals().count() == 0 and ledger.committed() == ["b0", "b1", "b2"]


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class=sidebar><p>Buy this one thing today.</p></div><article><h1>A&nbsp;title &amp; more</h1><p>First  paragraph of the story,\nwith <b>bold</b> words.<p>Second &lt;one&gt;.
<script>var x = "<p>no</p>";</script><div class="comments"><p>Great article, thanks for it!</p></div></article><form><label>Name</label></form><footer>&copy; x</footer>"""


def test_op9_keeps_the_article(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>menu</nav>"), (None, "u", "<p>" + "word " * 5000 + ".</p>"), (5, "u", "<p>A plain page has a paragraph of text here, too.</p><div")]
    got = {r.page_id: r for r in html.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == "A title & more\nFirst paragraph of the story, with bold words.\nSecond <one>." and got[1].n_chars == len(got[1].text)
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""] and got[None].n_chars == 25_001
    assert got[5].text.startswith("A plain page")


def test_op9_cut_is_minimal():
    import random

    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(label):
            return sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, label)) + sum(w for a, b, w in edges if label[a] != label[b])

        assert abs(cost(html.minimum_cut(scores, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_op10_separates_junk(docs, labels):
    got = {}
    for r in quality.quality_scores(docs, labels).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        got[r.doc_id] = r
    assert all(got[i].predicted for i in range(1, 40)) and not any(got[100 + i].predicted for i in range(8))
    assert got[300].score == got[301].score == 0.0


def test_empty_tables(spark, docs, labels):
    none, unlabelled = docs.limit(0), labels.limit(0)
    for frame in (minhash.near_duplicates(none), mixing.mix(none, labels), packing.pack(none), outliers.quality_rules(none), quality.quality_scores(none, labels)):
        assert frame.count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert html.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert {r.score for r in quality.quality_scores(docs, unlabelled).collect()} == {0.5}
    assert mixing.mix(docs, unlabelled).count() == docs.count()


def test_pipeline_stages(spark, tmp_path, docs, labels):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == plain.columns and after.count() <= now.count(), name
        after.write.parquet(str(tmp_path / f"out-{name}"))
        now = spark.read.parquet(str(tmp_path / f"out-{name}"))
    left = {r.doc_id for r in now.collect()}
    assert not left & set(range(100, 108)) and {1, 2, 3} & left
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left
