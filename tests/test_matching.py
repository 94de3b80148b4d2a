import random

from wayscore.operators import best, nodes, runs

REAL = "case_id string, path_ord int, node_idx int, file string, start_line int, end_line int"
PRED = "run_id string, op_idx int, node_idx int, file string, start_line int, end_line int"


def brute_walk(real, pred, meets):
    for i in range(len(real)):
        for j in range(len(pred)):
            if meets(real[i], pred[j]):
                a, n = i, 0
                while j + n < len(pred):
                    k = 0
                    while a + k < len(real) and meets(real[a + k], pred[j + n]):
                        k += 1
                    if not k:
                        break
                    a, n = a + k, n + 1
                return a - i, i, a - 1, j, j + n - 1
    return None


def test_contiguous_runs_equal_brute_force(spark):
    rng = random.Random(5)
    real, pred, run_rows, expected = [], [], [], {}
    for c in range(60):
        r = [(rng.choice("ab"), s := rng.randint(1, 6), s + rng.randint(0, 2)) for _ in range(rng.randint(1, 6))]
        p = [(rng.choice("ab"), s := rng.randint(1, 6), s + rng.randint(0, 2)) for _ in range(rng.randint(1, 6))]
        real += [(f"c{c}", 0, k, *x) for k, x in enumerate(r)]
        pred += [(f"r{c}", 0, k, *x) for k, x in enumerate(p)]
        run_rows.append((f"r{c}", f"c{c}"))
        found = brute_walk(r, p, lambda x, y: x[0] == y[0] and not (x[2] < y[1] or y[2] < x[1]))
        if found:
            expected[f"r{c}"] = found
    frame = runs.contiguous_runs(spark.createDataFrame(pred, PRED), spark.createDataFrame(real, REAL), spark.createDataFrame(run_rows, "run_id string, case_id string"))
    got = {x.run_id: (x.lcs_len, x.real_start, x.real_end, x.out_start, x.out_end) for x in frame.collect()}
    assert got == expected


def test_ties_and_misses(spark):
    real = spark.createDataFrame([("c", p, i, "f", i, i) for p in (0, 1) for i in (0, 1)] + [("d", 0, 0, "g", 1, 1)], REAL)
    pred = spark.createDataFrame([("r", o, 0, "f", 0, 0) for o in (0, 1)] + [("s", 0, 0, "other", 1, 1)], PRED)
    table = spark.createDataFrame([("r", "c"), ("s", "d")], "run_id string, case_id string")
    matches = nodes.pair_matches(nodes.overlap_pairs(pred, real, table), real, pred)
    top = best.best_match(matches).collect()
    assert [(x.run_id, x.op_idx, x.path_ord, x.nor, x.source_hit, x.sink_hit) for x in top] == [("r", 0, 0, 0.5, True, False)]
    rows = {x.run_id: x for x in best.results(table, real, pred).collect()}
    assert (rows["s"].nor, rows["s"].real_len, rows["s"].lcnr, rows["s"].sink_hit) == (0.0, 1.0, 0.0, False)


def test_single_node_path_is_source_and_sink(spark):
    real = spark.createDataFrame([("c", 0, 0, "f", 4, 4)], REAL)
    pred = spark.createDataFrame([("r", 0, 0, "f", 1, 9)], PRED)
    table = spark.createDataFrame([("r", "c")], "run_id string, case_id string")
    row = nodes.pair_matches(nodes.overlap_pairs(pred, real, table, bucket=2), real, pred).first()
    assert (row.source_hit, row.sink_hit, row.nor) == (True, True, 1.0)


def test_dedupe_keeps_first(spark):
    real = spark.createDataFrame([("c", 0, 0, "f", 4, None), ("c", 0, 1, "f", 4, 4), ("c", 0, 2, "f", 5, 5)], REAL)
    got = [(x.node_idx, x.start_line) for x in nodes.dedupe_nodes(real, ["case_id", "path_ord"]).orderBy("node_idx").collect()]
    assert got == [(0, 4), (1, 5)]
