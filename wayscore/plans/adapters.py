"""The driver's tables read as the engine's canonical frames (a stand-in domain with a SQL twin).

A run is an order, its reference path its line items in a total order, its
predicted paths the line items of quantity 25 and more, widened by a line and
cut in two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("prompt"), F.col("o_custkey").alias("customer"))


def real_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)
    i = table(spark, sf_dir, "lineitem").withColumn("node_idx", F.row_number().over(order) - 1)
    line = F.col("l_linenumber")
    return i.select(F.col("l_orderkey").alias("case_id"), F.lit(0).alias("path_ord"), "node_idx", F.col("l_returnflag").alias("file"), line.alias("start_line"), line.alias("end_line"))


def pred_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("l_orderkey")
    i = table(spark, sf_dir, "lineitem").where("l_quantity >= 25")
    i = i.withColumn("n", F.row_number().over(own.orderBy(*ITEM_ORDER)) - 1).withColumn("c", F.count("*").over(own))
    first = F.col("n") < F.ceil(F.col("c") / 2)
    return i.select(
        F.col("l_orderkey").alias("run_id"),
        F.when(first, 0).otherwise(1).alias("op_idx"),
        F.when(first, F.col("n")).otherwise(F.col("n") - F.ceil(F.col("c") / 2)).cast("int").alias("node_idx"),
        F.col("l_returnflag").alias("file"),
        (F.col("l_linenumber") - 1).alias("start_line"),
        (F.col("l_linenumber") + 1).alias("end_line"),
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with features and a score in [0, 1] made from their ids."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    return d.join(q, "doc_id").select(
        "doc_id",
        "lang",
        "source",
        "quality",
        "toxic",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("double").alias("n_blanks"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("double").alias("n_breaks"),
        ((F.col("doc_id") * 37 % 101) / 100.0).cast("double").alias("score"),
    )


#: The same frames in DuckDB.
SQL = """
real AS (SELECT l_orderkey AS case_id, 0 AS path_ord, l_returnflag AS file, l_linenumber AS s, l_linenumber AS e,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS idx FROM lineitem),
pick AS (SELECT l_orderkey AS run_id, l_returnflag AS file, l_linenumber - 1 AS s, l_linenumber + 1 AS e, count(*) OVER (PARTITION BY l_orderkey) AS c,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS n FROM lineitem WHERE l_quantity >= 25),
pred AS (SELECT run_id, file, s, e, CASE WHEN n < ceil(c / 2.0) THEN 0 ELSE 1 END AS op_idx,
    CASE WHEN n < ceil(c / 2.0) THEN n ELSE n - ceil(c / 2.0)::BIGINT END AS idx FROM pick),
runs AS (SELECT o_orderkey AS run_id, o_orderkey AS case_id, o_orderpriority AS model, o_orderstatus AS prompt, o_custkey AS customer FROM orders),
pairs AS (SELECT run_id, op_idx, r.idx AS real_idx, p.idx AS pred_idx FROM pred p JOIN runs USING (run_id) JOIN real r ON r.case_id = runs.case_id AND r.file = p.file
    AND NOT (p.e < r.s OR r.e < p.s) AND r.s >= 0),
rlen AS (SELECT case_id, count(*) AS real_len FROM real GROUP BY 1),
plen AS (SELECT run_id, op_idx, count(*) AS out_len FROM pred GROUP BY 1, 2),
matches AS (SELECT run_id, op_idx, count(DISTINCT real_idx) AS overlap_nodes, any_value(real_len) AS real_len, any_value(out_len) AS out_len,
    count(DISTINCT real_idx) / any_value(real_len)::DOUBLE AS nor, bool_or(real_idx = 0) AS source_hit, bool_or(real_idx = real_len - 1) AS sink_hit
    FROM pairs JOIN rlen ON case_id = run_id JOIN plen USING (run_id, op_idx) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY nor DESC, op_idx) AS k FROM matches) WHERE k = 1)
"""
#: Contiguous runs: stop(i, j) is the first reference index from i on that predicted node j doesn't meet.
RUN_SQL = """
grid AS (SELECT p.run_id, p.op_idx, p.idx AS j, r.idx AS i, coalesce(r.file = p.file AND NOT (p.e < r.s OR r.e < p.s), false) AS m
    FROM pred p JOIN runs USING (run_id) JOIN real r ON r.case_id = runs.case_id),
stops AS (SELECT run_id, op_idx, i, j, coalesce(min(CASE WHEN NOT m THEN i END) OVER (PARTITION BY run_id, op_idx, j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), real_len) AS stop
    FROM grid JOIN rlen ON case_id = run_id),
seeds AS (SELECT run_id, op_idx, min(real_idx * 1000 + pred_idx) AS seed FROM pairs GROUP BY 1, 2),
steps AS (SELECT run_id, op_idx, seed // 1000 AS i0, seed % 1000 AS j0, seed // 1000 AS i, seed % 1000 AS j, 0 AS n FROM seeds
    UNION ALL SELECT w.run_id, w.op_idx, i0, j0, s.stop, w.j + 1, n + 1 FROM steps w JOIN stops s ON s.run_id = w.run_id AND s.op_idx = w.op_idx AND s.i = w.i AND s.j = w.j WHERE s.stop > w.i),
found AS (SELECT run_id, op_idx, any_value(i0) AS i0, any_value(j0) AS j0, max(i) AS i, max(n) AS n FROM steps GROUP BY 1, 2),
lcs AS (SELECT run_id, op_idx, i - i0 AS lcs_len, i0, i - 1 AS i1, j0, j0 + n - 1 AS j1, real_len AS lcs_real_len, out_len AS lcs_out_len, (i - i0) / real_len::DOUBLE AS lcnr
    FROM found JOIN rlen ON case_id = run_id JOIN plen USING (run_id, op_idx)),
bestrun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY lcnr DESC, op_idx) AS k FROM lcs) WHERE k = 1),
pmed AS (SELECT run_id, median(out_len)::DOUBLE AS out_median FROM plen GROUP BY 1),
results AS (SELECT runs.*, coalesce(nor, 0) AS nor, coalesce(overlap_nodes, 0)::DOUBLE AS overlap_nodes, coalesce(lcnr, 0) AS lcnr, coalesce(lcs_len, 0)::DOUBLE AS lcs_len,
    coalesce(b.real_len, rlen.real_len, 0)::DOUBLE AS real_len, coalesce(b.out_len, out_median, 0)::DOUBLE AS out_len,
    coalesce(source_hit, false) AS source_hit, coalesce(sink_hit, false) AS sink_hit
    FROM runs LEFT JOIN best b USING (run_id) LEFT JOIN bestrun l USING (run_id) LEFT JOIN rlen ON rlen.case_id = runs.case_id LEFT JOIN pmed USING (run_id))
"""
DOC_SQL = """
scored AS (SELECT doc_id, lang, source, quality, toxic, n_chars::DOUBLE AS n_chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS n_blanks,
    (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS n_breaks, (doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
tall AS (SELECT t AS threshold, feature, value, score >= t AS success FROM (SELECT score, unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS t, n_chars, n_blanks, n_breaks FROM scored)
    UNPIVOT (value FOR feature IN (n_chars, n_blanks, n_breaks))),
mom AS (SELECT threshold, feature, count(*) FILTER (success) AS n_s, count(*) FILTER (NOT success) AS n_f, avg(value) FILTER (success) AS m_s, avg(value) FILTER (NOT success) AS m_f,
    var_samp(value) FILTER (success) AS v_s, var_samp(value) FILTER (NOT success) AS v_f FROM tall GROUP BY 1, 2),
ranked AS (SELECT threshold, feature, success, value, rank() OVER w + (count(*) OVER (PARTITION BY threshold, feature, value) - 1) / 2.0 AS mid FROM tall WINDOW w AS (PARTITION BY threshold, feature ORDER BY value)),
mw AS (SELECT threshold, feature, sum(mid) FILTER (success) - count(*) FILTER (success) * (count(*) FILTER (success) + 1) / 2.0 AS u, count(*) FILTER (success) AS n_s, count(*) FILTER (NOT success) AS n_f
    FROM ranked GROUP BY 1, 2)
"""


def normal_score_sql(rank: str, n: str) -> str:
    """The normal quantile of (rank - 0.375) / (n + 0.25) in SQL."""
    from wayscore.functions.special import CENTRE, FAR, NEAR

    def over(parts, x):
        made = []
        for cs in parts:
            total = f"{cs[-1]!r}::DOUBLE"
            for c in reversed(cs[:-1]):
                total = f"({total} * ({x}) + {c!r}::DOUBLE)"
            made.append(total)
        return f"({made[0]} / {made[1]})"

    q, r = f"(({rank} - 0.375) / ({n} + 0.25) - 0.5)", f"sqrt(-ln(least(({rank} - 0.375) / ({n} + 0.25), 1 - ({rank} - 0.375) / ({n} + 0.25))))"
    tail = f"CASE WHEN {r} <= 5 THEN {over(NEAR, r + ' - 1.6')} ELSE {over(FAR, r + ' - 5')} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {over(CENTRE, f'0.180625 - {q} * {q}')} ELSE sign({q}) * {tail} END"


def newton_sql(steps: int = 12) -> str:
    """Newton steps of logistic models of ``score < t`` with three scaled features x1 to x3 and penalty one, from zero; the last table is w<steps> (t, w0 to w3)."""
    h = [(i, j) for i in range(4) for j in range(i, 4)]
    x = ["1", "x1", "x2", "x3"]
    made = [
        "feat AS (SELECT score, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(("n_chars", "n_blanks", "n_breaks"), 1)) + " FROM scored)",
        "cases AS (SELECT t, (score < t)::INT AS y, x1, x2, x3 FROM feat, (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS t))",
        "w0 AS (SELECT t, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3 FROM cases GROUP BY t HAVING min(y) < max(y))",
    ]
    for k in range(1, steps + 1):
        sums = [f"sum((p - y) * {x[i]}) + {'any_value(w%d)' % i if i else '0'} AS g{i}" for i in range(4)] + [f"sum(p * (1 - p) * {x[i]} * {x[j]}) + {1 if i == j and i else 0} AS h{i}{j}" for i, j in h]
        made.append(
            f"s{k} AS (SELECT t, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, {', '.join(sums)} "
            f"FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2 + w3 * x3))) AS p FROM cases JOIN w{k - 1} USING (t)) GROUP BY t)"
        )
        # elimination column by column, then back
        made.append(
            f"e{k} AS (SELECT *, h11 - h01 * h01 / h00 AS a11, h12 - h01 * h02 / h00 AS a12, h13 - h01 * h03 / h00 AS a13, h22 - h02 * h02 / h00 AS a22, h23 - h02 * h03 / h00 AS a23, h33 - h03 * h03 / h00 AS a33, "
            "g1 - h01 * g0 / h00 AS b1, g2 - h02 * g0 / h00 AS b2, g3 - h03 * g0 / h00 AS b3, a22 - a12 * a12 / a11 AS c22, a23 - a12 * a13 / a11 AS c23, a33 - a13 * a13 / a11 AS c33, b2 - a12 * b1 / a11 AS d2, b3 - a13 * b1 / a11 AS d3, "
            f"(d3 - c23 * d2 / c22) / (c33 - c23 * c23 / c22) AS v3, (d2 - c23 * v3) / c22 AS v2, (b1 - a12 * v2 - a13 * v3) / a11 AS v1, (g0 - h01 * v1 - h02 * v2 - h03 * v3) / h00 AS v0 FROM s{k})"
        )
        made.append(f"w{k} AS (SELECT t, w0 - v0 AS w0, w1 - v1 AS w1, w2 - v2 AS w2, w3 - v3 AS w3 FROM e{k})")
    return ", ".join(made)


def area_sql(density: str, to: str, table: str, keys: str) -> str:
    """The integral of ``density`` (of x) from nil to ``to`` for every row of ``table``, by Simpson's rule over 4000 steps: keys, area."""
    return (
        f"SELECT {keys}, sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * ({density}) * ({to}) / 12000) AS area "
        f"FROM (SELECT *, ({to}) * k / 4000 AS x FROM {table}, (SELECT unnest(range(4001)) AS k)) GROUP BY {keys}"
    )


#: Two-sided p of U (normal, with ties and continuity) and of Welch's t.
P_SQL = (
    """
ties AS (SELECT threshold, feature, sum(c * c * c - c)::DOUBLE AS tie_term FROM (SELECT threshold, feature, value, count(*)::DOUBLE AS c FROM tall GROUP BY ALL) GROUP BY 1, 2),
zs AS (SELECT threshold, feature, least(40, (greatest(u, n_s * n_f - u) - n_s * n_f / 2.0 - 0.5) / sqrt(n_s * n_f / 12.0 * ((n_s + n_f + 1) - tie_term / ((n_s + n_f) * (n_s + n_f - 1.0)))))::DOUBLE AS z
    FROM mw JOIN ties USING (threshold, feature) WHERE n_s > 0 AND n_f > 0),
za AS ("""
    + area_sql("exp(-x * x / 2) / sqrt(2 * pi())", "z", "zs", "threshold, feature")
    + """),
ts AS (SELECT threshold, feature, least(60, abs(m_s - m_f) / sqrt(v_s / n_s + v_f / n_f)) AS t, (v_s / n_s + v_f / n_f) ** 2 / ((v_s / n_s) ** 2 / (n_s - 1) + (v_f / n_f) ** 2 / (n_f - 1)) AS df FROM mom WHERE n_s > 1 AND n_f > 1),
ta AS ("""
    + area_sql("exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (1 + x * x / df) ** (-(df + 1) / 2)", "t", "ts", "threshold, feature")
    + """),
ps AS (SELECT threshold, feature, least(1.0, 1 - 2 * za.area) AS p_mann_whitney, 1 - 2 * ta.area AS p_welch FROM za LEFT JOIN ta USING (threshold, feature))
"""
)
