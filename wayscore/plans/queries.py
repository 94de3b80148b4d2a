"""Every operator as a query over the driver's tables, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayscore.functions import numeric, text, variants
from wayscore.operators import best, catalog, manual, model, nodes, prompts, stats, tables
from wayscore.operators import runs as walks
from wayscore.plans import adapters as a
from wayscore.sources import logs

FEATURES = ["n_chars", "n_blanks", "n_breaks"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return a.runs(spark, sf), a.real_nodes(spark, sf), a.pred_nodes(spark, sf)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",".join(parts)


# -- matching ---------------------------------------------------------------


@query(_with(a.SQL) + "SELECT run_id, op_idx::BIGINT AS op_idx, real_idx::BIGINT AS real_idx, pred_idx::BIGINT AS pred_idx FROM pairs")
def node_overlap_pairs(spark, sf):
    runs, real, pred = frames(spark, sf)
    return longs(nodes.overlap_pairs(pred, real, runs).select("run_id", "op_idx", "real_idx", "pred_idx"))


@query(_with(a.SQL) + "SELECT run_id, op_idx::BIGINT AS op_idx, real_idx::BIGINT AS real_idx, pred_idx::BIGINT AS pred_idx FROM pairs")
def node_overlap_bucketed(spark, sf):
    runs, real, pred = frames(spark, sf)
    return longs(nodes.overlap_pairs(pred, real, runs, bucket=4).select("run_id", "op_idx", "real_idx", "pred_idx"))


@query(
    _with(a.SQL)
    + """SELECT p.run_id, count(DISTINCT r.idx) AS overlap_nodes, string_agg(DISTINCT p.file, ',' ORDER BY p.file) AS files, round(count(DISTINCT r.idx) / any_value(real_len)::DOUBLE, 6) AS nor
    FROM (SELECT run_id, file, s + 1 AS line FROM pred) p
    JOIN (SELECT case_id, file, s, e, row_number() OVER (PARTITION BY case_id ORDER BY idx) - 1 AS idx, count(*) OVER (PARTITION BY case_id) AS real_len FROM
        (SELECT case_id, file, s, e, min(idx) AS idx FROM real GROUP BY ALL)) r ON r.case_id = p.run_id AND r.file = p.file AND p.line BETWEEN r.s AND r.e GROUP BY 1"""
)
def line_form_matches(spark, sf):
    runs, real, pred = frames(spark, sf)
    lines = pred.select("run_id", "file", (F.col("start_line") + 1).alias("line"))
    m = nodes.line_matches(lines, real, runs)
    return rounded(m.select("run_id", "overlap_nodes", F.array_join("matched_files", ",").alias("files"), "nor"), "nor")


@query(_with(a.SQL) + "SELECT run_id, op_idx::BIGINT AS op_idx, overlap_nodes, real_len, out_len, round(nor, 6) AS nor FROM matches")
def nor_per_run(spark, sf):
    runs, real, pred = frames(spark, sf)
    m = nodes.pair_matches(nodes.overlap_pairs(pred, real, runs), real, pred)
    return rounded(longs(m.select("run_id", "op_idx", "overlap_nodes", "real_len", "out_len", "nor")), "nor")


@query(_with(a.SQL) + "SELECT run_id, op_idx::BIGINT AS op_idx, round(nor, 6) AS nor, overlap_nodes FROM best")
def best_match(spark, sf):
    runs, real, pred = frames(spark, sf)
    m = nodes.pair_matches(nodes.overlap_pairs(pred, real, runs), real, pred)
    return rounded(longs(best.best_match(m).select("run_id", "op_idx", "nor", "overlap_nodes")), "nor")


@query(_with(a.SQL) + "SELECT run_id, op_idx::BIGINT AS op_idx, source_hit, sink_hit FROM matches")
def source_sink_hits(spark, sf):
    runs, real, pred = frames(spark, sf)
    m = nodes.pair_matches(nodes.overlap_pairs(pred, real, runs), real, pred)
    return longs(m.select("run_id", "op_idx", "source_hit", "sink_hit"))


@query(
    _with(a.SQL, a.RUN_SQL, recursive=True)
    + """SELECT run_id, op_idx::BIGINT AS op_idx, lcs_len::BIGINT AS lcs_len, i0::BIGINT AS real_start, i1::BIGINT AS real_end, j0::BIGINT AS out_start, j1::BIGINT AS out_end,
    lcs_real_len::BIGINT AS lcs_real_len, lcs_out_len::BIGINT AS lcs_out_len, round(lcnr, 6) AS lcnr FROM lcs"""
)
def contiguous_run(spark, sf):
    runs, real, pred = frames(spark, sf)
    return rounded(longs(walks.contiguous_runs(pred, real, runs).drop("case_id", "path_ord")), "lcnr")


@query(
    _with(a.SQL, a.RUN_SQL, recursive=True)
    + """, every AS (SELECT run_id, op_idx, real_idx AS i0, pred_idx AS j0, real_idx AS i, pred_idx AS j, 0 AS n FROM pairs
        UNION ALL SELECT w.run_id, w.op_idx, i0, j0, s.stop, w.j + 1, n + 1 FROM every w JOIN stops s ON s.run_id = w.run_id AND s.op_idx = w.op_idx AND s.i = w.i AND s.j = w.j WHERE s.stop > w.i)
    SELECT run_id, op_idx::BIGINT AS op_idx, i0::BIGINT AS real_start, (max(i) - 1)::BIGINT AS real_end, j0::BIGINT AS out_start, (j0 + max(n) - 1)::BIGINT AS out_end, (max(i) - i0)::BIGINT AS lcs_len
    FROM every GROUP BY run_id, op_idx, i0, j0"""
)
def all_runs(spark, sf):
    runs, real, pred = frames(spark, sf)
    return longs(walks.all_runs(pred, real, runs).select("run_id", "op_idx", "real_start", "real_end", "out_start", "out_end", "lcs_len"))


@query(_with(a.SQL, a.RUN_SQL, recursive=True) + "SELECT run_id, lcs_len::BIGINT AS lcs_len, round(lcnr, 6) AS lcnr FROM bestrun")
def best_run(spark, sf):
    runs, real, pred = frames(spark, sf)
    return rounded(best.best_run(walks.contiguous_runs(pred, real, runs)).select("run_id", "lcs_len", "lcnr"), "lcnr")


RESULT = "run_id, customer, model, prompt, round(nor, 6) AS nor, overlap_nodes, round(lcnr, 6) AS lcnr, lcs_len, real_len, out_len, source_hit, sink_hit"
RESULT_COLUMNS = ["run_id", "customer", "model", "prompt", "nor", "overlap_nodes", "lcnr", "lcs_len", "real_len", "out_len", "source_hit", "sink_hit"]


@query(_with(a.SQL, a.RUN_SQL, recursive=True) + f"SELECT {RESULT} FROM results")
def results_frame(spark, sf):
    return rounded(best.results(*frames(spark, sf)).select(RESULT_COLUMNS), "nor", "lcnr")


@query(
    _with(a.SQL, a.RUN_SQL, recursive=True)
    + f"SELECT {RESULT} FROM (SELECT *, row_number() OVER (PARTITION BY customer, prompt, model ORDER BY nor DESC, run_id) AS k FROM results) WHERE k = 1"
)
def results_dedup(spark, sf):
    kept = best.one_per_group(best.results(*frames(spark, sf)), ["customer", "prompt", "model"], ["run_id"])
    return rounded(kept.select(RESULT_COLUMNS), "nor", "lcnr")


@query("SELECT l_orderkey AS case_id, l_returnflag AS file, l_linenumber::BIGINT AS start_line, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_idx) - 1 AS node_idx FROM ("
       + "WITH" + a.SQL.split("pick AS")[0].rstrip().rstrip(",") + " SELECT case_id AS l_orderkey, file AS l_returnflag, s AS l_linenumber, min(idx) AS first_idx FROM real GROUP BY ALL)")
def node_dedupe(spark, sf):
    return longs(nodes.dedupe_nodes(a.real_nodes(spark, sf), ["case_id"]).select("case_id", "file", "start_line", "node_idx"))


# -- tables -----------------------------------------------------------------


@query(
    _with(a.SQL, a.RUN_SQL, recursive=True)
    + """SELECT model, count(*) AS runs, round(median(nor), 6) AS median_nor, round(median(lcnr), 6) AS median_lcnr, round(avg(nor), 6) AS mean_nor,
    round(coalesce(avg(source_hit::INT) FILTER (nor > 0), 0), 6) AS source_rate, round(coalesce(avg(sink_hit::INT) FILTER (nor > 0), 0), 6) AS sink_rate
    FROM (SELECT *, row_number() OVER (PARTITION BY customer, prompt, model ORDER BY nor DESC, run_id) AS k FROM results) WHERE k = 1 AND prompt = 'F' GROUP BY 1"""
)
def model_summary(spark, sf):
    kept = best.one_per_group(best.results(*frames(spark, sf)), ["customer", "prompt", "model"], ["run_id"])
    return rounded(tables.model_summary(kept, prompt="F"), "median_nor", "median_lcnr", "mean_nor", "source_rate", "sink_rate")


TAGS = ["STEEL", "BRASS", "Brand#1", "Brand#2"]


@query(
    """WITH t AS (SELECT p_size, p_retailprice, tag FROM part, (SELECT unnest(['STEEL', 'BRASS', 'Brand#1', 'Brand#2']) AS tag) WHERE contains(p_type, tag) OR p_brand = tag OR starts_with(p_brand, tag)),
    g AS (SELECT tag, median(p_size)::DOUBLE AS median_size, avg(p_retailprice) AS mean_price, count(*)::DOUBLE AS n FROM t GROUP BY 1),
    l AS (SELECT tag, measure, value FROM g UNPIVOT (value FOR measure IN (median_size, mean_price, n)))
    SELECT measure, """
    + ", ".join(f"round(max(value) FILTER (tag = '{t}'), 4) AS \"{t}\"" for t in TAGS)
    + " FROM l GROUP BY 1"
)
def tag_metric_table(spark, sf):
    p = a.table(spark, sf, "part")
    tags = F.array_compact(F.array(*(F.when(F.col("p_type").contains(t) | F.col("p_brand").startswith(t), t) for t in TAGS)))
    made = tables.by_tag(p, tags, TAGS, {"mean_price": F.avg("p_retailprice"), "n": F.count("*")}, {"median_size": F.col("p_size")})
    # a measure whose every group is empty still has its row; SQL leaves it out
    return made.where(" or ".join(f"`{t}` is not null" for t in TAGS)).select("measure", *(F.round(f"`{t}`", 4).alias(t) for t in TAGS))


def _bins(sql_a: str, sql_b: str) -> str:
    return _with(a.SQL, a.RUN_SQL, recursive=True) + f"SELECT CASE WHEN nor {sql_a} 0.25 THEN 'low' WHEN nor {sql_b} 0.75 THEN 'partial' ELSE 'high' END AS bin, count(*) AS n FROM results GROUP BY 1"


@query(_bins("<", "<"))
def overlap_bins_left(spark, sf):
    return best.results(*frames(spark, sf)).groupBy(numeric.bin_left(F.col("nor")).alias("bin")).agg(F.count("*").alias("n"))


@query(_bins("<=", "<="))
def overlap_bins_right(spark, sf):
    return best.results(*frames(spark, sf)).groupBy(numeric.bin_right(F.col("nor")).alias("bin")).agg(F.count("*").alias("n"))


@query(_with(a.SQL, a.RUN_SQL, recursive=True) + "SELECT run_id, round(nor, 6) AS nor, overlap_nodes, CASE WHEN nor <= 0.25 THEN 'low' WHEN nor <= 0.75 THEN 'partial' ELSE 'high' END AS bin FROM results WHERE prompt = 'F' AND model = '1-URGENT'")
def nor_scatter(spark, sf):
    r = best.results(*frames(spark, sf)).where("prompt = 'F' and model = '1-URGENT'")
    return rounded(r.select("run_id", "nor", "overlap_nodes", numeric.bin_right(F.col("nor")).alias("bin")).orderBy(F.desc("nor"), "run_id"), "nor")


def _judged(spark, sf):
    d, q = a.table(spark, sf, "documents"), a.table(spark, sf, "labels")
    parity = F.when(F.pmod(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(2)) == 0, "even").otherwise("odd")
    return d.join(q, "doc_id").select(F.col("quality").alias("actual"), (F.col("n_chars") >= 1500).cast("int").alias("predicted"), F.col("lang").alias("model"), parity.alias("prompt"))


JUDGED = """judged AS (SELECT quality AS actual, (n_chars >= 1500)::INT AS predicted, lang AS model,
    CASE WHEN regexp_extract(source, '(\\d+)', 1)::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS prompt FROM documents JOIN labels USING (doc_id)),
cells AS (SELECT model, prompt, count(*) FILTER (actual = 1 AND predicted = 1) AS tp, count(*) FILTER (actual = 0 AND predicted = 0) AS tn,
    count(*) FILTER (actual = 0 AND predicted = 1) AS fp, count(*) FILTER (actual = 1 AND predicted = 0) AS fn FROM judged GROUP BY 1, 2),
rates AS (SELECT *, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS fpr, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision", coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
    coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM cells)"""


@query(
    _with(JUDGED)
    + """SELECT r.model, r.prompt, r.tp, r.tn, r.fp, r.fn, round(r.fpr, 6) AS fpr, round(r."precision", 6) AS "precision", round(r.recall, 6) AS recall, round(r.mcc, 6) AS mcc,
    CASE WHEN r.prompt <> 'odd' THEN b.fp - r.fp END AS delta_fp, round(CASE WHEN r.prompt <> 'odd' THEN b.fpr - r.fpr END, 6) AS delta_fpr
    FROM rates r LEFT JOIN (SELECT * FROM rates WHERE prompt = 'odd') b USING (model)"""
)
def prompt_confusion(spark, sf):
    return rounded(tables.prompt_comparison(_judged(spark, sf), "odd", ["en", "de", "fr", "es"], ["odd", "even"]), "fpr", "precision", "recall", "mcc", "delta_fpr")


@query(
    _with(JUDGED)
    + "SELECT count(*) AS total, sum(tp)::BIGINT AS tp, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp + tn) / sum(tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(sum(fp) / sum(fp + tn)::DOUBLE, 6) AS fpr FROM cells".replace("count(*) AS total", "sum(tp + tn + fp + fn)::BIGINT AS total")
)
def binary_summary(spark, sf):
    return rounded(tables.binary_summary(_judged(spark, sf)), "accuracy", "fpr")


@query("SELECT doc_id, quality::BIGINT AS label, 'positive' AS kind FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, quality::BIGINT, 'negative' FROM labels WHERE quality = 0")
def union_runs(spark, sf):
    q = a.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label"))
    return q.where("label = 1").withColumn("kind", F.lit("positive")).unionByName(q.where("label = 0").withColumn("kind", F.lit("negative")))


# -- statistics -------------------------------------------------------------


def _tall(spark, sf):
    return stats.tall(a.scored_documents(spark, sf), FEATURES)


@query(_with(a.DOC_SQL) + "SELECT t AS threshold, count(*) FILTER (score >= t) AS n_success, count(*) FILTER (score < t) AS n_failure FROM (SELECT score, unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS t FROM scored) GROUP BY 1")
def threshold_sizes(spark, sf):
    return stats.threshold_sizes(a.scored_documents(spark, sf))


@query(
    _with(a.DOC_SQL)
    + "SELECT threshold, feature, n_s, n_f, round(coalesce((m_s - m_f) / nullif(sqrt(((n_s - 1) * v_s + (n_f - 1) * v_f) / (n_s + n_f - 2)), 0), 0), 6) AS d FROM mom WHERE n_s > 1 AND n_f > 1"
)
def cohens_d(spark, sf):
    return rounded(stats.cohens_d(_tall(spark, sf)).where("n_s > 1 and n_f > 1").drop("d_size"), "d")


@query(_with(a.DOC_SQL) + "SELECT threshold, feature, round(u, 3)::DOUBLE AS u, n_s, n_f FROM mw WHERE n_s > 0 AND n_f > 0")
def mann_whitney_u(spark, sf):
    return stats.mann_whitney(_tall(spark, sf)).select("threshold", "feature", F.round("u", 3).alias("u"), "n_s", "n_f")


@query(
    _with(a.DOC_SQL)
    + """SELECT threshold, feature, round(d, 6) AS delta, CASE WHEN abs(d) < 0.147 THEN 'negligible' WHEN abs(d) < 0.33 THEN 'small' WHEN abs(d) < 0.474 THEN 'medium' ELSE 'large' END AS delta_size
    FROM (SELECT *, (1 - 2 * u / (n_s * n_f))::DOUBLE AS d FROM mw WHERE n_s > 0 AND n_f > 0)"""
)
def cliffs_delta(spark, sf):
    return rounded(stats.mann_whitney(_tall(spark, sf)).select("threshold", "feature", "delta", "delta_size"), "delta")


@query(
    _with(a.DOC_SQL)
    + """SELECT threshold, feature, round((m_s - m_f) / sqrt(v_s / n_s + v_f / n_f), 6) AS t,
    round((v_s / n_s + v_f / n_f) * (v_s / n_s + v_f / n_f) / ((v_s / n_s) * (v_s / n_s) / (n_s - 1) + (v_f / n_f) * (v_f / n_f) / (n_f - 1)), 4) AS df FROM mom WHERE n_s > 1 AND n_f > 1"""
)
def welch_t(spark, sf):
    w = stats.welch(_tall(spark, sf))
    return w.withColumns({"t": F.round("t", 6), "df": F.round("df", 4)})


@query(
    _with(a.DOC_SQL)
    + """SELECT feature, success, count(*) AS n, min(value) AS low, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS middle, quantile_cont(value, 0.75) AS q3, max(value) AS high
    FROM tall WHERE threshold = 0.5 GROUP BY 1, 2"""
)
def feature_quantiles(spark, sf):
    return stats.quantiles(a.scored_documents(spark, sf), FEATURES, 0.5)


@query("SELECT CASE WHEN n_chars < 0 THEN 0 WHEN n_chars >= 10000 THEN 21 ELSE n_chars // 500 + 1 END::BIGINT AS bin, count(*) AS n FROM documents GROUP BY 1")
def feature_histogram(spark, sf):
    return stats.histogram(a.table(spark, sf, "documents"), "n_chars", 0, 10000, 20)


@query(
    _with(a.DOC_SQL)
    + """, r AS (SELECT quality, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM scored)
    SELECT round(((sum(mid) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)))::DOUBLE, 6) AS auc,
    round(avg((score - quality) * (score - quality)), 6)::DOUBLE AS brier FROM r"""
)
def auc_brier(spark, sf):
    return rounded(stats.auc(a.scored_documents(spark, sf), "quality", "score"), "auc", "brier")


@query(
    _with(a.DOC_SQL, a.newton_sql())
    + """, judged AS (SELECT t, y, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2 + w3 * x3))) AS p FROM cases JOIN w12 USING (t)),
    r AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY p) + (count(*) OVER (PARTITION BY t, p) - 1) / 2.0 AS mid FROM judged),
    told AS (SELECT t, (sum(mid) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc, avg((p - y) * (p - y)) AS brier FROM r GROUP BY 1)
    SELECT threshold, (SELECT count(*) FROM scored) AS n, round(auc::DOUBLE, 6) AS auc, round(brier, 6) AS brier, round(w1, 6) AS coef_n_chars, round(w2, 6) AS coef_n_blanks, round(w3, 6) AS coef_n_breaks
    FROM (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS threshold) LEFT JOIN w12 ON w12.t = threshold LEFT JOIN told ON told.t = threshold"""
)
def logistic_table(spark, sf):
    return rounded(model.predictive_power(a.scored_documents(spark, sf), FEATURES), "auc", "brier", *(f"coef_{f}" for f in FEATURES))


@query(
    _with(a.DOC_SQL)
    + f""", placed AS (SELECT threshold, feature, success, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY threshold, feature, success) AS n, avg(value) OVER (PARTITION BY threshold, feature, success) AS mean
        FROM tall WINDOW w AS (PARTITION BY threshold, feature, success ORDER BY value)),
    m AS (SELECT *, value - mean AS x, {a.normal_score_sql("i", "n")} AS m FROM placed WHERE n > 11),
    sums AS (SELECT threshold, feature, success, n, sum(m * m) AS square, sum(m * x) AS dot, sum(x * x) AS spread, max(x) FILTER (i = 1) AS x1, max(x) FILTER (i = 2) AS x2, max(x) FILTER (i = n - 1) AS y2, max(x) FILTER (i = n) AS y1,
        max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(n) AS u, ln(n) AS ln FROM m GROUP BY ALL HAVING min(x) < max(x)),
    ends AS (SELECT *, m1 / sqrt(square) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 AS a1,
        m2 / sqrt(square) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 AS a2 FROM sums),
    ws AS (SELECT *, (square - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi, (dot - m1 * (y1 - x1) - m2 * (y2 - x2)) / sqrt(phi) + a1 * (y1 - x1) + a2 * (y2 - x2) AS total, total * total / spread AS w FROM ends)
    SELECT threshold, feature, success, n, round(w, 6) AS w, round((ln(1 - w) - (-1.5861 - 0.31082 * ln - 0.083751 * ln ** 2 + 0.0038915 * ln ** 3)) / exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln ** 2), 4) AS z FROM ws"""
)
def shapiro_wilk(spark, sf):
    return stats.shapiro(_tall(spark, sf)).withColumns({"w": F.round("w", 6), "z": F.round("z", 4)})


@query(
    _with(a.DOC_SQL)
    + """, one AS (SELECT feature, success, value FROM tall WHERE threshold = 0.5),
    shape AS (SELECT feature, success, count(*) AS n, min(value) AS low, max(value) AS high, count(*)::DOUBLE ** -0.2 * stddev_samp(value) AS h FROM one GROUP BY 1, 2 HAVING min(value) < max(value)),
    placed AS (SELECT feature, success, (value - low) / (h / 32) AS place FROM one JOIN shape USING (feature, success)),
    cells AS (SELECT feature, success, floor(place) AS b, 1 - (place - floor(place)) AS w FROM placed UNION ALL SELECT feature, success, floor(place) + 1, place - floor(place) FROM placed),
    summed AS (SELECT feature, success, b, sum(w) AS w FROM cells GROUP BY ALL),
    grid AS (SELECT *, (high - low) / 99 AS step FROM shape, (SELECT unnest(range(100)) AS point))
    SELECT feature, success, point::BIGINT AS point, round(low + point * step, 6) AS "at", round(sum(w * exp(-0.5 * ((point * step - b * (h / 32)) / h) ** 2)) / (n * h * sqrt(2 * pi())) * (high - low), 6) AS density
    FROM grid JOIN summed USING (feature, success) GROUP BY feature, success, point, low, high, step, n, h"""
)
def feature_density(spark, sf):
    """Densities by the range of the values, so that they compare between features."""
    d = stats.density(a.scored_documents(spark, sf), FEATURES, 0.5)
    span = Window.partitionBy("feature", "success")
    by_range = F.col("density") * (F.max("at").over(span) - F.min("at").over(span))
    return d.select("feature", "success", "point", F.round("at", 6).alias("at"), F.round(by_range, 6).alias("density"))


@query()
def normality(spark, sf):
    return stats.normality(_tall(spark, sf))


@query(_with(a.DOC_SQL, a.P_SQL) + "SELECT threshold, feature, round(p_mann_whitney, 6) AS p_mann_whitney, round(p_welch, 6) AS p_welch FROM ps")
def p_values(spark, sf):
    return rounded(stats.p_values(_tall(spark, sf)), "p_mann_whitney", "p_welch")


@query(
    _with(a.DOC_SQL, a.P_SQL)
    + """, cells AS (SELECT threshold, feature, format('{:.2g}', p_mann_whitney) AS p,
        format('{:.2f}', abs(d)) || CASE WHEN abs(d) < 0.147 THEN ' (N)' WHEN abs(d) < 0.33 THEN ' (S)' WHEN abs(d) < 0.474 THEN ' (M)' ELSE ' (L)' END AS delta
        FROM ps JOIN (SELECT threshold, feature, (1 - 2 * u / (n_s * n_f))::DOUBLE AS d FROM mw WHERE n_s > 0 AND n_f > 0) USING (threshold, feature))
    SELECT 'Feature ' || feature AS feature, """
    + ", ".join(f"max({c}) FILTER (threshold = {t}) AS \"t{t:g}_{c}\"" for t in (0.25, 0.5, 0.75, 1.0) for c in ("p", "delta"))
    + " FROM cells GROUP BY 1"
)
def threshold_report(spark, sf):
    return stats.presented(stats.all_tests(a.scored_documents(spark, sf), FEATURES), labels={f: f"Feature {f}" for f in FEATURES})


# -- text, JSON, ingest -----------------------------------------------------


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) END::BIGINT AS n FROM documents")
def line_count(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", text.line_count(F.col("text")).cast("bigint").alias("n"))


@query("SELECT doc_id, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), lambda x, i: 'L' || i || ': ' || x), chr(10)) END AS body FROM documents")
def line_numbered(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", text.numbered(F.col("text")).alias("body"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf):
    return a.table(spark, sf, "events").select("event_id", variants.shown(variants.field(F.try_parse_json("props"), "k")).alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 'ok' AS state FROM events")
def fenced_json(spark, sf):
    body = text.fenced(F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```\nmore ```{}```")))
    parsed = F.from_json(body, "struct<k:bigint>")
    return a.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.when(F.json_object_keys(body).isNotNull(), "ok").otherwise("bad").alias("state"))


@query("SELECT conv_id, turn, CASE WHEN role IS NULL THEN NULL ELSE role || '|f.py|a b' END AS files FROM conversations")
def needed_files(spark, sf):
    c = a.table(spark, sf, "conversations")
    shown = F.concat(F.lit("Title\n=====\nline\n=====\n===============\n===== "), F.col("role"), F.lit(" =====\nbody\n===== f.py =====\n=====  a b  =====x\n=====c =====\n"))
    return c.select("conv_id", "turn", F.when(F.col("role").isNotNull(), F.array_join(text.needed_files(F.lit(None).cast("array<string>"), shown), "|")).alias("files"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1)::INT::BIGINT AS a, CASE WHEN true THEN split_part(o_orderpriority, '-', 1)::INT + 3 END::BIGINT AS b FROM orders")
def line_ranges(spark, sf):
    o = a.table(spark, sf, "orders")
    n = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    start, end = text.line_range(F.concat(n, F.lit(" - "), (n.cast("int") + 3).cast("string"), F.lit("-9")))
    return longs(o.select("o_orderkey", start.alias("a"), end.alias("b")))


@query("SELECT c_custkey, 'CVE-' || c_custkey AS id FROM customer")
def case_ids(spark, sf):
    raw = F.concat(F.lit(" CVE-"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_name"), F.lit(":x"))
    return a.table(spark, sf, "customer").select("c_custkey", text.case_id(F.lit(None).cast("string"), raw).alias("id"))


@query("SELECT p_partkey, concat_ws(',', p_size, p_partkey) AS cwes FROM part WHERE p_size <> p_partkey UNION ALL SELECT p_partkey, p_size::VARCHAR FROM part WHERE p_size = p_partkey")
def cwe_numbers(spark, sf):
    tags = F.array(F.concat(F.lit("CWE-"), F.col("p_size").cast("string"), F.lit(" (cwe_"), F.col("p_partkey").cast("string"), F.lit(")")), F.concat(F.lit("cwe "), F.col("p_size").cast("string")))
    return a.table(spark, sf, "part").select("p_partkey", F.array_join(text.cwe_numbers(tags).cast("array<string>"), ",").alias("cwes"))


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN concat_ws(',', p_partkey, 7) WHEN 2 THEN concat_ws(',', p_size, p_partkey, 5) WHEN 3 THEN '20' ELSE '' END AS cwes
    FROM part WHERE NOT (p_size % 6 = 1 AND p_partkey = 7) AND NOT (p_size % 6 = 2 AND (p_partkey IN (5, p_size) OR p_size = 5))"""
)
def cwe_values(spark, sf):
    """A number, a text with two mentions, nested lists, an object, a number that isn't whole, null."""
    p = a.table(spark, sf, "part")
    p = p.where("not (p_size % 6 = 1 and p_partkey = 7) and not (p_size % 6 = 2 and (p_partkey in (5, p_size) or p_size = 5))")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    shown = [size, F.concat(F.lit('"CWE-'), key, F.lit(' and cwe_7"')), F.concat(F.lit("["), size, F.lit(', ["CWE-'), key, F.lit('", [[], [5, '), size, F.lit(']]], "none"]')), F.lit('{"n": 79, "of": ["CWE 20", 89]}'), F.lit("[20.5, true]"), F.lit("null")]
    raw = F.coalesce(*(F.when(F.col("p_size") % 6 == i, x) for i, x in enumerate(shown)))
    return p.select("p_partkey", F.array_join(text.cwe_values(raw).cast("array<string>"), ",").alias("cwes"))


@query("SELECT o_orderkey, 'a__b_' || o_orderstatus || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.json' AS name FROM orders")
def log_names(spark, sf):
    return a.table(spark, sf, "orders").select("o_orderkey", text.log_name([F.lit("a/b"), F.col("o_orderstatus")], F.col("o_orderdate")).alias("name"))


@query(
    """WITH names AS (SELECT DISTINCT p_brand AS folder FROM part), keys AS (SELECT DISTINCT left(p_brand, 7) AS k FROM part UNION SELECT p_brand FROM part)
    SELECT k AS case_key, CASE WHEN count(folder) = 1 THEN min(folder) END AS folder FROM keys LEFT JOIN names ON starts_with(folder, k) GROUP BY 1"""
)
def prefix_lookup(spark, sf):
    p = a.table(spark, sf, "part")
    folders = p.select(F.lit("x").alias("language"), F.col("p_brand").alias("folder")).distinct()
    keys = p.select(F.substring("p_brand", 1, 7).alias("case_key")).union(p.select("p_brand")).distinct().withColumn("language", F.lit("x"))
    return logs.find_case(keys, folders).select("case_key", "folder")


@query(
    """WITH names AS (SELECT DISTINCT p_brand AS folder FROM part), keys AS (SELECT DISTINCT left(p_brand, p_size % 9) AS k FROM part UNION SELECT 'Brand#9')
    SELECT k AS case_key, min(folder) AS folder FROM keys LEFT JOIN names ON starts_with(folder, k) GROUP BY 1"""
)
def first_prefix_hit(spark, sf):
    p = a.table(spark, sf, "part")
    folders = p.select(F.lit("x").alias("language"), F.col("p_brand").alias("folder")).distinct()
    keys = p.select(F.left("p_brand", F.col("p_size") % 9).alias("case_key")).union(spark.createDataFrame([("Brand#9",)], "case_key string")).distinct().withColumn("language", F.lit("x"))
    return logs.find_case(keys, folders, first=True).select("case_key", "folder")


@query(
    """SELECT d.doc_id, CASE WHEN n_chars < 60 THEN 'load_failure' WHEN l.doc_id IS NULL THEN 'rq1:unmapped' WHEN quality = 0 THEN 'rq1:load_error' WHEN toxic = 1 THEN 'rq1:unsupported' END AS reason
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def router_reasons(spark, sf):
    d = a.table(spark, sf, "documents").join(a.table(spark, sf, "labels"), "doc_id", "left")
    why = logs.reason(F.lit(False), F.col("n_chars") < 60, F.lit(True), F.col("source"), F.col("lang"), F.col("quality").cast("string"), F.col("quality") == 1, F.col("toxic") == 0)
    return d.select("doc_id", why.alias("reason"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'https://github.com/o/' || p_partkey WHEN 1 THEN 'https://github.com/p/' || p_partkey END AS url FROM part")
def project_urls(spark, sf):
    key, kind = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    project = F.when(kind == 0, F.concat(F.lit("o/"), key)).otherwise(key)
    commit = F.when(kind == 1, F.concat(F.lit("https://github.com/p/"), key, F.lit("/commit/1"))).when(kind == 2, F.concat(F.lit("https://x.org/p/"), key, F.lit("/commit/1")))
    return a.table(spark, sf, "part").select("p_partkey", text.project_url(project, commit).alias("url"))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT % 4 < 3 THEN 1 ELSE 0 END::BIGINT AS label FROM events")
def output_labels(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    # a list, a number and a text are lines; an empty list is none
    shown = F.when(k % 4 == 0, F.concat(F.lit("["), k, F.lit(", null]"))).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.concat(F.lit('"'), k, F.lit('"'))).otherwise("[]")
    output = F.concat(F.lit('{"f.py": {"vulnerable_lines": '), shown, F.lit(', "explanation": "e"}}'))
    return longs(logs.normalised(_as_logs(a.table(spark, sf, "events").select("event_id", output.alias("output")))).select("event_id", F.col("output_label").alias("label")))


def _as_logs(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of a log that they lack, as nulls."""
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(logs.LOG_SCHEMA).fields if f.name not in rows.columns}
    return rows.withColumns(lacking)


# -- catalogs and prompts ---------------------------------------------------


@query(_with(a.SQL) + "SELECT count(DISTINCT runs.case_id) AS cases, count(DISTINCT runs.case_id) AS paths, count(*) AS nodes, count(DISTINCT prompt) AS languages FROM runs JOIN real ON real.case_id = runs.case_id")
def catalog_totals(spark, sf):
    runs, real, _ = frames(spark, sf)
    return catalog.totals(runs.select("case_id", F.col("prompt").alias("language")), real)


@query(_with(a.SQL) + "SELECT case_id, sum(n)::BIGINT AS node_count, string_agg(file, ',' ORDER BY first_idx) AS files FROM (SELECT case_id, file, min(idx) AS first_idx, count(*) AS n FROM real GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct_files(spark, sf):
    s = catalog.path_summaries(a.real_nodes(spark, sf))
    return s.select("case_id", "node_count", F.array_join("files", ",").alias("files"))


@query(_with(a.SQL) + "SELECT runs.case_id, prompt AS language, 1::BIGINT AS n_paths, count(*) AS n_nodes FROM runs JOIN real ON real.case_id = runs.case_id GROUP BY 1, 2")
def viewer_catalog(spark, sf):
    runs, real, _ = frames(spark, sf)
    made = catalog.catalog(runs.select("case_id", F.col("prompt").alias("language")), real)
    return made.select("case_id", "language", F.size("paths").cast("bigint").alias("n_paths"), F.aggregate("paths", F.lit(0).cast("bigint"), lambda s, p: s + p["node_count"]).alias("n_nodes"))


@query(
    """WITH p AS (SELECT l_orderkey, l_returnflag AS hash, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2),
    f AS (SELECT l_orderkey, string_agg(l_file, ',' ORDER BY seen) AS files FROM (SELECT l_orderkey, l_file, min((l_linenumber, l_partkey, l_suppkey)) AS seen FROM (SELECT *, 'f' || (l_suppkey % 7) AS l_file FROM lineitem) JOIN (SELECT l_orderkey, min(hash) AS h FROM p GROUP BY 1) USING (l_orderkey) WHERE l_returnflag = h GROUP BY 1, 2) GROUP BY 1)
    SELECT o_orderkey::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x' END AS id, o_orderstatus AS language, count(p.hash)::BIGINT AS path_count, coalesce(sum(p.n), 0)::BIGINT AS nodes, coalesce(any_value(files), '') AS files,
    CASE WHEN o_orderkey % 3 = 0 THEN 'https://github.com/o/' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'https://github.com/p/' || o_custkey END AS project_url,
    CASE WHEN o_orderkey % 3 = 2 THEN 'u' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'https://github.com/p/' || o_custkey || '/commit/1' END AS commit_url, CASE WHEN o_orderkey % 2 = 0 THEN '["CWE-' || o_custkey || '"]' ELSE '[]' END AS cwes, (1 + o_orderkey % 2)::BIGINT AS combos
    FROM orders LEFT JOIN p ON l_orderkey = o_orderkey LEFT JOIN f ON f.l_orderkey = o_orderkey GROUP BY ALL"""
)
def nested_catalog(spark, sf):
    i = a.table(spark, sf, "lineitem").withColumn("l_file", F.concat(F.lit("f"), (F.col("l_suppkey") % 7).cast("string")))
    node = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_file")
    nodes = i.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.transform(F.sort_array(F.collect_list(node)), lambda x: F.struct(x["l_linenumber"].alias("line_number"), x["l_file"].alias("file_name"))).alias("nodes"))
    paths = nodes.groupBy("o_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "nodes")))).alias("paths"))
    key, who, odd = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderkey") % 2 == 1
    meta = F.to_json(
        F.struct(
            F.when(~odd, key.cast("string")).alias("cve_id"), F.when(key % 3 == 0, F.concat(F.lit("o/"), who)).otherwise(who).alias("project"), F.when(key % 3 == 1, F.concat(F.lit("https://github.com/p/"), who, F.lit("/commit/1"))).alias("html_url"),
            F.when(key % 3 == 2, F.concat(F.lit("u"), who)).alias("url"), F.when(~odd, F.array(F.concat(F.lit("CWE-"), who))).alias("cwe_id"),
        ), {"ignoreNullFields": "false"},
    )
    combos = F.when(odd, F.lit('{"files": [["a"], ["a", "b"]]}')).otherwise(F.lit('{"files": [["a"]]}'))
    files = a.table(spark, sf, "orders").join(paths, "o_orderkey", "left").select(F.col("o_orderstatus").alias("language"), F.concat(key.cast("string"), F.when(odd, "x_y_z").otherwise("_q")).alias("folder"), F.coalesce("paths", F.lit("{}")).alias("paths"), meta.alias("meta"), combos.alias("combos"))
    made = catalog.nested_catalog(files)
    count = F.aggregate("paths", F.lit(0).cast("bigint"), lambda s, p: s + p["node_count"])
    return made.select(
        "id", "language", F.col("path_count").cast("bigint").alias("path_count"), count.alias("nodes"), F.coalesce(F.array_join(F.get("paths", F.lit(0))["files"], ","), F.lit("")).alias("files"), "project_url",
        F.try_variant_get("commit_url", "$", "string").alias("commit_url"), F.to_json("cwes").alias("cwes"), F.col("file_combo_count").cast("bigint").alias("combos"),
    )


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_writer_merge(spark, sf):
    return catalog.last_writer(a.table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    """WITH o AS (SELECT o_custkey AS c, 'K' || (o_orderkey % 50) AS k, max(o_orderkey) AS n FROM orders GROUP BY ALL),
    found AS (SELECT c, k AS key, CASE WHEN n % 2 = 0 THEN k ELSE 'own' END AS cve, n FROM o WHERE c % 6 = 0
        UNION ALL SELECT c, (c % 50)::VARCHAR, '', c FROM o WHERE c % 6 = 1
        UNION ALL SELECT c, lpad(c::VARCHAR, 9, '0'), lpad(c::VARCHAR, 9, '0'), c FROM o WHERE c % 6 = 2)
    SELECT key, cve, n::BIGINT AS n, c::BIGINT AS file FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (c % 3 = 2) DESC, c DESC) AS r FROM (SELECT DISTINCT * FROM found)) WHERE r = 1"""
)
def manual_merge(spark, sf):
    """Files of one customer each: an object of entries, a single entry under a number, one under its file's name, and three shapes that don't count."""
    c = F.col("o_custkey")
    each = a.table(spark, sf, "orders").groupBy("o_custkey", F.concat(F.lit("K"), (F.col("o_orderkey") % 50).cast("string")).alias("k")).agg(F.max("o_orderkey").alias("n"))
    entry = F.struct(F.when(F.col("n") % 2 == 1, "own").alias("cve"), F.array(F.lit(1)).alias("real_path"), F.col("n").alias("n"))
    files = each.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", entry)))).alias("many"))
    number = c.cast("string")
    single = F.concat(F.lit('"output_path": null, "n": '), number, F.lit("}"))
    shapes = [F.col("many"), F.concat(F.lit('{"cve": "", "cve_id": '), (c % 50).cast("string"), F.lit(", "), single), F.concat(F.lit("{"), single), F.concat(F.lit('{"x": {"real_path": 1}, "y": '), number, F.lit("}")), F.concat(F.lit('[{"real_path": '), number, F.lit("}]")), F.lit("{")]
    content = F.coalesce(*(F.when(c % 6 == i, s) for i, s in enumerate(shapes)))
    folder = F.when(c % 3 == 2, "m/z/").otherwise("m/a-b/")
    files = files.select(F.concat(folder, F.lpad(number, 9, "0"), F.lit(".json")).alias("path"), content.alias("content"))
    made = manual.merged(manual.manual_entries(files))
    return made.select("key", "cve", F.get_json_object("entry", "$.n").cast("bigint").alias("n"), F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("file"))


@query(
    """SELECT source AS case_id, p.prompt, replace(p.template, '$_LANGUAGE', 'Python') AS prompt_text, length(string_agg('===== ' || doc_id || ' =====' || chr(10) ||
    array_to_string(list_transform(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), lambda x, i: 'L' || i || ': ' || x), chr(10)), chr(10) || chr(10) ORDER BY doc_id)) AS n
    FROM documents, (VALUES ('llmpath', 'Trace $_LANGUAGE paths'), ('baseline', 'Review')) p(prompt, template) WHERE text <> '' GROUP BY ALL"""
)
def prompt_frame(spark, sf):
    d = a.table(spark, sf, "documents").where("text <> ''")
    files = d.select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    listed = d.groupBy(F.col("source").alias("case_id")).agg(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")).alias("files"))
    inputs = prompts.prompt_inputs(listed.withColumn("combo", F.lit(0)), files).withColumn("language", F.lit(" python "))
    templates = spark.createDataFrame([("llmpath", "Trace $_LANGUAGE paths"), ("baseline", "Review")], "prompt string, template string")
    made = prompts.prompt_frame(inputs, templates)
    return made.select("case_id", "prompt", "prompt_text", F.length("input").cast("bigint").alias("n"))


@query("SELECT o_orderpriority AS model, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def run_selection(spark, sf):
    cases = a.table(spark, sf, "orders").withColumns({"language": F.col("o_orderstatus"), "case_id": F.col("o_orderkey").cast("string")})
    o = prompts.RunConfig(all_cases=True, languages=("O", "F")).targets(cases)
    return o.groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open")).orderBy("model")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
