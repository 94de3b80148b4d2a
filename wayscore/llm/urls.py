"""Operator 7: URL filtering by curated rules and boosted trees, in DataFrame functions alone.

Trees are grown on binned lexical features by histogram aggregation: a level
of a tree is one grouped sum over the distinct bin vectors, and a finished
model is a nested CASE expression that runs inside the scan's stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import written

#: (host, path start, verdict); a rule fits its host and all its subdomains.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Parts of host names by which seed URLs are labelled as unwanted, where no labelled URLs are given.
UNWANTED = ("adult", "ads", "bets", "casino", "cheap", "farm", "free", "pills", "poker", "porn", "spam", "track", "viagra", "win", "xxx")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "longest_label", "suffix_rate", "host_entropy", "vowel_ratio", "distinct")
BINS = 16
#: Trees whose sum is an expression over the training table; then it is written into its margins.
FOLDED = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as (text, verdict), null where none fits; of equally long ones the first in order of text."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    runs = F.array_sort(chars)
    state = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s, c):
        same = s["last"] == c
        closed = F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)
        return F.struct(
            c.alias("last"), F.when(same, s["run"] + 1).otherwise(1.0).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + closed).alias("sum")
        )

    total = F.aggregate(runs, state, step, lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds host, path, suffix and the lexical features to ``urls`` (url)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    out = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = F.split("host", r"\.")
    return out.withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.length(F.col("path")) - F.length(F.translate("path", "/", "")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "digit_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(F.col("host"), "[^0-9]", "")), F.length("host")), F.lit(0.0)).cast("double"),
            "entropy": _entropy(url),
            "parameters": (F.length(url) - F.length(F.translate(url, "=", ""))).cast("double"),
            "hyphens": (F.length("host") - F.length(F.translate(F.col("host"), "-", ""))).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "host_entropy": _entropy(F.col("host")),
            "vowel_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(F.col("host"), "[^aeiou]", "")), F.length("host")), F.lit(0.0)).cast("double"),
            "distinct": F.size(F.array_distinct(F.filter(F.split("host", ""), lambda c: c != ""))).cast("double"),
        }
    )


def host_held_out(url: Column, fold: int = 0) -> Column:
    """Whether a URL's host is kept from training: a fifth of the hosts, by crc32 without hyphens, so that counterparts go with it."""
    return F.crc32(F.translate(host_of(url), "-", "").cast("binary")) % 5 == fold


def seed_labels(pages: DataFrame, held_out: bool = True) -> DataFrame:
    """Labelled URLs (url, label) where none are given: 1 where a part of the host name is in UNWANTED, else 0.

    No feature shows the words themselves.  With ``held_out`` a fifth of the
    hosts is left out of training; ``held_out_report`` tells how the trees
    judge hosts they have not seen.  Null URLs and those without a host give
    no label.
    """
    parts = F.split(host_of(F.col("url")), r"[.\-]")
    seeds = pages.select("url", F.arrays_overlap(parts, F.array(*map(F.lit, UNWANTED))).cast("int").alias("label"))
    seeds = seeds.where(host_of(F.col("url")) != "")
    return seeds.where(~host_held_out(F.col("url"))) if held_out else seeds


def counterparts(labelled: DataFrame) -> DataFrame:
    """``labelled`` (url, label), and for each URL the same one with the hyphens of its host turned, under the same label.

    A host with hyphens loses them; one without gets a hyphen into its first
    part of six characters or more, and has no counterpart if there is none.
    So a hyphen alone tells nothing, and the other features must decide.
    """
    host = host_of(F.col("url"))
    turned = F.when(F.contains(host, F.lit("-")), F.translate(host, "-", "")).otherwise(F.regexp_replace(host, r"^((?:[^.]*\.)*?)([^.]{3})([^.]{3,}\..*)$", "$1$2-$3"))
    rest = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)$", 1)
    both = F.when(turned != host, F.array("url", F.concat(F.regexp_extract("url", r"(?s)^(.*?://)", 1), turned, rest)))
    return labelled.select(F.explode(F.coalesce(both, F.array("url"))).alias("url"), "label")


#: Suffixes of host names, the most frequent ones first, whose label rate is a feature of its own; it bounds what is broadcast.
SUFFIXES = 2000


def suffix_rates(labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_rate): the smoothed label rate of the most frequent suffixes; all others have the rate of unseen ones."""
    rate = labelled.withColumn("suffix", F.element_at(F.split(host_of(F.col("url")), r"\."), -1)).where(F.length("suffix") <= 63)
    rate = rate.groupBy("suffix").agg(F.count("*").alias("n"), ((F.sum("label") + 1) / (F.count("*") + 20)).alias("suffix_rate"))
    return rate.orderBy(F.desc("n"), "suffix").limit(SUFFIXES).select("suffix", "suffix_rate")


def _with_rates(urls: DataFrame, rates: DataFrame) -> DataFrame:
    return urls.join(F.broadcast(rates), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(0.05)))


class BoostedTrees:
    """Gradient-boosted trees of logistic loss on binned features.

    ``edges`` are the bin edges of each feature, ``trees`` lists of nested
    splits (feature, bin, left, right) with numbers as leaves.
    """

    def __init__(self, rounds: int = 20, depth: int = 3, rate: float = 0.6, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.penalty = rounds, depth, rate, penalty
        self.edges: dict[str, list[float]] = {}
        self.trees: list = []
        self.base = 0.0

    def binned(self, rows: DataFrame) -> DataFrame:
        """Replaces the features by bin numbers b_<feature>."""
        made = {}
        for f in FEATURES:
            b = F.lit(0)
            for edge in self.edges[f]:
                b = b + (F.col(f) > edge).cast("int")
            made[f"b_{f}"] = b
        return rows.withColumns(made)

    def _expression(self, tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, at, left, right = tree
        return F.when(F.col(f"b_{f}") <= at, self._expression(left)).otherwise(self._expression(right))

    def margin(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + self._expression(tree)
        return total

    def fit(self, labelled: DataFrame) -> BoostedTrees:
        """``labelled``: the features and label. Every row counts; only sums per bin and tree node reach the driver."""
        probes = [i / BINS for i in range(1, BINS)]
        found = labelled.agg(*(F.percentile_approx(f, probes, 10_000).alias(f) for f in FEATURES), *(F.max(f).alias(f"max_{f}") for f in FEATURES), F.avg("label").alias("rate")).first()
        for f in FEATURES:
            self.edges[f] = sorted(set(found[f] or []) - {found[f"max_{f}"]})
        share = min(max(found["rate"] or 0.0, 1e-4), 1 - 1e-4)
        self.base = math.log(share / (1 - share))
        if found["rate"] is None or found["rate"] in (0.0, 1.0):
            return self
        bins = [f"b_{f}" for f in FEATURES]
        table = written(self.binned(labelled).groupBy(*bins).agg(F.count("*").alias("n"), F.sum("label").alias("y")), "bins")
        table, stored, folded = table.withColumn("margin", F.lit(self.base)), table, 0
        for done in range(1, self.rounds + 1):
            self.trees.append(self._grow(table, folded))
            if done % FOLDED == 0 and done < self.rounds:
                table = stored = written(table.withColumn("margin", self._added("margin", folded)), "bins", stored)
                folded = done
        return self

    def _added(self, margin: str, folded: int) -> Column:
        """``margin``, which holds the first ``folded`` trees, with the others."""
        return sum((self._expression(tree) for tree in self.trees[folded:]), F.col(margin))

    def _grow(self, table: DataFrame, folded: int):
        p = 1 / (1 + F.exp(-self._added("margin", folded)))
        rows = table.withColumn("g", F.col("y") - F.col("n") * p).withColumn("h", F.col("n") * p * (1 - p))
        tree: dict[int, tuple] = {}
        totals: dict[int, tuple[float, float]] = {}
        live = [1]
        for _ in range(self.depth):
            node = F.lit(1)
            for at in sorted(tree):
                f, b = tree[at]
                node = F.when(node == at, F.when(F.col(f"b_{f}") <= b, 2 * at).otherwise(2 * at + 1)).otherwise(node)
            cells = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES)))
            sums = rows.select(node.alias("node"), "g", "h", cells.alias("c")).groupBy("node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            best: dict[int, tuple] = {}
            for at in live:
                for f in FEATURES:
                    own = sorted((r.b, r.g, r.h) for r in sums if r.node == at and r.f == f)
                    g, h = math.fsum(x[1] for x in own), math.fsum(x[2] for x in own)
                    totals[at] = (g, h)
                    left_g = left_h = 0.0
                    for b, bg, bh in own[:-1]:
                        left_g, left_h = left_g + bg, left_h + bh
                        gain = left_g**2 / (left_h + self.penalty) + (g - left_g) ** 2 / (h - left_h + self.penalty) - g**2 / (h + self.penalty)
                        if gain > 1e-6 and gain > best.get(at, (0,))[0] * (1 + 1e-9):
                            best[at] = (gain, f, b, (left_g, left_h), (g - left_g, h - left_h))
            live = []
            for at, (_, f, b, left, right) in best.items():
                tree[at] = (f, b)
                totals[2 * at], totals[2 * at + 1] = left, right
                live += [2 * at, 2 * at + 1]
            if not live:
                break

        def shape(at):
            if at in tree:
                return (*tree[at], shape(2 * at), shape(2 * at + 1))
            g, h = totals.get(at, (0.0, 0.0))
            return float(self.rate * g / (h + self.penalty))

        return shape(1)


def trained(labelled: DataFrame) -> tuple[BoostedTrees, DataFrame]:
    """Trees grown on ``labelled`` (url, label: 1 block), and the rates of suffixes they go by."""
    rates = written(suffix_rates(labelled), "suffixes")
    rows = _with_rates(lexical(labelled), rates)
    return BoostedTrees().fit(written(rows.select(*FEATURES, F.col("label").cast("double").alias("label")), "labelled")), rates


def _score(model: BoostedTrees) -> Column:
    return 1 / (1 + F.exp(-model.margin()))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Judges every row of ``pages`` (page_id, url) by ``rules``, else by trees trained on ``labelled`` (url, label: 1 block).

    Returns page_id, host, path, rule, verdict and score (the trees'
    probability of block, given for every row).

    A null url, or one without ``://``, has an empty host and path, no rule,
    and the trees' verdict on empty features.  Repeated rows are judged alike;
    labelled URLs that repeat count each time, with contradictory labels too.
    URLs of any length are read whole.  Without labelled URLs, or with one
    label alone, the verdict where no rule fits follows that label's share:
    allow if there is none.  An empty table gives no rows; other columns are
    ignored.
    """
    model, rates = trained(labelled)
    rows = lexical(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        model.binned(_with_rates(rows, rates))
        .withColumns({"rule": name, "score": _score(model)})
        .select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
    )


def held_out_report(labelled: DataFrame, fold: int = 0, threshold: float = 0.5) -> DataFrame:
    """How trees grown on the other hosts of ``labelled`` judge the URLs of the hosts of one fold: hosts, urls and blocked, by label."""
    out = host_held_out(F.col("url"), fold)
    model, rates = trained(labelled.where(~out))
    judged = model.binned(_with_rates(lexical(labelled.where(out)), rates)).withColumn("score", _score(model))
    return judged.groupBy("label").agg(F.countDistinct("host").alias("hosts"), F.count("*").alias("urls"), F.sum((F.col("score") >= threshold).cast("int")).alias("blocked"))
