"""Operator 9: main text of web pages by minimum cuts.

A page is a sequence of text blocks in a tree of elements.  A logistic
regression, learned from pages whose main text is marked by a landmark, costs
calling a block content or boilerplate: its log odds become the capacity of the
block's edge to a terminal.  Neighbours in page order, blocks and their
elements, and elements and their parents are joined by smoothness edges.  The
minimum cut between the terminals separates content from boilerplate.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import fitted, small_batches

# Element names of HTML by their role.
RAW = ("head", "iframe", "math", "noscript", "object", "script", "style", "svg", "template", "textarea", "title")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
    "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
OUTSIDE = ("aside", "button", "dialog", "footer", "form", "label", "menu", "nav", "option", "select")
WORDS_OUTSIDE = (
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer",
    "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promoted",
    "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "topbar", "widget",
)
WORDS_INSIDE = ("body", "content", "entry", "post", "prose", "story", "text")
LANDMARKS = ("article", "main")
SECTIONS = ("article", "aside", "dialog", "footer", "form", "header", "main", "nav", "section")
_BAD, _GOOD = frozenset(WORDS_OUTSIDE), frozenset(WORDS_INSIDE)

#: Text and place in the element tree alone: no name in the markup is among them.
FEATURES = ("constant", "size", "size beside", "links", "sentence", "company", "household")
PENALTY = 8.0
#: Log odds where there is no labelled page to learn from; learned from the pages of the sf0.1 test tables.
WEIGHTS = (-2.26, -0.12, 0.41, -2.62, -1.11, 3.0, 5.62)
#: Fixed log odds that markup adds to the learned ones: a landmark on the page speaks for the blocks in it and against the others,
#: the name of a part beside the main text against its blocks and, less, for the others of the page.
LANDMARK_PRIOR, BESIDE_PRIOR, UNNAMED_PRIOR = 4.0, 9.0, 2.0
#: Cost of telling apart two nodes that are as near as can be, in log odds.
SMOOTH = 1.0
#: Pages that the costs are learned from, at most.
SAMPLE = 400


def blocks_of(html: str) -> list[tuple[str, float, tuple, tuple]]:
    """Text blocks in page order: (text, share of it in links, path of (element number, name, words of class, id and role), innermost name)."""
    import re
    from html import unescape

    raw, void, block = set(RAW), set(VOID), set(BLOCK)
    token = re.compile(
        r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
        r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
        re.S,
    )
    attribute = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
    out: list = []
    path: list = []
    text: list[str] = []
    linked, made, at = 0, 0, 0
    in_link = False

    def close():
        nonlocal linked
        whole = " ".join(unescape("".join(text)).split())
        if whole:
            out.append((whole, min(1.0, linked / len(whole)), tuple(path), path[-1][1] if path else ""))
        text.clear()
        linked = 0

    def add(piece):
        nonlocal linked
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def up_to(name, barrier=()):
        for i in range(len(path) - 1, -1, -1):
            if path[i][1] == name:
                del path[i:]
                return
            if path[i][1] in barrier:
                return

    while at < len(html):
        m = token.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, rest = m[1] or m[4], m[3] if m[2] else m[6]
        if name in raw and not ending:
            if name != "head" and not rest.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                if name == "textarea":
                    close()
            elif name == "head":
                end = re.compile(r"</head\s*>|<body\b", re.I).search(html, at)
                if end:
                    at = end.end() if end[0][1] == "/" else end.start()
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = not ending
            continue
        if name not in block:
            continue
        close()
        if ending:
            in_link = False
            up_to(name, barrier=("td", "th", "table") if name != "table" else ())
            continue
        if name == "hr":
            continue
        if path and path[-1][1] == "p":
            path.pop()
        if name == "li":
            up_to("li", barrier=("ul", "ol", "menu"))
        made += 1
        words: list[str] = []
        for key, value in attribute.findall(rest or ""):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
                words.append("hidden")
            elif key != "style":
                words += re.split(r"[^a-z]+", value)
        if name not in void:
            path.append((made, name, tuple(w for w in words if w)))
    close()
    return out


def _region(element) -> bool:
    """Whether an element names the main text of a page."""
    return element[1] in LANDMARKS or any(m in LANDMARKS for m in element[2])


def _marked(path) -> bool:
    """Whether an element of ``path`` names something beside the main text."""
    inside = False
    for element in path:
        _, name, marks = element
        inside = inside or _region(element)
        if name in OUTSIDE or name == "header" and not inside or "hidden" in marks or name not in ("html", "body") and not _BAD.isdisjoint(marks):
            return True
    return False


def features_of(blocks: list) -> list[list[float]]:
    """Features of each block in the order of FEATURES; neither landmarks nor other names of the markup are among them.

    A block's household is the share of the page's text in blocks whose element
    has the same parent, its company the share of those of its element's name.
    """
    import math

    sizes = [math.log1p(len(b[0].split())) / 3 for b in blocks]
    company: dict = {}
    household: dict = {}
    for text, _, path, name in blocks:
        parent = path[-2][0] if len(path) > 1 else 0
        company[parent, name] = company.get((parent, name), 0) + len(text)
        household[parent] = household.get(parent, 0) + len(text)
    whole = max(1, sum(household.values()))
    rows = []
    for i, (text, links, path, name) in enumerate(blocks):
        beside = [sizes[j] for j in (i - 1, i + 1) if 0 <= j < len(blocks)]
        parent = path[-2][0] if len(path) > 1 else 0
        rows.append(
            [
                1.0,
                sizes[i],
                sum(beside) / len(beside) if beside else sizes[i],
                links,
                float(text[-1] in ".!?…。\"»”"),
                company[parent, name] / whole,
                household[parent] / whole,
            ]
        )
    return rows


def landmark_labels(blocks: list) -> list[int | None] | None:
    """1 for the blocks in a landmark of the main text, 0 for those outside; None for a page without landmarks.

    A block in a part of the landmark that is named as beside the main text
    (comments in an article) teaches nothing: its label is None.
    """
    if not any(_region(e) for b in blocks for e in b[2]):
        return None
    inside = [any(_region(e) for e in b[2]) for b in blocks]
    return [None if held and _marked(b[2]) else int(held) for held, b in zip(inside, blocks)]


def fit_costs(x, y, steps: int = 60):
    """Weights of a logistic regression by Newton steps; those of WEIGHTS without both labels.

    The squared penalty is on the distance from WEIGHTS, so that a few blocks move them little.
    """
    import numpy as np

    if not len(y) or y.min() == y.max():
        return list(WEIGHTS)
    usual = np.array(WEIGHTS)
    w = usual.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w)), x.T @ (y - p) - PENALTY * (w - usual))
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def content_scores(blocks: list, weights) -> list[float]:
    """The cost of calling each block boilerplate less that of calling it content, in log odds."""
    inside = [any(_region(e) for e in b[2]) for b in blocks]
    beside = [_marked(b[2]) for b in blocks]
    landmark, unnamed = LANDMARK_PRIOR * any(inside), UNNAMED_PRIOR * any(beside)
    scores = [sum(v * w for v, w in zip(row, weights)) for row in features_of(blocks)]
    return [s + (landmark if held else -landmark) + (-BESIDE_PRIOR if off else unnamed) for s, held, off in zip(scores, inside, beside)]


def neighbourhood(blocks: list, smooth: float) -> tuple[int, list[tuple[int, int, float]]]:
    """The nodes of a page's graph, blocks first and then elements, and its smoothness edges.

    Blocks that follow each other are tied by their distance in the DOM, a
    block to its element and an element to its parent; ties across the bounds
    of a part of the page (a sectioning element, or one marked by its class)
    are weaker.
    """
    edges: list = []
    node: dict[int, int] = {}
    n = len(blocks)
    for i, (_, _, path, _) in enumerate(blocks):
        if i:
            before = {e[0] for e in blocks[i - 1][2]}
            shared = sum(e[0] in before for e in path)
            apart = len(path) + len(blocks[i - 1][2]) - 2 * shared
            edges.append((i - 1, i, smooth / (1 + apart)))
        below, weight = i, smooth
        for element in reversed(path):
            known = element[0] in node
            at = node.setdefault(element[0], n + len(node))
            edges.append((below, at, weight))
            if known:
                break
            part = element[1] in SECTIONS or not _BAD.isdisjoint(element[2]) or not _GOOD.isdisjoint(element[2])
            below, weight = at, smooth / 4 if part else smooth
    return n + len(node), edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cut: True for content.

    A node whose terminal capacity outweighs all its edges keeps its side in
    every minimum cut, so it is settled first and its edges pass into its
    neighbours' terminals; maximum flow by blocking flows decides the rest.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    score, label = list(scores), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(score[i]) >= sum(near[i].values()):
            label[i] = score[i] > 0
            for j, w in near[i].items():
                score[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i].clear()
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    source, sink = -1, -2
    flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        if score[i] > 0:
            flow[source][i], flow[i][source] = score[i], 0.0
        elif score[i] < 0:
            flow[i][sink], flow[sink][i] = -score[i], 0.0
    while True:
        depth = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in flow[i].items():
                if c > 1e-9 and j not in depth:
                    depth[j] = depth[i] + 1
                    queue.append(j)
        if sink not in depth:
            break
        ways = {i: iter(list(flow[i])) for i in depth}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(flow[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    flow[a][b] -= push
                    flow[b][a] = flow[b].get(a, 0.0) + push
                full = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if flow[a][b] <= 1e-9)
                del path[full + 1 :]
                continue
            for j in ways[i]:
                if flow[i][j] > 1e-9 and depth.get(j) == depth[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
    for i in rest:
        label[i] = i in depth
    return label


def main_blocks(html: str, weights=None, smooth: float = SMOOTH) -> list[str]:
    """The blocks of ``html`` on the content side of the minimum cut."""
    blocks = blocks_of(html)
    scores = content_scores(blocks, weights or WEIGHTS)
    n, edges = neighbourhood(blocks, smooth)
    label = minimum_cut(scores + [0.0] * (n - len(blocks)), edges)
    return [b[0] for b, keep in zip(blocks, label) if keep]


def _training_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        x, y = [], []
        for page in batch.column(0).to_pylist():
            blocks = blocks_of(page or "")
            for row, label in zip(features_of(blocks), landmark_labels(blocks) or ()):
                if label is not None:
                    x.append(row)
                    y.append(label)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])


def learned_costs(pages: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Block costs learned from at most ``sample`` of the pages that have a landmark of the main text, chosen by a hash.

    Their blocks are labelled by the landmark; features are of the text and
    the element tree, so no feature shows a landmark or another name.
    """
    import pickle

    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    labelled = labelled.select("html", F.xxhash64("page_id", "url", F.length("html"), F.substring("html", -200, 200)).alias("order"))
    # the least hashes first, so that only chosen pages leave their tasks; copies count once
    last = labelled.select("order").distinct().orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    chosen = labelled.where(F.col("order") <= F.lit(last)).groupBy("order").agg(F.first("html").alias("html"))

    def run(table):
        import numpy as np

        if table is None or not table.num_rows:
            return list(WEIGHTS)
        x = np.array(table.column("x").combine_chunks().flatten(), dtype=float).reshape(-1, len(FEATURES))
        y = np.asarray(table.column("y"), dtype=float)
        order = np.lexsort(x.T)  # sums don't depend on the order of tasks
        return fit_costs(x[order], y[order])

    return pickle.loads(fitted(chosen.select("html").mapInArrow(_training_rows, "x array<double>, y int"), run))


def _extracted(weights, smooth: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = ["\n".join(main_blocks(h or "", weights, smooth)) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, weights=None, smooth: float = SMOOTH) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Block costs are learned from the pages themselves, unless ``weights`` (in
    the order of FEATURES) are given.  A null or empty html, or one without
    content, gives an empty text.  Broken markup is read as far as it goes.
    Rows are independent: repeated rows, null ids and urls pass through, and
    other columns are ignored.  An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(weights or learned_costs(rows), smooth), "page_id bigint, url string, text string, n_chars bigint")
