"""Operator 12: secrets in texts, by fixed patterns and a linear-chain conditional random field.

A token is tagged as the begin of a secret, as its inside or as outside.  Scores
come from its shape, from the words around it and from the whole text; what tag
may follow depends on the tag before, and an inside can't follow white space.
Scores are relative to outside, and a begin costs the same after every tag, so
the best tagging splits at white space.  A chunk whose upper bound on the gain of
any secret isn't above zero is outside whatever surrounds it; Viterbi decodes the rest.

The field learns from a bounded sample: windows around values that the patterns
find, the same with random strings of other alphabets in their place, with the
words around them exchanged, and windows from anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import fitted, small_batches

KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[\w+/-]+|[^\w\s]")
#: Documents whose windows may be learned from, windows of one document, chunks on either side of a value.
SAMPLE_DOCS, WINDOWS, REACH = 4000, 4, 12
#: Windows without and with a value that are learned from.
PLAIN, VALUES = 800, 300
VOCABULARY = 600
LEAST = 8  # characters of a secret that the field may report
SPAN = "struct<kind:string,start:bigint,end:bigint>"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, a kind's matches leftmost and apart."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


# -- features -----------------------------------------------------------------

_KIND = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 95 for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
SHAPES = 344
FILES = 11
#: Where words are seen: one, two and three tokens before in the same chunk, the token after, one and two chunks before, the chunk after.
PLACES = 7


def shape(token: str) -> tuple[int, int, int, int, int]:
    """Feature numbers of a token's form: length, kinds of characters, share of digits, changes of kind, hexadecimal, a sign."""
    b = token.encode("utf-8", "surrogatepass")
    k = b.translate(_KIND)
    n, low, up, digits = len(k), k.count(b"a"), k.count(b"A"), k.count(b"0")
    size = 0 if n < 4 else 1 if n < 8 else 2 if n < 12 else 3 if n < 16 else 4 if n < 20 else 5 if n < 32 else 6 if n < 48 else 7
    mask = (low > 0) + 2 * (up > 0) + 4 * (digits > 0) + 8 * (low + up + digits < n)
    share = 0 if not digits else 1 if digits * 7 < n else 2 if digits * 5 < n * 2 else 3 if digits < n else 4
    runs = (len(_RUNS.sub(rb"\1", k)) - 1) / n
    change = 0 if not runs else 1 if runs < 0.12 else 2 if runs < 0.3 else 3
    lone = ord(token) if n == 1 and b[0] < 127 and not token.isalnum() else 127
    return size * 16 + mask, 128 + size * 5 + share, 168 + size * 4 + change, 200 + 8 * (not b.lower().strip(b"0123456789abcdef")) + size, 216 + lone


def word_of(chunk: str) -> str:
    """A chunk as its neighbours see it: in lower case, less the signs at its ends unless it is nothing else."""
    return (chunk.strip(_SIGNS) or chunk).lower()


def file_features(text: str) -> tuple[int, int, int]:
    """Feature numbers of a whole text: shares of digits and of signs of code, length."""
    n = len(text) or 1
    digits = sum(map(text.count, "0123456789")) / n
    code = sum(map(text.count, "={};")) / n
    return (
        0 if digits < 0.002 else 1 if digits < 0.02 else 2 if digits < 0.1 else 3,
        4 + (0 if code < 0.001 else 1 if code < 0.01 else 2),
        7 + (0 if n < 200 else 1 if n < 1000 else 2 if n < 5000 else 3),
    )


class Field:
    """Weights of a field: of features (rows) for begin and inside (columns), and of what follows what.

    ``moves``: begin, begin to inside, inside to inside, begin to the end, inside to the end.
    """

    def __init__(self, words: dict[str, int], weights=None, moves=None):
        import numpy as np

        self.words = words
        self.place = SHAPES + FILES
        self.size = self.place + PLACES * (len(words) + 1)
        self.weights = np.zeros((self.size, 2)) if weights is None else weights
        self.moves = np.zeros(5) if moves is None else moves

    def seen(self, place: int, word: str | None) -> int:
        """The feature of a known word at a place; unknown and absent words share one."""
        return self.place + place * (len(self.words) + 1) + (self.words.get(word, 0) if word else 0)

    def inner(self, chunk: str) -> tuple[list, list]:
        """Tokens of a chunk as (start, end), and the features that the chunk itself gives them."""
        found = [(m.start(), m.end()) for m in TOKEN.finditer(chunk)]
        tokens = [chunk[a:b] for a, b in found]
        low = [t.lower() for t in tokens]
        at = [0, 0, 0, *(self.words.get(t, 0) for t in low), 0]  # absent words are unknown ones
        p, n = self.place, len(self.words) + 1
        return found, [[*shape(t), p + at[i + 2], p + n + at[i + 1], p + 2 * n + at[i], p + 3 * n + at[i + 4]] for i, t in enumerate(tokens)]

    def outer(self, before: str | None, second: str | None, after: str | None) -> list[int]:
        """Features that a chunk's surroundings give its tokens; words as of ``word_of``."""
        return [self.seen(4, before), self.seen(5, second), self.seen(6, after)]


def viterbi(scores, moves) -> list[int]:
    """The best tags (0 outside, 1 begin, 2 inside) of the tokens of one chunk; outside where a secret gains nothing.

    ``scores``: begin and inside of each token.
    """
    begin, b_i, i_i, b_end, i_end = moves
    best, back = [0.0, float("-inf"), float("-inf")], []
    for b, i in scores:
        ends = [best[0], best[1] + b_end, best[2] + i_end]
        out = max(range(3), key=lambda t: ends[t])
        into = max((1, 2), key=lambda t: best[t] + (b_i if t == 1 else i_i))
        back.append((out, out, into))
        best = [ends[out], ends[out] + begin + b, best[into] + (b_i if into == 1 else i_i) + i]
    ends = [best[0], best[1] + b_end, best[2] + i_end]
    tag = max(range(3), key=lambda t: ends[t])
    tags = []
    for links in reversed(back):
        tags.append(tag)
        tag = links[tag]
    return tags[::-1]


# -- learning -----------------------------------------------------------------


def likelihood(weights, moves, rows, starts, tags):
    """Log-likelihood of tagged tokens and its gradients.

    ``rows``: feature numbers (tokens x features), ``starts``: the first token of
    each chunk, ``tags``: 0, 1 or 2 of each token.  Chunks are independent and step
    together, those that are over drop out.
    """
    import numpy as np

    n = len(rows)
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    starts_by_size, sizes_by_size = starts[order], sizes[order]
    longest = int(sizes.max())
    live = [int((sizes > t).sum()) for t in range(longest + 1)]  # chunks with a token at place t come first
    emission = weights[rows].sum(axis=1)  # tokens x 2
    step = np.zeros((3, 3))
    begin, b_i, i_i, b_end, i_end = moves
    step[0] = 0, begin, -np.inf
    step[1] = b_end, b_end + begin, b_i
    step[2] = i_end, i_end + begin, i_i
    close = np.array([0, b_end, i_end])

    def total(x, axis):
        most = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)

    at = [starts_by_size[: live[t]] + t for t in range(longest)]
    e = [np.concatenate([np.zeros((live[t], 1)), emission[at[t]]], axis=1) for t in range(longest)]
    alpha = [np.tile([0.0, -1e30, -1e30], (len(starts), 1))]
    step = np.where(np.isfinite(step), step, -1e30)
    for t in range(longest):
        alpha.append(total(alpha[t][: live[t], :, None] + step, 1) + e[t])
    beta: list = [None] * longest
    for t in reversed(range(longest)):
        after = np.tile(close, (live[t], 1))
        if t + 1 < longest:
            after[: live[t + 1]] = beta[t + 1]
        e[t] = e[t] + after
        beta[t] = total(step + e[t][:, None, :], 2)
    whole = beta[0][:, 0]
    expected = np.zeros((n, 2))
    pairs, ends = np.zeros((3, 3)), np.zeros(3)
    for t in range(longest):
        joint = np.exp(alpha[t][: live[t], :, None] + step + e[t][:, None, :] - whole[: live[t], None, None])
        pairs += joint.sum(axis=0)
        expected[at[t]] = joint.sum(axis=1)[:, 1:]
        ends += joint[live[t + 1] :].sum(axis=(0, 1))
    grad_w = np.zeros_like(weights)
    counted = lambda p, e: np.array([p[:, 1].sum(), p[1, 2], p[2, 2], p[1, 0] + p[1, 1] + e[1], p[2, 0] + p[2, 1] + e[2]])
    true = np.zeros((3, 3))
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    np.add.at(true, (np.where(first, 0, np.append(0, tags[:-1])), tags), 1)
    last = np.bincount(tags[starts + sizes - 1], minlength=3)
    grad_m = counted(true, last) - counted(pairs, ends)
    told = np.stack([tags == 1, tags == 2], axis=1) - expected
    for c in range(2):
        grad_w[:, c] = np.bincount(rows.ravel(), np.repeat(told[:, c], rows.shape[1]), minlength=len(weights))
    value = (emission * np.stack([tags == 1, tags == 2], axis=1)).sum() + counted(true, last) @ moves - whole.sum()
    return value, grad_w, grad_m


def maximised(field: Field, rows, starts, tags, penalty: float = 0.5, steps: int = 80) -> Field:
    """Adds weights to ``field`` by ascent with per-weight step sizes on the penalised likelihood."""
    import numpy as np

    w, m = field.weights, field.moves
    both = np.concatenate([w.ravel(), m])
    mean, square = np.zeros_like(both), np.zeros_like(both)
    for k in range(1, steps + 1):
        w, m = both[:-5].reshape(-1, 2), both[-5:]
        _, gw, gm = likelihood(w, m, rows, starts, tags)
        g = np.concatenate([gw.ravel(), gm]) - penalty * both
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        both = both + 0.3 * (1 - 0.9 * k / steps) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Field(field.words, both[:-5].reshape(-1, 2), both[-5:])


def random_secret(rng) -> str:
    """A random string as keys and tokens are written: hexadecimal, letters and digits, base 64, groups, with a prefix or dots."""
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda letters, n: "".join(rng.choice(list(letters), size=n))
    n = int(rng.integers(14, 56))
    way = int(rng.integers(9))
    if way == 0:
        return draw("0123456789abcdef", n)
    if way == 1:
        return draw("0123456789ABCDEF", n)
    if way == 2:
        return draw(small + digits, n)
    if way == 3:
        return draw(large + digits, n)
    if way == 4:
        return draw(small + large + digits + "+/", n) + "=" * int(rng.integers(3))
    if way == 5:
        return "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
    if way == 6:
        return draw(small, int(rng.integers(2, 5))) + rng.choice(["_", "-"]) + draw(small + large + digits, n)
    if way == 7:
        return ".".join(draw(small + large + digits + "_-", k) for k in (20, n, 27))
    return draw(small + large + digits, n)


#: What may stand before and after a key.
_FRAMES = (("", ""), ("", ""), ('"', '"'), ("'", "',"), ("key=", ""), ("auth: ", ""), ("(", ")"), ("id=", "&"), ("", "."))


def learned_from(windows, seed: int = 12) -> Field:
    """A field from windows (text, value start, value end, file features; start -1 where the window holds no value)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    plain = [w for w in windows if w[1] < 0]
    plain = plain[:: max(1, len(plain) // PLAIN)]
    windows = plain + [w for w in windows if w[1] >= 0][:VALUES]
    words = [c for w in plain for c in w[0].split()] or ["a"]
    seen: list = []  # (chunks, index of the value's chunk, start and end in it, file features)
    for text, a, b, told in windows:
        seen.append((text, a, b, told))
        if a < 0:
            continue
        for _ in range(3):
            seen.append((text[:a] + (s := random_secret(rng)) + text[b:], a, a + len(s), told))
        # exchanged words: nothing but the form tells; and a plain word in the value's place
        value = text[a:b] if rng.random() < 0.3 else random_secret(rng)
        left, right = (" ".join(rng.choice(words, size=REACH)) for _ in range(2))
        quote = rng.choice(["", '"'])
        seen.append((f"{left} {quote}{value}{quote} {right}", len(left) + 1 + len(quote), len(left) + 1 + len(quote) + len(value), told))
        word = str(rng.choice(words))
        seen.append((text[:a] + word + text[b:], -1, -1, told))
    for text, _, _, told in plain[:: max(1, len(plain) // 400)]:  # a key in the middle of anything
        blank = [m.start() for m in re.finditer(r"\s", text)]
        if blank:
            at, value = int(rng.choice(blank)) + 1, random_secret(rng)
            lead, tail = _FRAMES[int(rng.integers(len(_FRAMES)))]
            seen.append((text[:at] + lead + value + tail + " " + text[at:], at + len(lead), at + len(lead) + len(value), told))
    count: dict[str, int] = {}
    for text, *_ in seen:
        for t in text.lower().split():
            for x in {word_of(t), *TOKEN.findall(t)}:
                if len(x) <= 24:
                    count[x] = count.get(x, 0) + 1
    known = sorted((x for x in count if count[x] >= 5), key=lambda x: (-count[x], x))[:VOCABULARY]
    field = Field({x: i + 1 for i, x in enumerate(known)})
    rows, starts, tags = [], [], []
    for text, a, b, told in seen:
        chunks = [(m.start(), m.group()) for m in re.finditer(r"\S+", text)]
        keys = [word_of(c) for _, c in chunks]
        for i, (at, chunk) in enumerate(chunks):
            found, inner = field.inner(chunk)
            around = field.outer(keys[i - 1] if i else None, keys[i - 2] if i > 1 else None, keys[i + 1] if i + 1 < len(keys) else None)
            starts.append(len(rows))
            begun = False
            for (x, y), own in zip(found, inner):
                inside = a <= at + x and at + y <= b
                tags.append(0 if not inside else 2 if begun else 1)
                begun = inside
                rows.append([*own, *around, *(SHAPES + f for f in told)])
    if not rows or not any(tags):
        field.moves[:] = -1e3, 0, 0, 0, 0  # nothing was learned: no token is a secret
        return field
    return maximised(field, np.array(rows), np.array(starts), np.array(tags))


def _windows(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import xxhash

    for batch in batches:
        made = []
        for text in batch.column(0).to_pylist():
            text = text or ""
            chunks = [m.span() for m in re.finditer(r"\S+", text)]
            if not chunks:
                continue
            told = list(file_features(text))
            starts = [c[0] for c in chunks]
            values = []
            for m in ASSIGN.finditer(text):
                if m.end(2) - m.start(2) >= 12:
                    values.append(m.span(2))
            values += [m.span() for m in ACCESS.finditer(text)]
            # a bare number of 16 digits and more is no key
            values += [m.span() for m in HEX.finditer(text) if not m.group().isdigit()]
            taken, end = [], -1
            for a, b in sorted(set(values)):
                if a >= end:
                    taken.append((a, b))
                    end = b
            from bisect import bisect_right

            def cut(i):
                return chunks[max(0, i - REACH)][0], chunks[min(len(chunks) - 1, i + REACH)][1]

            for a, b in taken[:WINDOWS]:
                x, y = cut(bisect_right(starts, a) - 1)
                # other values would be taught as plain text
                if sum(x <= c and d <= y for c, d in taken) == 1:
                    made.append((text[x:y], a - x, b - x, told))
            i = xxhash.xxh3_64_intdigest(text[:4096].encode("utf-8", "surrogatepass")) % len(chunks)
            x, y = cut(i)
            if not any(c < y and d > x for c, d in taken):
                made.append((text[x:y], -1, -1, told))
        if made:
            a, b, c, d = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["text", "start", "end", "told"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """The pickled words, weights and moves of a field from at most ``sample_docs`` documents, chosen by a hash of the doc_id."""
    chosen = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("bigint")).alias("h"))
    total = max(1, docs.count())
    share = min(1.0, (2 * sample_docs + 100) / total)
    few = chosen.where(F.col("h") <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63)))).orderBy("h", "text").limit(sample_docs)
    windows = few.select("text").mapInArrow(_windows, "text string, start bigint, end bigint, told array<bigint>")

    def run(table):
        rows = [] if table is None else sorted(zip(*(c.to_pylist() for c in table.columns)))
        field = learned_from(rows)
        return field.words, field.weights, field.moves

    return fitted(windows, run)


# -- decoding -----------------------------------------------------------------


class Decoder:
    """Finds the spans of one text after another; what it knows of chunks is kept, within a bound."""

    KEPT = 400_000

    def __init__(self, field: Field):
        import numpy as np

        self.field = field
        self.w = field.weights
        self.begins, self.insides = self.w[:, 0].tolist(), self.w[:, 1].tolist()
        begin, b_i, i_i, b_end, i_end = field.moves
        # a secret gains no more than its first token's bound and those of all other tokens
        self.slack = np.array([begin + max(b_end, b_i), max(i_i, i_end)])
        self.codes: dict[str, int] = {}
        self.alike: dict[tuple, tuple] = {}
        self.bound = np.zeros((self.KEPT, 2))
        self.more = np.zeros(self.KEPT, dtype=np.int64)
        self.word = np.zeros(self.KEPT, dtype=np.int64)
        n = len(field.words) + 1
        self.places = [self.w[field.place + p * n : field.place + (p + 1) * n] for p in (4, 5, 6)]

    def code(self, chunk: str) -> int:
        """The number of a chunk, with its bound and its word; chunks shorter than a secret can't be hot."""
        at = self.codes[chunk] = len(self.codes)
        core = chunk.strip(_SIGNS)
        low = core.lower()
        word = self.word[at] = self.field.words.get(low or chunk, 0)
        if len(chunk) < LEAST:
            self.bound[at] = -1e9
        elif core.isalpha() and ((lower := low == core) or core.isascii() and core[1:] in (low[1:], core.upper()[1:])):
            # a plain word: all of its length and case that no known word is have the same features
            i = chunk.index(core)
            key = (len(core) if core.isascii() else len(core.encode()), lower, core[1:] == low[1:], not low.strip("abcdef"), word, chunk[:i], chunk[i + len(core) :])
            if key not in self.alike:
                self.alike[key] = self._bounds(chunk)
            self.bound[at, 0], self.bound[at, 1], self.more[at] = self.alike[key]
        else:
            self.bound[at, 0], self.bound[at, 1], self.more[at] = self._bounds(chunk)
        return at

    def _bounds(self, chunk: str) -> tuple[float, float, int]:
        """The most that a begin and an inside score by the chunk alone, and its tokens that an inside may take; the first has none before it."""
        _, rows = self.field.inner(chunk)
        begins, insides = self.begins, self.insides
        if not rows:
            return -1e9, -1e9, 0
        return max(sum(map(begins.__getitem__, r)) for r in rows), max((sum(map(insides.__getitem__, r)) for r in rows[1:]), default=-1e9), len(rows) - 1

    def spans(self, text: str) -> list[tuple[int, int]]:
        import numpy as np

        chunks = text.split()
        if not chunks:
            return []
        if len(self.codes) + len(chunks) > self.KEPT:
            self.codes.clear()
            self.alike.clear()
            if len(chunks) > self.KEPT:  # a text of very many words is gone through in parts, each with the words around it
                return self._long(text)
        get, new = self.codes.get, self.code
        codes = np.fromiter((c if (c := get(x)) is not None else new(x) for x in chunks), dtype=np.int64, count=len(chunks))
        told = self.w[[SHAPES + f for f in file_features(text)]].sum(axis=0)
        return self._decoded(text, chunks, codes, told)

    def _decoded(self, text, chunks, codes, told):
        import numpy as np

        words = np.concatenate([[0, 0], self.word[codes], [0]])
        around = self.places[0][words[1:-2]] + self.places[1][words[:-3]] + self.places[2][words[3:]]
        most = self.bound[codes] + around + told + self.slack
        hot = most[:, 0] + self.more[codes] * np.maximum(most[:, 1], 0) > 0
        if not hot.any():
            return []
        out, at, spot = [], 0, 0
        for i in np.flatnonzero(hot):
            while spot <= i:  # the place of chunk i in the text
                at = text.index(chunks[spot], at)
                here, at = at, at + len(chunks[spot])
                spot += 1
            found, rows = self.field.inner(chunks[i])
            scores = (self.w[rows].sum(axis=1) + around[i] + told).tolist()
            start = None
            for (a, b), tag in zip(found, viterbi(scores, self.field.moves)):
                if tag == 2:
                    out[-1] = (out[-1][0], here + b)
                elif tag == 1:
                    out.append((here + a, here + b))
        return [s for s in out if s[1] - s[0] >= LEAST]

    def _long(self, text):
        import numpy as np

        told = self.w[[SHAPES + f for f in file_features(text)]].sum(axis=0)
        marks = [m.span() for m in re.finditer(r"\S+", text)]
        out, part = [], self.KEPT // 2
        for i in range(0, len(marks), part):
            low, high = max(0, i - 2), min(len(marks), i + part + 1)
            piece = text[marks[low][0] : marks[high - 1][1]]
            chunks = piece.split()
            self.codes.clear()
            codes = np.fromiter((self.codes[x] if x in self.codes else self.code(x) for x in chunks), dtype=np.int64, count=len(chunks))
            first, last = marks[i][0], marks[min(len(marks), i + part) - 1][1]
            out += [(a + marks[low][0], b + marks[low][0]) for a, b in self._decoded(piece, chunks, codes, told) if first <= a + marks[low][0] < last]
        return out


def _found(model):
    def run(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        decoder = Decoder(Field(*pickle.loads(model.value)))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = [(a, KINDS[3], b) for a, b in decoder.spans(text) if not any(x < b and y > a for x, _, y in base)]
                rows.append([{"kind": k, "start": a, "end": b} for a, k, b in sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, training: DataFrame | None = None) -> DataFrame:
    """The secrets of every row of ``docs`` (doc_id, text): doc_id, spans (kind, start, end in code points).

    Kinds ``assign``, ``access`` and ``hex`` are the patterns' matches; ``field`` are
    spans of at least 8 characters that the field finds apart from those.  Spans go by
    start, then by kind in that order.  Null, empty and blank texts have none; texts are
    read whole; repeated rows are searched alike, rows without a doc_id too.  A sample
    without any value of the patterns teaches nothing, and the patterns' spans stay alone.
    Other columns are ignored, an empty table gives no rows.  ``training`` holds the texts
    to learn from if they aren't in ``docs``.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if training is None else training, sample_docs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found(model), f"doc_id bigint, spans array<{SPAN}>")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digested(found: DataFrame) -> DataFrame:
    """``secret_spans`` as counts by kind, a digest of the patterns' spans and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
