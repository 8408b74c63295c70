"""Personal data: fixed patterns and a skip-chain conditional random field.

Words that hold a digit or an at sign are the field's variables; their labels are O, the patterns' kinds, and secret.
Potentials join neighbouring words and, as skip edges, all occurrences of repeated or similar words however far apart.
Loopy message passing then makes the labels of a document consistent: what no pattern decides (a number written without
its plus, a token named again without its key, a number that a pattern missed because another follows it) takes the
label of its certain twins or neighbours.

The field is trained piecewise on weak labels: those of the patterns, and of the same words with what decided the
pattern masked, which count for their label and for O alike. Counts of feature sets and of label pairs from all
documents are gathered by Spark; their number has a fixed bound and the driver fits the weights. The trained field is
broadcast; finding is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, found_in, slices, tidy

KINDS = ("email", "ip", "card", "phone")
#: What the field finds, in the order of results.
FOUND = (*KINDS, "secret")
LABELS = ("O", *FOUND)
#: A word that no pattern covers is reported if the probability of its label reaches this.
CERTAIN = 0.9
#: The least probability of the parts beside it that belong to it.
LIKELY = 0.6
#: Prior counts of each pair of equal labels on skip edges; repeated words seldom disagree.
AGREEING = 50.0
#: What a pattern's label adds to the log-potential of the words that it covers.
OBSERVED = 8.0
#: Messages are passed until none changes by more than this, or oscillating ones for so many rounds.
SETTLED, MOST_ROUNDS = 1e-4, 1000
DAMPING = 0.3

_GATE = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "()[]{}<>,;:!?.\"'#*$%&|"
_SECRET = re.compile(r"""(?:token|secret|passw(?:or)?d|pwd|(?:api|access|auth)[_-]?key)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9_+/=.-]{16,})""", re.I)
_MIXED = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_HEX = re.compile(r"[0-9A-Fa-f]{16,}")

#: Yes-or-no features of a word, each a bit.
FEATURES = (
    "bias", "at", "at_dotted", "quad", "quad_valid", "plus", "digits_1_3", "digits_4_6", "digits_7_8", "digits_9_12", "digits_13_19", "digits_20",
    "luhn", "letters", "separators", "after_plus", "beside_digits", "mixed_16", "hex_16", "named",
)
#: The features that decide a kind: words of such a span that lack them, and all with them masked, are weak examples.
DECIDING = {kind: sum(1 << FEATURES.index(f) for f in names) for kind, names in {"card": ["luhn"], "phone": ["plus", "after_plus"], "secret": ["named"]}.items()}


#: Words with one of these are mentions of their own; neighbours without are parts that may belong together.
WHOLE = sum(1 << FEATURES.index(f) for f in ("at", "quad", "digits_13_19", "digits_20", "mixed_16"))


#: What the word of a card has that the patterns would find alone.
_SOUND = sum(1 << FEATURES.index(f) for f in ("digits_13_19", "luhn"))


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; looks back from each domain, so that long words take linear time."""
    found, over = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            over = m.end()
            found.append((start, over))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of every match of the patterns, by kind and start."""
    if not _GATE.search(text):
        return []
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split("."))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of values that are called a token, key or password."""
    return [(len(KINDS), *m.span(1)) for m in _SECRET.finditer(text) if _DIGIT.search(m.group(1))]


def number_keys(words: list[tuple[int, int, str]]) -> dict[int, str]:
    """Keys of words that are parts of numbers: the last digits of the whole run of words, and how many follow the word.

    So a number has the same keys however it is grouped. A new run starts with a plus, and after punctuation.
    """
    runs: list[list[int]] = []
    for k, (s, _, w) in enumerate(words):
        if "@" in w or not _DIGIT.search(w) or any(c.isalpha() for c in w):
            continue
        if runs and runs[-1][-1] == k - 1 and words[k - 1][1] + 1 == s and words[k - 1][2][-1] not in ",;:!?." and w[0] != "+":
            runs[-1].append(k)
        else:
            runs.append([k])
    keys = {}
    for run in runs:
        digits = [_NOT_DIGIT.sub("", words[k][2]) for k in run]
        whole = "".join(digits)
        name = whole[-7:] if len(whole) >= 7 else " ".join(words[k][2].strip(_EDGE) for k in run)
        after = len(whole)
        for k, d in zip(run, digits, strict=True):
            after -= len(d)
            keys[k] = f"{name}/{after}"
    return keys


def nodes_of(text: str) -> list[tuple[int, int, int, str, int]]:
    """Variables of a text: (start, end, feature bits, key for skip edges, number of the word)."""
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    held = [bool(_GATE.search(w)) for _, _, w in words]
    nodes, numbers = [], number_keys(words)
    named, at = secrets(text), 0
    for k, (s, e, w) in enumerate(words):
        if not held[k]:
            continue
        digits, bare = _NOT_DIGIT.sub("", w), w.strip(_EDGE)
        n, parts = len(digits), bare.split(".")
        while at < len(named) and named[at][2] <= s:
            at += 1
        quad = len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts)
        flags = (
            True, "@" in w, "@" in w and "." in w.rpartition("@")[2].rstrip("."), quad, quad and all(len(p) < 4 and int(p) < 256 for p in parts), "+" in w,
            1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n >= 20,
            13 <= n <= 19 and luhn(digits), any(c.isalpha() for c in w), "-" in w or "(" in w, k > 0 and held[k - 1] and "+" in words[k - 1][2],
            (k > 0 and held[k - 1]) or (k + 1 < len(words) and held[k + 1]),
            bool(_MIXED.fullmatch(bare)) and n < len(bare), bool(_HEX.fullmatch(bare)) and n < len(bare), at < len(named) and named[at][1] < e,
        )
        local = w.partition("@")[0].lower() if "@" in w else ""
        key = numbers[k] if k in numbers else local if len(local) >= 3 else f"{digits[-7:]}/0" if n >= 7 and n == len(bare) else bare.lower()
        nodes.append((s, e, sum(1 << i for i, f in enumerate(flags) if f), key, k))
    return nodes


def edges_of(nodes: list[tuple[int, int, int, str, int]]) -> list[tuple[int, int, int]]:
    """(first, second, 0 for neighbours or 1 for skip edges): as many as nodes at most, of each sort."""
    edges, last = [], {}
    for i, (_, _, _, key, k) in enumerate(nodes):
        beside = i > 0 and nodes[i - 1][4] == k - 1 and not (nodes[i - 1][2] | nodes[i][2]) & WHOLE
        if beside:
            edges.append((i - 1, i, 0))
        if key:
            if key in last and not (beside and last[key] == i - 1):
                edges.append((last[key], i, 1))
            last[key] = i
    return edges


def graph_of(nodes: list[tuple[int, int, int, str, int]]) -> tuple[list[tuple[int, int, int]], int]:
    """Edges as of ``edges_of``, but keys that occur more than twice join through a node of their own, after ``nodes``.

    So evidence is two steps away wherever it is in a text. Also how many such nodes there are.
    """
    places: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        if n[3]:
            places.setdefault(n[3], []).append(i)
    hubs = {key: len(nodes) + h for h, key in enumerate(k for k, at in places.items() if len(at) > 2)}
    edges = [x for x in edges_of(nodes) if x[2] == 0 or nodes[x[1]][3] not in hubs]
    return edges + [(i, hub, 1) for key, hub in hubs.items() for i in places[key]], len(hubs)


def pattern_labels(nodes, spans) -> list[int]:
    """The label of each node: that of the first span that it overlaps, else O."""
    labels, ordered = [0] * len(nodes), sorted((s, e, kind) for kind, s, e in spans)
    i = 0
    for s, e, kind in ordered:
        while i and nodes[i - 1][1] > s:
            i -= 1
        while i < len(nodes) and nodes[i][1] <= s:
            i += 1
        k = i
        while k < len(nodes) and nodes[k][0] < e:
            labels[k] = labels[k] or kind + 1
            k += 1
    return labels


def cut_out(text: str, nodes, spans) -> list[tuple[int, int, int]]:
    """Words inside runs of digits that fail as a whole, which by themselves the patterns call a card: weak examples."""
    free = [n for n, label in zip(nodes, pattern_labels(nodes, spans), strict=True) if not label and n[2] & _SOUND == _SOUND]
    return [(2, s, e) for s, e, *_ in free if (m := _CARD.fullmatch(text[s:e].strip(_EDGE))) and luhn(_NOT_DIGIT.sub("", m.group()))]


def _bits(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)


def train(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and log-potentials (neighbour and skip edges x labels x labels).

    Piecewise: a softmax regression of labels on features, and for each sort of edge the smoothed log-ratio of label
    pairs to equal ones. Examples are what the patterns find, and the cards that they would find but for the digits
    beside them (``cut_out``). Feature sets number at most 2 ** len(FEATURES), whatever the documents; few of them occur.
    """

    def count(batches):
        for batch in batches:
            seen = Counter()
            for text in (t for part in slices(batch, 0) for t in part.column(0).to_pylist()):
                if text and _GATE.search(text):
                    nodes = nodes_of(text)
                    spans = base_spans(text) + secrets(text)
                    labels = pattern_labels(nodes, spans + cut_out(text, nodes, spans))
                    masks = [DECIDING.get(LABELS[y], 0) for y in labels]
                    seen.update((2, n[2], y) for n, y, mask in zip(nodes, labels, masks, strict=True) if not mask or mask & n[2])
                    seen.update((3, n[2] & ~mask, y) for n, y, mask in zip(nodes, labels, masks, strict=True) if mask)
                    seen.update((sort, labels[i], labels[j]) for i, j, sort in edges_of(nodes))
            if seen:
                keys = np.array(list(seen))
                yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(3)), pa.array(list(seen.values()), pa.int64())], names=["what", "a", "b", "n"])
        tidy()

    rows = docs.select(text_col).mapInArrow(count, "what long, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).orderBy("what", "a", "b").collect()
    pairs, seen = np.full((2, len(LABELS), len(LABELS)), 0.5), {}
    pairs[1] += AGREEING * np.eye(len(LABELS))
    for r in rows:
        if r.what < 2:
            pairs[r.what, r.a, r.b] += r.n
            pairs[r.what, r.b, r.a] += r.n
        else:
            for y in {r.b, 0} if r.what == 3 else {r.b}:
                seen[r.a, y] = seen.get((r.a, y), 0) + r.n
    # How much rarer two labels meet than they meet themselves: how frequent labels are is left to the words' own weights.
    agree = np.sqrt(pairs.diagonal(axis1=1, axis2=2))
    edges = np.minimum(np.log(pairs / (agree[:, :, None] * agree[:, None, :])), 0.0)
    weights = np.zeros((len(FEATURES), len(LABELS)))
    weights[0, 0] = 5.0
    if seen:
        codes = sorted({a for a, _ in seen})
        x, y = _bits(np.array(codes)), np.array([[seen.get((a, label), 0) for label in range(len(LABELS))] for a in codes], dtype=float)
        # Frequent feature sets count by the root of their number, so that rare ones are fitted too.
        y /= np.sqrt(y.sum(axis=1, keepdims=True))
        y /= y.sum()
        step, rate = np.zeros_like(weights), 1.0
        for _ in range(1500):
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p *= (y.sum(axis=1) / p.sum(axis=1))[:, None]
            step = 0.9 * step + rate * (x.T @ (y - p) - 1e-5 * weights)
            weights = weights + step
    return weights, edges


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy sum-product over all documents of a batch, which share no edge."""
    belief = unary
    if len(edges):
        i, j = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        m, table = len(edges), potentials[np.r_[edges[:, 2], edges[:, 2]]]
        table[m:] = table[m:].transpose(0, 2, 1)
        back = np.r_[np.arange(m) + m, np.arange(m)]
        sent, belief, now = np.zeros((2 * m, unary.shape[1])), unary.copy(), np.arange(2 * m)
        for _ in range(MOST_ROUNDS):
            out = (belief[i[now]] - sent[back[now]])[:, :, None] + table[now]
            top = out.max(axis=1, keepdims=True)
            out = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            out -= out.max(axis=1, keepdims=True)
            step = (1 - DAMPING) * (out - sent[now])
            sent[now] += step
            np.add.at(belief, j[now], step)
            moving = np.zeros(2 * m, dtype=bool)
            moving[now] = np.abs(step).max(axis=1) > SETTLED
            if not moving.any():
                break
            moved = np.zeros(len(unary), dtype=bool)
            moved[j[moving]] = True
            now = np.flatnonzero(moving | moved[i])
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, nodes, probable: np.ndarray, spans) -> list[tuple[int, int, int]]:
    """Spans that the field adds: runs of neighbouring parts with one probable label, certain for one of them at least.

    No span touches one of a pattern.
    """
    best, covered = probable.argmax(axis=1), pattern_labels(nodes, spans)
    runs: list[list] = []
    for k, (s, e, code, _, word) in enumerate(nodes):
        y = int(best[k])
        if not y or covered[k] or probable[k, y] < LIKELY:
            continue
        sure = bool(probable[k, y] >= CERTAIN)
        if runs and runs[-1][0] == y - 1 and runs[-1][3] == word - 1 and not (code | runs[-1][4]) & WHOLE:
            runs[-1][2:] = [e, word, code, sure or runs[-1][5]]
        else:
            runs.append([y - 1, s, e, word, code, sure])
    runs = [r[:4] for r in runs if r[5]]
    found, named, at = [], secrets(text) if any(r[0] == len(KINDS) for r in runs) else [], 0
    for kind, s, e, _ in runs:
        while at < len(named) and named[at][2] <= s:
            at += 1
        if kind == len(KINDS) and at < len(named) and named[at][1] < e:
            found.append(named[at])
            continue
        cut = text[s:e]
        lead = len(cut) - len(cut.lstrip(_EDGE))
        tail = len(cut) - len(cut.rstrip(_EDGE))
        if s + lead < e - tail:
            found.append((kind, s + lead, e - tail))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{FOUND[k]}:{s}:{e}" for k, s, e in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{FOUND[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _finder(model: tuple[np.ndarray, np.ndarray]):
    """A function that makes, in each task, the function from texts to the patterns' spans and those that the field adds."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def make():
        weights, potentials = shared.value

        def work(texts):
            base = [base_spans(t) if t else [] for t in texts]
            nodes = [nodes_of(t) if t and _GATE.search(t) else [] for t in texts]
            graphs = [graph_of(ns) for ns in nodes]
            start = np.cumsum([0, *(len(ns) + hubs for ns, (_, hubs) in zip(nodes, graphs, strict=True))])
            extra: list[list] = [[] for _ in texts]
            if start[-1]:
                codes = np.array([c for ns, (_, hubs) in zip(nodes, graphs, strict=True) for c in [*(n[2] for n in ns), *[0] * hubs]])
                edges = np.array([(i + a, j + a, sort) for a, (own, _) in zip(start.tolist(), graphs, strict=False) for i, j, sort in own], dtype=np.int64).reshape(-1, 3)
                own = _bits(codes) @ weights
                for k, ns in enumerate(nodes):
                    if ns:
                        known = np.array(pattern_labels(ns, base[k]))
                        at = np.flatnonzero(known)
                        own[start[k] + at, known[at]] += OBSERVED
                probable = marginals(own, edges, potentials)
                for k, ns in enumerate(nodes):
                    if ns:
                        extra[k] = added_spans(texts[k], ns, probable[start[k] : start[k] + len(ns)], base[k])
            return base, extra

        return work

    return make


def redaction(text: Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """A struct whose ``redacted`` is the text with each span replaced by its kind; null if there are none."""
    make = _finder(model)

    def replacing():
        spans_of = make()

        def work(texts):
            base, extra = spans_of(texts)
            return [[redacted(t, b + x) if b or x else None for t, b, x in zip(texts, base, extra, strict=True)]]

        return work

    return found_in(text, [T.StructField("redacted", T.StringType())], replacing)


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans.

    The first four and base_sha256 are those of the patterns. spans has these and what the field adds, as
    kind:start:end in code points, end exclusive, by kind (email, ip, card, phone, secret) and start; n_spans counts
    them. Null and empty texts have none. Repeated rows give repeated results; texts are read whole. Columns of ``docs``
    with these names are replaced.
    """
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]
    make = _finder(model)

    def listing():
        spans_of = make()

        def work(texts):
            base, extra = spans_of(texts)
            counts = [[sum(1 for s in b if s[0] == k) for b in base] for k in range(len(KINDS))]
            both = [b + x for b, x in zip(base, extra, strict=True)]
            return [*counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(b) for b in both], [len(b) for b in both]]

        return work

    return append_columns(docs, text_col, fields, listing)
