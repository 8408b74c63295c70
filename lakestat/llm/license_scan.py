"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes its lower-cased words. The rules of which a gate's words all occur are tried, strongest first; a detection
that lies within a kept one is suppressed. One pass over the documents, no shuffle.

Nulls and empty texts have no words, no labels and score 0. Texts are read whole. Repeated rows give repeated results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns
from .license_rules import Rule, all_rules

#: Phrases whose places are counted, with the label that each gives.
BASE = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}

_WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

DETECTIONS = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in (("label", T.StringType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("priority", T.LongType()))])
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of other than ASCII characters, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split() if text else []


def places(padded: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase starts; words of ``padded`` have a space on each side."""
    found, at, seen, word = [], padded.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += padded.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = padded.find(b" " + phrase + b" ", at + 1)
    return found


def detect(padded: bytes, rules: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Detections as (start, end, rule) by start, without those that lie within one that ranks higher.

    ``rules`` are ordered by rank. A Fenwick tree over the starts holds the furthest end of what is kept.
    """
    found = [(*m.span(), rule) for rule in rules for m in rule.pattern.finditer(padded)]
    starts = sorted({s for s, _, _ in found})
    furthest = [0] * (len(starts) + 1)
    kept = []
    for s, e, rule in found:
        i = k = bisect_left(starts, s) + 1
        reach = 0
        while k:
            reach = max(reach, furthest[k])
            k &= k - 1
        if reach >= e:
            continue
        kept.append((s, e, rule))
        while i < len(furthest):
            furthest[i] = max(furthest[i], e)
            i += i & -i
    return sorted(kept, key=lambda d: d[:2])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    n_base counts the places of BASE's phrases; first_word and last_word are the smallest and largest of their starts,
    null without any. labels has base_labels and those of the detections, distinct, sorted, comma-joined. score is the
    priority of the strongest detection over 100. detections: an array of label, words (from 0, inclusive) and priority.
    """
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("detections", DETECTIONS),
    ]

    def make():
        rules = all_rules()
        by_gate = defaultdict(list)
        for k, r in enumerate(rules):
            for gate in r.gates:
                by_gate[min(gate, key=lambda g: (-len(g), g))].append((k, gate))
        gates = frozenset(g for r in rules for gate in r.gates for g in gate)

        def one(text):
            words = words_of(text)
            seen = gates.intersection(words)
            tried = sorted({k for g in seen if g in by_gate for k, gate in by_gate[g] if gate <= seen})
            if not tried:  # each base phrase has a rule of its own
                return len(words), 0, None, None, "", "", 0.0, []
            padded = b" " + b" ".join(words) + b" "
            at = {p: places(padded, p) for p in BASE}
            starts = [x for found in at.values() for x in found]
            base = {BASE[p] for p, found in at.items() if found}
            found, count, seen_to = [], 0, 0
            for s, e, rule in detect(padded, [rules[k] for k in tried]):
                count += padded.count(b" ", seen_to, s)
                seen_to = s
                found.append((rule.label, count - 1, count - 1 + padded.count(b" ", s, e), rule.priority))
            score = max([0.0, *(f[3] / 100 for f in found), *([0.6] if base else [])])
            labels = base | {f[0] for f in found}
            rows = [{"label": a, "first_word": b, "last_word": c, "priority": d} for a, b, c, d in found]
            return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, rows

        return lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)]

    return append_columns(docs, text_col, fields, make, raw=True)
