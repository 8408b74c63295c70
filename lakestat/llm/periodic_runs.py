"""Periodic runs of words: a harmonic grid over every text, extended by longest common extensions.

A run of period p that is at least twice as long holds two neighbouring places jp and (j+1)p of the grid of p. For every
period and every such pair, the longest common extension forward (from the suffix array of the text) and backward (from
that of the reversed text) gives the whole run; extensions are range minima over common prefixes of neighbouring
suffixes. The grids of all periods have n * log(n) places. Texts of a slice are laid end to end, each with words of its
own, so that one suffix array serves them all and no extension leaves its text. There is no shuffle; a text is worked on
whole by one task, in memory that is linear in its words (times the logarithm of its longest repeat while suffixes are
sorted).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, pieces, private, tidy

#: A run is at least so many words and so many periods long.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words in a block of the structure for range minima.
BLOCK = 32
RUN = "struct<start: bigint, length: bigint, period: bigint>"
FOUND = f"struct<n_words: bigint, runs: array<{RUN}>, best: {RUN}, collapsed: string>"


class Minima:
    """Range minima: prefix and suffix minima within blocks, and a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray) -> None:
        n_blocks = -(-max(1, len(values)) // BLOCK)
        top = np.iinfo(values.dtype).max
        self.grid = np.full((n_blocks, BLOCK), top, dtype=values.dtype)
        self.grid.reshape(-1)[: len(values)] = values
        self.up_to = np.minimum.accumulate(self.grid, axis=1).reshape(-1)
        self.from_on = np.minimum.accumulate(self.grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [self.grid.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= n_blocks:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value of each range, both ends included."""
        a, b = first // BLOCK, last // BLOCK
        out = np.minimum(self.from_on[first], self.up_to[last])
        within = np.flatnonzero(a == b)
        for s in range(0, len(within), 1 << 14):
            k = within[s : s + (1 << 14)]
            at = np.arange(BLOCK)
            inside = (at >= (first[k] % BLOCK)[:, None]) & (at <= (last[k] % BLOCK)[:, None])
            out[k] = np.where(inside, self.grid[a[k]], np.iinfo(self.grid.dtype).max).min(axis=1)
        between = np.flatnonzero(b - a > 1)
        width = b[between] - a[between] - 1
        level = np.frexp(width)[1] - 1  # floor of the binary logarithm
        for k in np.unique(level):
            of = between[level == k]
            table = self.levels[k]
            out[of] = np.minimum(out[of], np.minimum(table[a[of] + 1], table[b[of] - (1 << k)]))
        return out


class Suffixes:
    """Suffix array, ranks and common prefixes of neighbours of one array of words; answers common extensions."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        order = np.argsort(words, kind="stable").astype(np.int32)
        by = words[order]
        first = np.r_[True, by[1:] != by[:-1]]
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, step = [rank], 1
        # Doubling; only suffixes that are not told apart yet are sorted again.
        while len(open_at := np.flatnonzero(~first | ~np.r_[first[1:], True])):
            members = order[open_at]
            ahead = members.astype(np.int64) + step
            beyond = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
            key = rank[members].astype(np.int64) * (n + 1) + beyond + 1
            by_key = np.argsort(key, kind="stable")
            members, key = members[by_key], key[by_key]
            order[open_at] = members
            first[open_at] = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[members] = np.maximum.accumulate(np.where(first[open_at], open_at, 0))
            levels.append(rank)
            step *= 2
        self.n, self.rank = n, rank
        # Equal ranks of level k mean 2^k equal words: neighbours' common prefixes by descent over the levels.
        common = np.zeros(max(0, n - 1), dtype=np.int32)
        pairs = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
        a, b = order[pairs].astype(np.int64), order[pairs + 1].astype(np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < n
            same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
            common[pairs] += same.astype(np.int32) << k
            a, b = a + (same.astype(np.int64) << k), b + (same.astype(np.int64) << k)
        self.minima = Minima(common)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on (i < j) are equal; none past the end."""
        out = np.zeros(len(i), dtype=np.int64)
        inside = np.flatnonzero(j < self.n)
        x, y = self.rank[i[inside]].astype(np.int64), self.rank[j[inside]].astype(np.int64)
        out[inside] = self.minima.least(np.minimum(x, y), np.maximum(x, y) - 1)
        return out


def grid_pairs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(period, places i) of neighbouring places i, i + period of the period's grid that hold the same word.

    Texts come by ascending size; a period is looked for only in texts that can hold a run of it. Where the words at
    two places differ, the forward extension is 0 and no run holds both.
    """
    most = int(sizes[-1]) // LEAST_PERIODS if len(sizes) else 0
    fits = starts[np.searchsorted(sizes, LEAST_PERIODS * np.arange(1, most + 1))] if most else []
    for p, at in enumerate(fits, 1):
        base = -(-int(at) // p) * p
        on_grid = words[base::p]
        hits = np.flatnonzero(on_grid[1:] == on_grid[:-1])
        if len(hits):
            yield p, base + hits * p


def runs_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in the texts laid end to end, by start, then period."""
    found = list(grid_pairs(words, starts, sizes))
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    i = np.concatenate([places for _, places in found])
    p = np.concatenate([np.full(len(places), period) for period, places in found])
    n = len(words)
    forward = Suffixes(words).extension(i, i + p)
    # Backward: the words before i + p and before i, read from there in the reversed array.
    backward = Suffixes(words[::-1]).extension(n - i - p, n - i)
    start, length = i - backward, p + forward + backward
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
    rows = np.unique(np.stack([start, length, p], axis=1)[long], axis=0)
    # A multiple of the smallest period gives the same stretch.
    smallest = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)] if len(rows) else []
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeated_tail(n: int, seed: int) -> np.ndarray:
    """Which word stands at each of n places when, from place seed % n on, the first words from there are repeated."""
    a = seed % n
    period = 1 + (n - a) // (3 + seed % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % period, at)


def analyse(texts: list[bytes | None], seeds: list[int | None]) -> tuple[list, list, list, list]:
    """n_words, runs, best run and collapsed text of each text."""
    split = [(t or b"").split() for t in texts]  # at blanks, tabs, line and page breaks
    for k, seed in enumerate(seeds):
        if seed is not None and split[k]:
            split[k] = [split[k][i] for i in repeated_tail(len(split[k]), seed)]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    codes = pa.array([w for k in order for w in split[k]], pa.binary()).dictionary_encode()
    text_of = np.repeat(np.arange(len(order)), sizes[order])
    words = text_of * max(1, len(codes.dictionary)) + np.asarray(codes.indices, dtype=np.int64)
    rows = runs_of(words, starts, sizes[order]) if len(words) else np.zeros((0, 3), dtype=np.int64)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    cuts = np.searchsorted(rows[:, 0], np.r_[starts, len(words)])
    runs, best, collapsed = [None] * len(texts), [None] * len(texts), [None] * len(texts)
    for at, k in enumerate(order):
        own = rows[cuts[at] : cuts[at + 1]] - [starts[at], 0, 0] if cuts[at] < cuts[at + 1] else rows[:0]
        runs[k] = [dict(zip(("start", "length", "period"), r)) for r in own.tolist()]
        if runs[k]:
            best[k] = max(runs[k], key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]))
            stay = np.flatnonzero(kept[starts[at] : ends[at]])
            collapsed[k] = b" ".join([split[k][i] for i in stay.tolist()])
        else:
            collapsed[k] = b" ".join(split[k])
    return sizes.tolist(), runs, best, collapsed


def find(df: DataFrame, text_col: str = "text", seed: Column | None = None) -> DataFrame:
    """``df`` with n_words, runs, best and collapsed of every whole text; columns of these names are replaced.

    Words are what stands between blanks, tabs, line and page breaks. runs: every stretch (start, length, period) of at
    least LEAST_WORDS words and LEAST_PERIODS of its smallest period that no neighbouring word extends, by start, then
    period; best: the one of most periods (of equal ones the first start, then the smallest period), null without runs;
    collapsed: the words, joined by blanks, without those that a run holds after its first period. Where ``seed`` is
    not null, the text's end is replaced first as ``repeated_tail`` says. Null and empty texts have no words, no
    runs, and an empty collapsed text; each row is worked on by itself, repeated ids or not.
    """
    modest_batches(df.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    types = {"n_words": pa.int64(), "runs": pa.list_(kind), "best": kind, "collapsed": pa.binary()}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, seeds in batches:
            parts, at = [], 0
            for part in pieces(texts):
                found = analyse(part.to_pylist(), seeds.slice(at, len(part)).to_pylist())
                at += len(part)
                arrays = [pa.array(x, t) for x, t in zip(found, types.values(), strict=True)]
                arrays[-1] = arrays[-1].cast(pa.string())
                parts.append(pa.StructArray.from_arrays(arrays, names=list(types)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list((types | {"collapsed": pa.string()}).items())))
        tidy()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    found = private(df, "_found")
    own = F.arrow_udf(run, FOUND).asNondeterministic()(df[text_col].cast("binary"), (F.lit(None) if seed is None else seed).cast("bigint"))
    kept = [df[c] for c in df.columns if c.lower() not in types]
    return df.withColumn(found, own).select(*kept, *[F.col(f"{found}.{c}").alias(c) for c in types])


def digests(found: DataFrame) -> list[Column]:
    """n_runs, the best run's numbers, and digests of the runs and of the collapsed text, of what ``find`` returns."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return [
        F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ]
