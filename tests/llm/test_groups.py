"""Operators on pairs and on the whole corpus, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakestat.llm import components, embedding_dedup, minhash, mixing, quality_classifier
from tests.llm.conftest import words

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(500, 500 + k) for k in range(1, 60)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    want = roots_of({n for x in links for n in x}, links)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {n: want[n] for x in links if x[0] != x[1] for n in x}
    assert components.components(df.limit(0)).count() == 0


def sets_of(texts):
    out = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        out[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    return out


def brute_groups(texts):
    s = sets_of(texts)
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    return s, roots_of(s, links)


def check_groups(df):
    rows = minhash.deduplicate(df).collect()
    assert len(rows) == df.count()
    s, want = brute_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.doc_id is not None])
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash(docs):
    check_groups(docs)


def test_minhash_large_near_group(spark, monkeypatch):
    """Long lists, a chain of small edits, and tiles of few rows."""
    monkeypatch.setattr(minhash, "SHORT_LIST", 3)
    monkeypatch.setattr(minhash, "TILE_ROWS", 7)
    r, w, rows = random.Random(5), words(120, 77).split(), []
    for k in range(70):
        v = list(w)
        for _ in range(r.randrange(9)):
            v[r.randrange(len(v))] = f"e{r.randrange(10**6)}"
        rows.append((k, " ".join(v)))
    chain = words(100, 78).split()
    for k in range(20):
        chain[4 * k] = f"c{k}"
        rows.append((200 + k, " ".join(chain)))
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"))


def test_minhash_repeated_ids(spark):
    """Rows that repeat an id are each linked by their own text; rows without id are nobody's representative."""
    a, b, c = words(120, 1), words(120, 2), words(120, 3)
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (9, near(c)), (None, words(50, 4)), (4, a), (None, None), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit("clash")).withColumn("row", F.lit(1))
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.deduplicate(df).collect()))
    assert got == sorted([(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (0, 9, False), (9, 9, True), (0, 0, True), (4, 1, False), (0, 0, True)])
    kept = minhash.distinct(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (9, near(c)), (0, words(50, 4)), (0, "")])


def test_minhash_empty(empty):
    assert minhash.deduplicate(empty).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "PART", 16)
    g = np.random.default_rng(2)
    x = g.normal(size=(120, 24))
    near = x[:20] + g.normal(size=(20, 24)) * 0.12
    hub = x[0] + g.normal(size=(40, 24)) * 0.05
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, near, hub]).astype(np.float32))]
    rows += [(300 + k, rows[3][1]) for k in range(5)] + [(310, (2 * np.array(rows[4][1])).tolist())]
    odd = [(400, None), (401, []), (402, [0.0] * 24), (403, [float("nan")] + [1.0] * 23), (404, [float("inf")] + [1.0] * 23), (405, [None] + [1.0] * 23), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [3.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).withColumn("label", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    ids = [k for k, _ in rows]
    u = np.array([v for _, v in rows], dtype=np.float64)
    c = (u @ u.T) / np.sqrt((u * u).sum(1)[:, None] * (u * u).sum(1)[None, :])
    linked = (c >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = roots_of(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(linked), strict=True)])
    for i, k in enumerate(ids):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (linked[i].sum(), want[k], want[k] == k)
    for k, _ in odd:
        assert (got[k].n_links, got[k].component_id) == ((1, 406) if k in (406, 407) else (0, k))
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_embeddings_repeated_ids(spark):
    """An id with two vectors has two rows, each with its own links."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (None, [0.01, 1.0]), (4, [0.0, -1.0]), (4, [0.0, -1.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 2, 1, False), (0, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)])


def test_embedding_blocks_have_room():
    """Blocks of the most cells stay apart and within 64 bits."""
    g = np.random.default_rng(3)
    x = embedding_dedup.unit(g.normal(size=(4000, 16)))
    cells = embedding_dedup.Cells(x, 10.0**6)
    place = cells.place(x @ cells.turn[:, : embedding_dedup.AXES])
    assert len(set(place.tolist())) == 1 << embedding_dedup.DEPTH and max(place) << 32 < 1 << 62


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Words wanted of each (source, size): shares by weight, capped, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[k % 3] for k, (s, _) in enumerate(order)}
    left, free, want = sum(n for _, n in order), dict(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * free[s] + 1e-9]
        if not over:
            return want | {s: left * weight[s] / total for s in free}
        for s in over:
            want[s] = most * free[s]
        left -= sum(want[s] for s in over)
        free = {s: n for s, n in free.items() if s not in over}
    return want


@pytest.mark.parametrize("sizes", [[("b", 100), (None, 1000), ("a", 10), ("c", 50)], [("a", 0)], [("a", 7), ("z", 0)], [(f"s{k:03}", 1 + k * k % 97) for k in range(150)] + [("é", 4000), (None, 3)]])
def test_targets(spark, sizes):
    df = spark.createDataFrame(sizes, "source string, source_size long").withColumn("source_key", mixing.source_key(F.col("source")))
    got = {r.source_key: r.target for r in mixing.targets(df.drop("source")).collect()}
    for s, want in brute_targets(sizes).items():
        assert got["1" if s is None else "0" + s] == pytest.approx(want, rel=1e-9)


def test_targets_without_sources(spark):
    assert mixing.targets(spark.createDataFrame([], "source_key string, source_size long")).count() == 0


def brute_dual(sizes, target, most=3):
    """The multiplier of x = size / mean for which rates min(most, exp(dual * x)) reach the target, by bisection."""
    mean = sum(sizes) / len(sizes)
    low, high = -200.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        if sum(n * min(most, math.exp(min(mid * n / mean, 50))) for n in sizes) < target:
            low = mid
        else:
            high = mid
    return low


def test_duals(spark):
    r = random.Random(2)
    sizes = {k: [r.randrange(1, 900) for _ in range(80)] for k in "abcd"}
    share = {"a": 0.2, "b": 1.0, "c": 2.5, "d": 0.001}
    classes = spark.createDataFrame([(k, n, c) for k, v in sizes.items() for n, c in Counter(v).items()], "source_key string, size long, n long")
    sources = spark.createDataFrame([(k, sum(v), share[k] * sum(v)) for k, v in sizes.items()], "source_key string, source_size long, target double")
    for row in mixing.duals(classes, sources).collect():
        own = sizes[row.source_key]
        assert row.dual == pytest.approx(brute_dual(own, share[row.source_key] * sum(own)), rel=1e-5, abs=1e-6)
        assert sum(n * min(3, math.exp(row.dual * n / row["mean"])) for n in own) == pytest.approx(share[row.source_key] * sum(own), rel=1e-8)


def test_mixing(docs, spark, empty):
    r = random.Random(8)
    many = spark.createDataFrame([(1000 + k, words(r.randrange(1, 60), k), f"s{r.choice('0001234')}") for k in range(700)], "doc_id long, text string, source string")
    equal = spark.createDataFrame([(5000, words(40, 3), "s0")] * 300 + [(6000 + k, words(31, 3), "s1") for k in range(300)], "doc_id long, text string, source string")
    df = docs.select("doc_id", "text", "source").unionByName(many).unionByName(equal).withColumn("copies", F.lit("clash")).withColumn("_mix", F.lit(1))
    rows = [tuple(x) for x in mixing.mix(df).collect()]
    again = [tuple(x) for x in mixing.mix(df.repartition(5)).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(rows, key=key) == sorted(again, key=key) and len(rows) == df.count()
    size, sizes = Counter(), defaultdict(list)
    for x in df.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
        size[x.source] += n
        sizes[x.source].append(n)
    want, taken = brute_targets(list(size.items())), defaultdict(int)
    by_size = {(n, round(want[s], 3)): s for s, n in size.items()}
    rates = defaultdict(list)
    for _, n, source_size, target, copies, took in rows:
        s = by_size[source_size, round(target, 3)]
        assert took == copies * n and 0 <= copies <= 3
        taken[s] += took
        rates[s, n].append(copies)
    for s, n in size.items():
        # A document that is most of its source is taken whole or not at all.
        assert abs(taken[s] - want[s]) <= min(m for m in sizes[s] if m) + 1e-6 or (max(sizes[s]) > size[s] / 2 and taken[s] == max(sizes[s]))
    for (s, n), copies in rates.items():  # documents of one class differ by one copy at most, and large classes keep to their rate
        assert max(copies) - min(copies) <= 1
        if n and len(copies) >= 300 and want[s] < 3 * size[s]:
            own = [m for m in sizes[s] if m]
            rate = min(3, math.exp(brute_dual(own, want[s]) * n / (sum(own) / len(own))))
            assert abs(sum(copies) / len(copies) - rate) < 0.2
    assert mixing.mix(empty).count() == 0


def brute_kneser_ney(texts, symbols, order=4):
    """Probabilities of an interpolated modified Kneser-Ney model, by dictionaries."""
    sym = lambda c: 0 if c == " " else c
    top = Counter()
    for t in texts:
        s = [0] * (order - 1) + [sym(c) for c in t]
        top.update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(g):
        if not g:
            return 1 / symbols
        c = counts[len(g)]
        n = Counter(c.values())
        d = [0.5, 1.0, 1.5]
        if all(n[k] for k in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) for k in (1, 2, 3)]
        own = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        lower = p(g[1:])
        if not own:
            return lower
        off = lambda v: d[min(v, 3) - 1]
        total = sum(own.values())
        return (own[g] - off(own[g]) if g in own else 0) / total + sum(map(off, own.values())) / total * lower

    return p


def test_classify(spark, docs, empty):
    good = spark.createDataFrame([(k, words(60, k), "en" if k % 2 else None) for k in range(40)], "doc_id long, text string, lang string")
    junk = spark.createDataFrame([(100 + k, "".join(random.Random(k).choice("#$%&|<>*@=") for _ in range(300)), "en") for k in range(5)], "doc_id long, text string, lang string")
    df = good.unionByName(junk).unionByName(docs.select("doc_id", "text", "lang").where("text is null"))
    got = quality_classifier.classify(df, good.where("doc_id < 30").select("doc_id")).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[k] for k in range(30)) and not any(kept[100 + k] for k in range(5)) and not kept[300]
    assert quality_classifier.classify(empty, empty.select("doc_id")).count() == 0
