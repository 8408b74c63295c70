"""Top-k search, collocations and periodic runs, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakestat.llm import collocations, periodic_runs, queries, topk_search

VECTORS = "vec_id long, embedding array<double>, score string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(rows, k=20):
    sound = [(i, v, [int(np.floor(64 * x)) for x in w]) for i, (v, w, *_) in enumerate(rows) if w is not None and all(x is not None and np.isfinite(x) for x in w)]
    out = []
    for i, q, a in sound:
        if q is not None and q % 20 == 0:
            got = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), v is None, v or 0) for j, v, b in sound if j != i)[:k]
            out += [(q, n, None if null else v, -s) for n, (s, null, v) in enumerate(got, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in topk_search.search(df, F.col("vec_id") % 20 == 0).collect()), key=str)


def test_search_with_ties_copies_and_odd_vectors(spark):
    r = random.Random(5)
    rows = [(k - 40, [round(r.gauss(0, 0.2), 3) if r.random() < 0.6 else 0.0 for _ in range(12)], "clash") for k in range(400)]
    rows += [(1000 + k, rows[7][1], "copy") for k in range(60)]  # ties beyond k
    rows += [(500, None, "a"), (520, [1.0, None], "b"), (540, [float("nan"), 1.0], "c"), (560, [float("inf")], "d"), (580, [], "e"), (600, [0.5, -0.5], "f"), (None, rows[3][1], "g"), (20, rows[3][1], "h"), (20, rows[3][1], "h")]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert found(df) == brute_search(rows)


def test_search_over_many_cells_and_tiles(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 7), ("TILE", 3), ("LEAST_GROUP", 16), ("MOST_GROUP", 64)):
        monkeypatch.setattr(topk_search, name, value)
    r = random.Random(6)
    rows = [(k, [r.randrange(-2, 3) / 64 for _ in range(5)], "x") for k in range(500)]
    assert found(spark.createDataFrame(rows, VECTORS)) == brute_search(rows)


def test_search_of_few_none_and_huge(spark):
    assert found(spark.createDataFrame([], VECTORS)) == []
    assert found(spark.createDataFrame([(0, [1.0], "x")], VECTORS)) == []
    rows = [(0, [1.0, 2.0], "x"), (20, [0.3, 0.1], "x"), (1, [-1.0, 5.0], "x")]
    assert found(spark.createDataFrame(rows, VECTORS)) == brute_search(rows)
    huge = [(k, [s * 2.0**e, 1.0], "x") for k, (s, e) in enumerate([(1, 50), (-1, 50), (1, 10), (1, 55), (-1, 55)])] + [(20, [2.0**40, -1.0], "x")]
    assert found(spark.createDataFrame(huge, VECTORS)) == brute_search(huge)


def brute_phrases(rows, least, first):
    count, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            count.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    counts = {x: n for x, n in count.items() if n >= least}
    out = []
    for (lang, phrase), a in counts.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        cut = min((2_000_000 * a // (l + r), k, l, r) for k in range(1, len(w)) for l, r in [(counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])])])
        longer = [n for (x, p), n in counts.items() if x == lang and len(p.split(" ")) > len(w) and f" {phrase} " in f" {p} "]
        if not any(100 * n >= 80 * a for n in longer):
            out.append((lang, phrase, a, cut[2], cut[3], total[lang], cut[0]))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    place = Counter()
    ranked = []
    for x in out:
        place[x[0]] += 1
        if place[x[0]] <= first:
            ranked.append((x[0], place[x[0]], *x[1:]))
    return ranked


def prose(seed, n=400, kinds=9):
    r = random.Random(seed)
    w = ["The", "of", "lake", "new", "york", "city", "Éau", "x", "i.e", "né"][: kinds + 1]
    return "".join(r.choice(w) + (" New York  City\t" if r.random() < 0.1 else "") + r.choice([" "] * 7 + ["\t", ", ", ".\n", "  ", "!? ", "\r\n", "\x0c"]) for _ in range(n))


@pytest.mark.parametrize(("shard_bytes", "bits"), [(400, 64), (8 << 20, 1 << 27)])
def test_collocations(spark, monkeypatch, shard_bytes, bits):
    """Small and large shards, with a full bitmap of pairs and with a nearly empty one."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(collocations, "BITS", bits)
    rows = [(prose(k), ("en", "de", None)[k % 3]) for k in range(9)] + [(None, "en"), ("", "fr"), (" \t\n", "fr"), ("one two three", "fr"), ("b " * 300, "und"), (prose(1), "en"), (prose(1), "en"), ("z" * 50_000, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(3)).repartition(3)
    for least, first in ((30, 2000), (4, 25)):
        got = [tuple(r) for r in collocations.mine(df, least=least, first=first).orderBy("lang", "rank").collect()]
        want = brute_phrases(rows, least, first)
        assert got == want and len(want) > 10
    assert collocations.mine(df.limit(0)).count() == 0
    assert collocations.mine(df.select(F.lit(None).cast("string").alias("text"), "lang")).count() == 0


def test_automaton_states_are_sets_of_places():
    r = random.Random(2)
    for _ in range(60):
        codes = np.array([r.choice([-1, 0, 0, 1, 2, 3]) for _ in range(r.randrange(1, 60))], dtype=np.int32)
        joined = np.array([r.random() < 0.8 for _ in codes])
        a = collocations.Automaton(codes, 4, joined)
        ends = {}
        for i in range(len(codes)):
            for k in range(1, 5):
                span = range(i - k + 1, i + 1)
                if span[0] >= 0 and all(codes[j] >= 0 for j in span) and all(joined[j] for j in span[1:]):
                    ends.setdefault(tuple(codes[j] for j in span), []).append(i)
        phrases = [tuple(codes[e - n + 1 : e + 1]) for e, n in zip(*a.phrases()[:2])]
        assert len(set(phrases)) == len(phrases) and dict(zip(phrases, a.phrases()[2])) == {p: len(e) for p, e in ends.items()}
        assert len(a.count) == len({tuple(e) for e in ends.values()})  # one state for each set of places
        for end, size, link in zip(a.end, a.size, a.link):
            own = tuple(codes[end - size + 1 : end + 1])
            suffixes = [own[k:] for k in range(1, size) if ends[own[k:]] != ends[own]]
            assert (link == -1) == (not suffixes)
            assert link == -1 or tuple(codes[a.end[link] - a.size[link] + 1 : a.end[link] + 1]) == suffixes[0]


def test_scores_beyond_64_bits(spark):
    big = 2**62
    counts = spark.createDataFrame([("en", "a", big + 3), ("en", "b", big + 1), ("en", "a b", big), ("en", "a b c", big // 5 * 4), ("en", "c", big), ("en", "b c", big - 7)], "lang string, phrase string, a long")
    got = {r.phrase: (r.l, r.r, r.score) for r in collocations.scored(counts).collect()}
    assert got["a b"] == (big + 3, big + 1, 2_000_000 * big // (2 * big + 4))
    assert got["a b c"] == min([(big + 3, big - 7), (big, big)], key=lambda x: 2_000_000 * (big // 5 * 4) // sum(x)) + (2_000_000 * (big // 5 * 4) // (2 * big),)
    gone = {r.phrase for r in collocations.subsumed(counts).collect()}
    assert gone == {p for p, a in (("a b", big), ("b c", big - 7)) if 100 * (big // 5 * 4) >= 80 * a}


def brute_runs(w):
    out = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, p, n) for (s, n), p in out.items())


def expected_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    best = None
    for s, p, n in runs:
        if best is None or n * best[1] > best[2] * p:
            best = (s, p, n)
    numbers = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, p, n in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *numbers, *digest)


def test_periodic_runs(spark, docs):
    r = random.Random(9)
    rows = [(k, None if k % 50 == 0 else " ".join(r.choice("ab cé"[: r.choice([2, 3, 5])]) for _ in range(r.randrange(0, 80)))) for k in range(500)]
    rows += [(k, " ".join((f"w{r.randrange(k)} x y " * 3 + "p q " * r.randrange(8) + "u \t\n") for _ in range(9))) for k in range(600, 700)]
    rows += [(None, "a a a a a a a"), (1003, "a b " * 3), (1003, "a b " * 3), (1004, "a b a b a b a b a"), (5, "x" * 100_000), (6, "\n\x0b\x0c\r"), (7, "l m n " * 5000)]
    h = F.crc32(F.col("doc_id").cast("string"))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("_found", F.lit(2)).repartition(4)
    full = periodic_runs.find(df, seed=F.when(h % 10 == 0, F.floor(h / 10)))
    assert set(full.columns) == {"doc_id", "text", "_found", "n_words", "runs", "best", "collapsed"}
    got = sorted((tuple(x) for x in full.select("doc_id", *periodic_runs.digests(full)).collect()), key=str)
    assert got == sorted((expected_runs(*x) for x in rows), key=str)
    assert periodic_runs.find(df.limit(0)).count() == 0
    plain = {x.doc_id: x.runs for x in periodic_runs.find(df.where("doc_id in (1003, 1004)")).collect()}
    assert plain[1003] == [] and [tuple(x) for x in plain[1004]] == [(0, 9, 2)]


def test_periodic_runs_of_a_table(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(x) for x in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected_runs(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()), key=str)


def test_minima():
    r = np.random.default_rng(1)
    for n in (1, 31, 32, 33, 500, 2000):
        v = r.integers(0, 1000, n).astype(np.int32)
        m = periodic_runs.Minima(v)
        a, b = np.sort(r.integers(0, n, (2, 300)), axis=0)
        assert (m.least(a, b) == [v[x : y + 1].min() for x, y in zip(a, b)]).all()
