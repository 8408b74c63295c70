"""Near-duplicates by MinHash: an inverted join on signature coordinates, confirmed on full shingle sets.

1. Each document's distinct shingles give a signature of ``COORDS`` minima and a digest of the set. Documents with
   equal sets (copies) are one node, numbered by one of their rows, so ids may repeat or be missing.
2. A node is posted under (coordinate, value) pairs. Two nodes with at least MATCHES equal coordinates share at least
   COLLISIONS of the first PREFIX in any common order, so only these are posted; the order is rarest first by a count
   sketch. Values that very many documents share are thereby skipped wherever others decide.
3. All members of a short posting list collide in pairs; pairs that share no long list need COLLISIONS such
   collisions. Members of a long list are paired with its most central one. The pairs with enough equal
   coordinates are confirmed on their full sets, and links are contracted to components.
4. Long lists that still hold several components are searched fully across components: their members are posted under
   their rarest shingles, of which two similar sets share one, and those that meet are compared in tiles.
5. All confirmed links together give the final components.

A pair at a similarity of exactly 0.8 has fewer than MATCHES equal coordinates with a probability of about 4e-6.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, found_in, private, slices, small, tidy, written
from .components import components

SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
COORDS, MATCHES = 64, 36
#: Collisions that two nodes with MATCHES equal coordinates have among their first PREFIX.
COLLISIONS = 3
PREFIX = COORDS - MATCHES + COLLISIONS
#: Posting lists up to this long are paired at once.
SHORT_LIST = 8
#: Parts into which the rows of one set of copies are dealt where they meet their component.
PARTS = 16
#: Bits of the slots of the sketches that order coordinates and shingles: four slots a node, a byte each, broadcast.
LEAST_BITS, MOST_BITS = 20, 24
#: Bounds of a block of nodes that meets another in one task, and columns of the matrices multiplied at once.
TILE_ROWS, TILE_SHINGLES, TILE_COLUMNS = 128, 200_000, 4096
#: Bytes hashed at once; longer words extend a block.
BLOCK = 1 << 20

_LOWER = bytes(i + 32 if 65 <= i <= 90 else 32 if 9 <= i <= 13 else i for i in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_MULTIPLY = (np.random.default_rng(20240501).integers(0, 1 << 63, COORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.default_rng(20240502).integers(0, 1 << 63, COORDS, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(n, base, dtype=np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a text in lower case."""
    b = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = b != 32
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_P, len(b)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(_P_INVERSE, len(b))[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; one for a text with fewer words, none without words."""
    hashes: list[list[np.ndarray]] = [[] for _ in texts]
    held, owners, size = [], [], 0

    def flush():
        nonlocal size
        if held:
            h, starts = _block_hashes(b" ".join(held))
            cut = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held]))
            for k, part in zip(owners, np.split(h, cut[:-1]), strict=True):
                hashes[k].append(part)
            held.clear()
            owners.clear()
            size = 0

    for k, text in enumerate(texts):
        low, at = (text or b"").translate(_LOWER), 0
        while at < len(low):
            stop = len(low) if len(low) - at <= BLOCK else low.find(b" ", at + BLOCK)
            stop = len(low) if stop < 0 else stop
            held.append(low[at:stop])
            owners.append(k)
            size += stop - at
            at = stop
            if size > BLOCK:
                flush()
    flush()
    sets = []
    for parts in hashes:
        w = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        n = min(shingle, len(w))
        if not n:
            sets.append(w)
            continue
        h = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = h * _P + w[i : len(w) - n + 1 + i]
        sets.append(np.unique(mixed(h)))
    return sets


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS minima (upper halves) of each set; empty sets have none and must be left out."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * a + b, starts) >> np.uint64(32) for a, b in zip(_MULTIPLY, _ADD, strict=True)], axis=1).astype(np.uint32)


def _tokens(signatures: np.ndarray) -> np.ndarray:
    return (np.arange(COORDS, dtype=np.uint64) << np.uint64(32)) | signatures.astype(np.uint64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDS)


def _set(scalar: pa.Scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), dtype=np.uint64)


def signed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(row, doc_id, t1, t2, n_shingles, d1, d2, sig): number, text hashes, and size, 128-bit digest and signature of each document's set.

    digest and signature are null for empty sets.
    """
    fields = [T.StructField(n, t) for n, t in (("n_shingles", T.LongType()), ("d1", T.LongType()), ("d2", T.LongType()), ("sig", T.BinaryType()))]

    def make():
        def work(texts):
            sets = shingle_sets(texts, shingle)
            full = [x for x in sets if len(x)]
            digests = iter([np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist() for x in full])
            sigs = iter([x.tobytes() for x in signatures_of(full)] if full else [])
            d = [next(digests) if len(x) else (None, None) for x in sets]
            return [[len(x) for x in sets], [x[0] for x in d], [x[1] for x in d], [next(sigs) if len(x) else None for x in sets]]

        return work

    keys = [F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), *text_keys(F.col(text_col))]
    return docs.select(*keys, found_in(F.col(text_col), fields, make, raw=True).alias("f")).select("row", "doc_id", "t1", "t2", "f.*")


def text_keys(text: Column) -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


class Sketch:
    """How many times numbers occur, roughly and never too low: a byte for each slot, in steps of a fifth."""

    def __init__(self, df: DataFrame, n_nodes: int, numbers) -> None:
        """``numbers`` takes a batch of ``df`` to the numbers to count."""
        self.bits = bits = min(max(int(4 * n_nodes).bit_length(), LEAST_BITS), MOST_BITS)

        def run(batches):
            n = np.zeros(1 << bits, dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    n += np.bincount(self.slot(numbers(batch)), minlength=1 << bits)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["slot", "n"])

        level = F.ceil(F.log(F.sum("n")) / float(np.log(1.2)) + 1).cast("short")
        got = df.mapInArrow(run, "slot int, n long").groupBy("slot").agg(level.alias("level")).toArrow()
        self.levels = np.zeros(1 << bits, dtype=np.uint8)
        self.levels[np.asarray(got.column("slot"))] = np.minimum(np.asarray(got.column("level")), 255)

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        return (mixed(numbers) & np.uint64((1 << self.bits) - 1)).astype(np.int64).ravel()

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The level of each number's count: 0 none, 1 once."""
        return self.levels[self.slot(numbers)].reshape(numbers.shape)


def postings(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(token, node, n_shingles, central): each node under its PREFIX rarest coordinate values.

    central: the sum of its coordinates' counts, larger for nodes that share much with others.
    """
    sketch = Sketch(nodes.select("sig"), n_nodes, lambda batch: _tokens(_matrix(batch.column(0))))
    shared = nodes.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                tokens = _tokens(_matrix(part.column(2)))
                n = shared.value.of(tokens)
                first = np.lexsort((tokens, n), axis=1)[:, :PREFIX]
                ids, sizes = (np.repeat(np.asarray(part.column(c)), PREFIX) for c in (0, 1))
                chosen = np.take_along_axis(tokens, first, 1).astype(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(chosen), pa.array(ids), pa.array(sizes), pa.array(np.repeat(n.sum(axis=1, dtype=np.int64), PREFIX))], names=["token", "node", "n_shingles", "central"])
        tidy()

    return nodes.select("node", "n_shingles", "sig").mapInArrow(run, "token long, node long, n_shingles long, central long")


def _alike_in_size(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with the value of each side."""
    for c in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(c), F.col(value).alias(f"{value}_{c}")), c)
    return pairs.select("a", "b", f"{value}_a", f"{value}_b")


def matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs with at least MATCHES equal coordinates."""

    def match(batches):
        for batch in batches:
            if batch.num_rows:
                n = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(n >= MATCHES))

    return written(_both(pairs, nodes, "sig").mapInArrow(match, "a long, b long"), "matching")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def exact(batches):
        for batch in batches:
            for part in slices(batch, 2, 16 << 20):
                keep = []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = _set(x), _set(y)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return written(_both(pairs, sets, "set").mapInArrow(exact, "a long, b long"), "confirmed")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, set): the shingle sets of the wanted nodes, as sorted 64-bit numbers, each once.

    Texts are found by the id and text hash of the row that a node is numbered by. Of repeated rows, a task reads one.
    """

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, 1):
                new = []
                for k, node in enumerate(part.column(0).to_pylist()):
                    if node not in seen:
                        seen.add(node)
                        new.append(k)
                part = part.take(pa.array(new, pa.int64()))
                sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])
        tidy()

    keys = nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("of"), F.col("t1").alias("t"))
    keys = small(written(keys, "wanted"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t1"))
    texts = texts.join(keys, (F.col("t1") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("of")))
    sets = written(texts.select("node", "text").mapInArrow(run, "node long, set binary"), "sets")
    if sets.groupBy("node").count().where("count > 1").isEmpty():
        return sets
    return written(sets.dropDuplicates(["node"]), "sets")


def links_between(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(a, b): confirmed links that connect what all links connect."""
    n_nodes = nodes.count()
    posted = written(postings(nodes, n_nodes), "postings")
    lists = posted.groupBy("token").agg(F.count("*").alias("n"), F.max(F.struct("central", (-F.col("node")).alias("id"), "n_shingles")).alias("head")).where("n > 1")
    listed = written(posted.join(lists.select("token", "n", (-F.col("head.id")).alias("head"), F.col("head.n_shingles").alias("head_size")), "token").drop("central"), "lists")
    discard(posted)

    short, long = listed.where(F.col("n") <= SHORT_LIST), listed.where(F.col("n") > SHORT_LIST)
    x, y = short.alias("x"), short.alias("y")
    each = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & _alike_in_size(F.col("x.n_shingles"), F.col("y.n_shingles")))
    each = each.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= COLLISIONS).select("a", "b")
    stars = long.where((F.col("node") != F.col("head")) & _alike_in_size(F.col("n_shingles"), F.col("head_size")))
    pairs = each.union(stars.select(F.least("node", "head"), F.greatest("node", "head")))
    close = matching(pairs.distinct(), nodes)
    sets = full_sets(docs, nodes, close.select("a").union(close.select("b")).union(long.select("node")).toDF("node").distinct(), id_col, text_col, shingle)
    links = confirmed(close, sets)

    roots = components(links)
    placed = long.select("token", "node", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed")
    mixed_lists = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    mixed_lists = small(written(mixed_lists, "mixed"))  # a list of very many nodes is one key
    open_nodes = written(placed.join(mixed_lists, "token", "left_semi").select("node", "n_shingles", "root").distinct(), "open")
    discard(listed, placed)
    if open_nodes.isEmpty():
        return links
    return links.union(links_across(open_nodes, sets))


def rare_postings(sets: DataFrame, n_nodes: int) -> DataFrame:
    """(token, node): each set under the rarest of its shingles, one of which every similar set has among its own.

    Sets of a and b shingles with at least PERCENT in common share a shingle among the first a - ceil(PERCENT% of a) + 1
    and the same of b, in any common order. Shingles that surely no other set has take places but are not posted.
    """
    sketch = Sketch(sets.select("set"), 16 * n_nodes, lambda batch: np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64))
    shared = sets.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                tokens, ids = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
                for node, s in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    s = _set(s)
                    n = shared.value.of(s)
                    first = np.lexsort((s, n))[: len(s) - -(-PERCENT * len(s) // 100) + 1]
                    first = first[n[first] > 1]
                    tokens.append(s[first].astype(np.int64))
                    ids.append(np.full(len(first), node, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(ids))], names=["token", "node"])

    return sets.select("node", "set").mapInArrow(run, "token long, node long")


def links_across(open_nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different roots among the open nodes (node, n_shingles, root).

    Nodes that share a posted shingle, however indirectly, form a cluster, cut into blocks of bounded size; a root with
    many nodes has blocks of its own, others are dealt to blocks by their hash. Two blocks at a time meet in one task,
    which multiplies their incidence matrices to get all intersections and returns one link for each two roots. Pairs of
    blocks of one and the same root are left out.
    """
    posted = written(rare_postings(sets.join(open_nodes.select("node"), "node", "left_semi"), open_nodes.count()).join(open_nodes, "node"), "rare")
    heads = posted.groupBy("token").agg(F.min("node").alias("a"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token", "a")
    clusters = components(posted.join(heads, "token").select("a", F.col("node").alias("b")))
    members = written(open_nodes.join(clusters.withColumnRenamed("root", "cluster"), "node"), "members")
    discard(posted)

    part = F.greatest(F.count("*") / TILE_ROWS, F.sum("n_shingles") / TILE_SHINGLES)
    by_root = written(members.groupBy("cluster", "root").agg(part.alias("part")), "by_root")
    shared = by_root.where("part < 0.5").groupBy("cluster").agg(F.ceil(F.sum("part")).alias("blocks"))
    by_root = written(by_root.join(shared, "cluster", "left").withColumn("own", F.when(F.col("part") >= 0.5, F.ceil("part"))), "by_root")
    block = F.when(F.col("own").isNotNull(), F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("own")))).otherwise(F.pmod(F.xxhash64("root"), F.col("blocks")))
    members = written(members.join(small(by_root), ["cluster", "root"]).select("cluster", block.alias("block"), "node", "root"), "blocks")
    blocks = written(members.groupBy("cluster", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")), "ends")
    x, y = blocks.alias("x"), small(blocks).alias("y")
    tiles = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block")) & ((F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high")) | (F.col("x.low") != F.col("y.low"))))
    sides = tiles.select("x.cluster", F.col("x.block").alias("left"), F.col("y.block").alias("right"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    rows = sides.join(members, ["cluster", "block"]).join(sets, "node").select("cluster", "left", "right", "block", "node", "root", "set")

    def compare(table):
        block, left = np.asarray(table.column("block")), table.column("left")[0].as_py()
        ids, roots = np.asarray(table.column("node")), np.asarray(table.column("root"))
        found = [_set(s) for s in table.column("set")]
        size = np.array([len(s) for s in found])
        of, (_, word, n) = np.repeat(np.arange(len(found)), size), np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        place = np.cumsum(n > 1) - 1
        of, word = of[n[word] > 1], place[word[n[word] > 1]]
        by_word = np.argsort(word, kind="stable")
        of, word = of[by_word], word[by_word]
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == table.column("right")[0].as_py())
        both = np.zeros((len(a), len(b)), dtype=np.float32)
        for low in range(0, int(word[-1]) + 1 if len(word) else 0, TILE_COLUMNS):
            part = slice(*np.searchsorted(word, [low, low + TILE_COLUMNS]))
            has = np.zeros((len(found), TILE_COLUMNS), dtype=np.float32)
            has[of[part], word[part] - low] = 1
            both += has[a] @ has[b].T
        i, j = np.nonzero((100 * both >= PERCENT * (size[a][:, None] + size[b][None, :] - both)) & (roots[a][:, None] != roots[b][None, :]))
        i, j = a[i], b[j]
        pairs = np.stack([np.minimum(roots[i], roots[j]), np.maximum(roots[i], roots[j])], axis=1)
        first = np.unique(pairs, axis=0, return_index=True)[1]
        return pa.table({"a": ids[i[first]], "b": ids[j[first]]})

    return written(rows.groupBy("cluster", "left", "right").applyInArrow(compare, "a long, b long"), "tiled")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``signed``, and for each set of copies that is not alone (d1, d2, component_id, part, first).

    component_id: the smallest id in the component; first: id and text hashes of the row to keep. Both stand once for
    each of PARTS parts, so that a large set of copies meets them in many tasks.
    """
    rows = written(signed(docs, id_col, text_col, shingle), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    copies = written(rows.where("d1 is not null").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("head"), F.min(first).alias("first"), F.count("*").alias("n")), "copies")
    nodes = rows.join(copies.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "t1", "n_shingles", "sig")
    nodes = written(nodes, "nodes")
    roots = components(links_between(docs, nodes, id_col, text_col, shingle))
    discard(nodes)
    tied = written(copies.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "tied")
    whole = tied.groupBy("root").agg(F.min("head").alias("component_id"), F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    heads = tied.select("d1", "d2", "root").join(whole.drop("n"), "root").drop("root")
    return rows, written(heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), "heads")


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")).join(heads, ["d1", "d2", "part"], "left")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    n_shingles: size of the set of distinct shingles of lower-cased words (the whole sequence where there are fewer
    words). component_id: smallest id that links reach, its own included. kept: whether that is its own. Null and
    empty texts have no shingles and no links. Rows that repeat an id are each linked by their own text; a null id is
    nobody's representative, and such a row is kept unless it is linked to one with an id. Other columns play no part.
    """
    rows, heads = grouped(docs, id_col, text_col, shingle)
    found = _with_heads(rows.select("row", "doc_id", "n_shingles", "d1", "d2"), heads.drop("first")).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id (null last), then text hash.

    Rows without words stay. Of rows with equal id and text that are kept one stays, whichever.
    """
    rows, heads = grouped(docs, id_col, text_col, shingle)
    own = docs.columns
    key = private(docs, "_key")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).cast("long").alias("doc_id"), *text_keys(F.col(text_col))))
    placed = _with_heads(rows.select("row", "doc_id", "t1", "t2", "d1", "d2"), heads.select("d1", "d2", "part", "first")).where("first is not null")
    mine = F.struct("doc_id", "t1", "t2")
    chosen = F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.t1").alias("t1"), F.col("first.t2").alias("t2"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    gone = written(placed.where(~same).select(mine.alias(key)).distinct(), "gone")
    twins = written(placed.where(same).groupBy(chosen.alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key), "twins")
    kept = keyed.join(small(gone), keyed[key].eqNullSafe(gone[key]), "left_anti")
    if twins.isEmpty():
        return kept.select(own)
    same_as = kept[key].eqNullSafe(twins[key])
    once = kept.join(small(twins), same_as, "left_semi").dropDuplicates([key])
    return kept.join(small(twins), same_as, "left_anti").unionByName(once).select(own)
