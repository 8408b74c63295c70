"""Near-duplicate embeddings: a tiled comparison in the order of principal components.

Equal vectors are one node with a weight. Nodes are rotated to principal axes (fitted on a bounded sample) and dealt to
blocks: a tree of cuts along the leading axes gives cells, and cells with many nodes are split by hash. Two blocks meet in
one task unless the gap between their boxes on the leading axes already rules links out. A task multiplies the leading
dimensions, adds the product of the norms of the rest as a bound, and goes on to further dimensions only for the pairs
that can still reach the threshold. It returns sums of links and, for components, at most one edge per node. The work is
that of all pairs of blocks that remain, quadratic where vectors have no structure; the output is linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small, written
from .components import components

THRESHOLD = 0.95
#: Vectors that the axes and the cuts between cells are fitted on (those with the smallest hash).
SAMPLE_ROWS = 4_000
BLOCK, PART = 4096, 1024
#: Parts into which the rows of one set of copies are dealt where they meet their component.
PARTS = 16
#: Dimensions accumulated before each bound.
STEPS = (12, 24, 40)
#: Leading axes along which cells are cut and boxes compared, and the most cuts one above another.
AXES, DEPTH = 8, 9
#: What rounding may add to a bound.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector is not null or empty, has only finite components and one that is not zero."""
    finite = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny and huge components do no harm."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Cells:
    """The principal axes of vectors of one length, and a tree of cuts along the leading ones."""

    def __init__(self, x: np.ndarray, share: float) -> None:
        """``x``: sampled unit vectors; ``share``: blocks wanted of these."""
        dim = x.shape[1]
        values, turn = np.linalg.eigh(np.cov(x, rowvar=False).reshape(dim, dim) if len(x) > 1 else np.eye(dim))
        self.turn = turn[:, np.argsort(-values)]
        self.depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(share, 1.0))))))
        self.axis, self.cut = np.zeros(1 << self.depth, dtype=np.int64), np.zeros(1 << self.depth)
        on_axes, cell = x @ self.turn[:, :AXES], np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            for c in np.unique(cell):  # the widest axis, at its middle
                own = on_axes[cell == c]
                k = int(np.argmax(own.std(axis=0)))
                self.axis[c], self.cut[c] = k, np.median(own[:, k])
            cell = 2 * cell + (on_axes[np.arange(len(x)), self.axis[cell]] >= self.cut[cell])

    def place(self, on_axes: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        cell = np.ones(len(on_axes), dtype=np.int64)
        for _ in range(self.depth):
            cell = 2 * cell + (on_axes[np.arange(len(on_axes)), self.axis[cell]] >= self.cut[cell])
        return cell


def cells_of(sample: DataFrame, n_nodes: int) -> dict[int, Cells]:
    """For each dimension in the sample its axes and cells."""
    by_dim: dict[int, list] = {}
    for v in sample.toArrow().column(0).to_pylist():
        by_dim.setdefault(len(v), []).append(v)
    total = sum(map(len, by_dim.values()))
    return {dim: Cells(unit(np.array(rows, dtype=np.float64)), n_nodes * len(rows) / (total * BLOCK)) for dim, rows in by_dim.items()}


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components under links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y (unit vectors on principal axes) whose product may reach the threshold."""
    dim, least = x.shape[1], threshold - SLACK
    cuts = [*(s for s in STEPS if s < dim), dim]
    rest_x, rest_y = [[np.sqrt((v[:, c:] ** 2).sum(axis=1)) for c in cuts] for v in (x, y)]
    i, j = np.nonzero(x[:, : cuts[0]] @ y[:, : cuts[0]].T + np.outer(rest_x[0], rest_y[0]) >= least)
    got = np.einsum("ij,ij->i", x[i, : cuts[0]], y[j, : cuts[0]])
    for k in range(1, len(cuts)):
        part = slice(cuts[k - 1], cuts[k])
        got = got + np.einsum("ij,ij->i", x[i, part], y[j, part])
        can = got + rest_x[k][i] * rest_y[k][j] >= least
        i, j, got = i[can], j[can], got[can]
    return i, j


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, whatever other columns say.

    n_links: other vectors with a cosine, in double precision, of at least the threshold. component_id: smallest id
    that links reach, its own included. kept: whether that is its own. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, nor do vectors of different length. Rows that repeat an id are
    each linked by their own vector (with equal ones they are copies of each other); a null id is nobody's
    representative. Other columns, whatever their names, play no part.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")), F.col("v")))
    rows = written(rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))}), "vectors")
    copies = written(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("vec_id").alias("head"), F.count("*").alias("n")), "copies")
    nodes = rows.join(copies.select(F.col("node").alias("row"), "n"), "row").select(F.col("row").alias("node"), "n", "v")
    nodes = written(nodes, "nodes")

    n_nodes = nodes.count()
    cells = cells_of(nodes.select("v", F.xxhash64("v").alias("h"), "node").orderBy("h", "node").limit(SAMPLE_ROWS).select("v"), n_nodes)
    shared = spark.sparkContext.broadcast(cells)

    def place(batches):
        for batch in batches:
            cell, lead = [], []
            for v in batch.column(2).to_pylist():
                own = shared.value.get(len(v))
                on_axes = unit(np.array([v])) @ own.turn[:, :AXES] if own else np.zeros((1, 1))
                cell.append(int(own.place(on_axes)[0]) if own else 0)
                lead.append(on_axes[0].tolist())
            dims = pa.array([len(v) for v in batch.column(2)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), dims, pa.array(cell, pa.int64()), pa.array(lead, pa.list_(pa.float64()))], names=["node", "n", "v", "dim", "cell", "lead"])

    placed = written(nodes.mapInArrow(place, "node long, n long, v array<double>, dim int, cell long, lead array<double>"), "cells")
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    block = F.shiftleft("cell", 32) + F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = written(placed.join(small(written(parts, "parts")), ["dim", "cell"]).withColumn("block", block).drop("cell", "parts"), "placed")
    discard(nodes)

    k = list(range(AXES))
    blocks = placed.groupBy("dim", "block").agg(F.array(*[F.min(F.get("lead", F.lit(i))) for i in k]).alias("low"), F.array(*[F.max(F.get("lead", F.lit(i))) for i in k]).alias("high"))
    blocks = written(blocks, "blocks")
    x, y = blocks.repartition("dim", "block").alias("x"), small(blocks).alias("y")
    widest = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    gaps = [F.coalesce(F.greatest(F.lit(0.0), F.col("y.low")[i] - F.col("x.high")[i], F.col("x.low")[i] - F.col("y.high")[i]), F.lit(0.0)) for i in k]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= widest * widest
    tiles = x.join(y, (F.col("x.dim") == F.col("y.dim")) & (F.col("x.block") <= F.col("y.block")) & near)
    sides = tiles.select("x.dim", F.col("x.block").alias("left"), F.col("y.block").alias("right"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    meeting = sides.join(placed.select("dim", "block", "node", "n", F.col("v").cast("array<float>").alias("f"), "v"), ["dim", "block"])
    # Vectors of single precision, the usual case, travel as such.
    narrow = F.forall(F.zip_with("f", "v", lambda a, b: a.cast("double") == b), lambda same: same)
    meeting = meeting.select("dim", "left", "right", "block", "node", "n", F.when(narrow, F.col("f")).alias("f"), F.when(~narrow, F.col("v")).alias("v"))

    def compare(table):
        block = np.asarray(table.column("block"))
        left, right, dim = (table.column(c)[0].as_py() for c in ("left", "right", "dim"))
        ids, weight = np.asarray(table.column("node")), np.asarray(table.column("n"))
        f, v = table.column("f").combine_chunks(), table.column("v").combine_chunks()
        full = np.empty((len(ids), dim))
        is_f = np.asarray(f.is_valid())
        full[is_f] = np.asarray(f.drop_null().flatten(), dtype=np.float64).reshape(-1, dim)
        full[~is_f] = np.asarray(v.drop_null().flatten(), dtype=np.float64).reshape(-1, dim)
        norm = np.sqrt((full * full).sum(axis=1))
        own = shared.value.get(dim)
        on_axes = unit(full) @ own.turn if own else unit(full)
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for s in range(0, len(a), PART):
            for t in range(s if left == right else 0, len(b), PART):
                p, q = a[s : s + PART], b[t : t + PART]
                i, j = similar(on_axes[p], on_axes[q], threshold)
                i, j = p[i], q[j]
                if left == right:
                    i, j = i[i < j], j[i < j]
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    cosine = np.einsum("ij,ij->i", full[i], full[j]) / (norm[i] * norm[j])
                odd = ~np.isfinite(cosine)
                if odd.any():
                    cosine[odd] = np.einsum("ij,ij->i", unit(full[i[odd]]), unit(full[j[odd]]))
                i, j = i[cosine >= threshold], j[cosine >= threshold]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                if len(i):
                    near = local_roots(len(ids), np.r_[i, np.arange(len(ids))], np.r_[j, root])
                    root = near
        with_links, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
        none = pa.nulls(len(tied), pa.int64())
        return pa.table(
            {
                "node": pa.chunked_array([pa.array(ids[with_links]), pa.array(ids[tied])]),
                "links": pa.chunked_array([pa.array(links[with_links]), none]),
                "other": pa.chunked_array([pa.nulls(len(with_links), pa.int64()), pa.array(ids[root[tied]])]),
            }
        )

    found = written(meeting.groupBy("dim", "left", "right").applyInArrow(compare, "node long, links long, other long"), "links")
    discard(placed)
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    tied = written(copies.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left"), "tied")
    heads = tied.select("h1", "h2", "root", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).join(tied.groupBy("root").agg(F.min("head").alias("component_id")), "root").where("n_links > 0")
    # A large set of copies meets its component in many tasks.
    heads = heads.select("h1", "h2", "n_links", "component_id", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    found = rows.select("row", "vec_id", "h1", "h2").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    found = found.join(heads, ["h1", "h2", "part"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept.alias("kept"))
