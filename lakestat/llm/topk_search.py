"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over posting lists.

Vectors are rows of integer weights by term (component). Queries and candidates are dealt to a grid of cells, each a
block of queries against a group of candidates. A cell's queries are few (QUERY_BLOCK); its candidates stream past in
batches that are inverted to posting lists, and each term's queries scatter their weighted postings into dense score
arrays. A batch leaves only what reaches the query's k-th best score so far; the cells' lists are merged by a ranking.
Every pair is scored: the work is queries times candidates by the question itself, and candidates travel once for each
block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import modest_batches, written

K, SCALE = 20, 64
#: Queries of a block, queries that are scored together, and the candidates of a group at the least and at the most.
QUERY_BLOCK, TILE, LEAST_GROUP, MOST_GROUP = 4096, 512, 1024, 65_536
_LONG = np.iinfo(np.int64)
CELL = "cell long, side int, row long, id long, weights array<long>"
FOUND = "query_row long, query_id long, vec_id long, score long"


def weights(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, held within a long; null unless all components are finite numbers."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    far = float(2**62)
    whole = F.transform(v, lambda x: F.when(x * scale >= far, F.lit(2**62)).when(x * scale <= -far, F.lit(-(2**62))).otherwise(F.floor(x * scale)).cast("long"))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of weights, shorter ones filled up with zeros."""
    out = np.zeros((len(lists), dim), dtype=np.int64)
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten())
    at = np.repeat(np.arange(len(lists)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products (candidates by queries), term at a time; held within a long where they pass it."""
    reach = int(np.abs(candidates).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, candidates.shape[1])
    if reach > _LONG.max:
        return np.clip(candidates.astype(object) @ queries.T.astype(object), _LONG.min, _LONG.max).astype(np.int64)
    acc = np.zeros((len(candidates), len(queries)), dtype=np.int64)
    for term in range(candidates.shape[1]):
        posted, asked = np.flatnonzero(candidates[:, term]), np.flatnonzero(queries[:, term])
        if 2 * len(asked) > len(queries):  # most of the queries: whole rows of the score array
            acc[posted] += candidates[posted, term][:, None] * queries[:, term]
        elif len(asked):
            acc[np.ix_(posted, asked)] += candidates[posted, term][:, None] * queries[asked, term]
    return acc


class Tile:
    """Some queries and the best candidates of each so far: flat, by query, then rank."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.rows, self.ids, self.queries, self.k = rows, ids, queries, k
        self.least = np.full(len(rows), _LONG.min)  # the k-th best score, or what stands in for it
        self.best = [np.zeros(0, dtype=np.int64)] * 4  # query, score, id, whether the id is null

    def add(self, rows: np.ndarray, ids: np.ndarray, no_id: np.ndarray, candidates: np.ndarray) -> None:
        dim = max(candidates.shape[1], self.queries.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (candidates, self.queries))
        got = scores(a, b)
        if len(got) > self.k + 1:  # selection: one more than k, for a query may meet itself
            self.least = np.maximum(self.least, np.partition(got, len(got) - self.k - 1, axis=0)[len(got) - self.k - 1])
        c, q = np.nonzero((got >= self.least) & (rows[:, None] != self.rows))
        query, score, vec, null = (np.r_[x, y] for x, y in zip(self.best, (q, got[c, q], ids[c], no_id[c]), strict=True))
        order = np.lexsort((vec, null, ~score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        self.best = [x[order] for x in (np.r_[self.best[0], q], score, vec, null)]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.best[0][last]] = np.maximum(self.least[self.best[0][last]], self.best[1][last])


def _batch(tiles: list[Tile]) -> pa.RecordBatch:
    query = [t.rows[t.best[0]] for t in tiles], [t.ids[t.best[0]] for t in tiles]
    columns = [*query, [t.best[2] for t in tiles], [t.best[1] for t in tiles]]
    arrays = [pa.array(np.concatenate([*c, np.zeros(0, dtype=np.int64)]).astype(np.int64)) for c in columns]
    null = np.concatenate([*[t.best[3] for t in tiles], np.zeros(0)]).astype(bool)
    arrays[2] = pa.array(arrays[2].to_numpy(), mask=null)
    return pa.RecordBatch.from_arrays(arrays, names=["query_row", "query_id", "vec_id", "score"])


def in_cells(batches: Iterator[pa.RecordBatch], k: int, tile: int) -> Iterator[pa.RecordBatch]:
    """The best of each query in each cell; rows come by cell, queries before candidates."""
    cell, tiles, waiting = None, [], []

    def ready() -> list[Tile]:
        if waiting:
            lists = pa.concat_arrays([w.column("weights") for w in waiting])
            rows, ids = (np.concatenate([np.asarray(w.column(c)) for w in waiting]) for c in ("row", "id"))
            dim = int(np.asarray(lists.value_lengths()).max(initial=0))
            tiles.extend(Tile(rows[s : s + tile], ids[s : s + tile], matrix(lists[s : s + tile], dim), k) for s in range(0, len(rows), tile))
            waiting.clear()
        return tiles

    for batch in batches:
        key = np.asarray(batch.column("cell")) * 2 + np.asarray(batch.column("side"))
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for s, e in zip(edges[:-1], edges[1:]):
            part = batch.slice(s, e - s)
            if int(key[s]) // 2 != cell:
                if ready():
                    yield _batch(tiles)
                cell, tiles = int(key[s]) // 2, []
            if key[s] % 2 == 0:
                waiting.append(part)
                continue
            lists = part.column("weights")
            own = matrix(lists, int(np.asarray(lists.value_lengths()).max(initial=0)))
            ids = part.column("id")
            for own_tile in ready():
                own_tile.add(np.asarray(part.column("row")), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), own)
    if ready():
        yield _batch(tiles)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates with the largest integer inner product, for each query row.

    Queries: rows with an id for which ``is_query`` holds; candidates: every row but the query's own. Weights are
    floor(scale * component). All candidates if they are fewer than k; ties go to the smaller id, a null id last.
    Vectors that are null or hold a null or non-finite component take no part; of vectors of different length the
    components that both have count. Rows that repeat an id are queries and candidates each by itself. Weights and
    scores stay within 64 bits (larger ones are held at the limit). Other columns play no part.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), vectors[id_col].cast("long").alias("id"), weights(vectors[vector_col], scale).alias("weights"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows.where("weights is not null").withColumn("asks", F.col("asks") & F.col("id").isNotNull()), "weights")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, -(-asking // QUERY_BLOCK))
    groups = max(1, -(-n // MOST_GROUP), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_GROUP))
    place = F.xxhash64("row")

    def dealt(df: DataFrame, side: int, block: Column, group: Column) -> DataFrame:
        return df.select((block * groups + group).alias("cell"), F.lit(side).alias("side"), "row", "id", "weights")

    all_blocks, all_groups = (F.explode(F.sequence(F.lit(0), F.lit(most - 1))) for most in (blocks, groups))
    asked = rows.where("asks").withColumn("group", all_groups)
    queries = dealt(asked, 0, F.pmod(place, F.lit(blocks)), F.col("group"))
    candidates = dealt(rows.withColumn("block", all_blocks), 1, F.col("block"), F.pmod(place, F.lit(groups)))
    parts = min(blocks * groups, 10_000)
    cells = queries.union(candidates).repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell", "side")
    tile = TILE
    found = cells.mapInArrow(lambda batches: in_cells(batches, k, tile), FOUND)
    best = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
