"""Mixing sources to target weights by entropy balancing.

Among all rates of documents between 0 and MOST whose words reach their source's target, those nearest to the present
mix (by relative entropy over documents) are exponentially tilted by size: exp(dual * size), at most MOST. The dual is
convex, with one variable for each source; Newton iterations sum its gradient and curvature over all documents of each
size, as one aggregation for all sources at a time. Rates are then rounded to copies so that words carry over from size
to size, from the largest down: a source's words miss the target by less than its documents' sizes force them to.

Documents of one source and size differ by nothing, so the work is on such classes; which of a class's documents get
the odd copy is decided by their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, private, small, written

#: Weights of the sources in the order of their names' code points, null last; they repeat.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source's target, and no document, exceeds this many times its size.
MOST = 3
#: Newton stops at this relative error of a source's words; a bracket around the solution halves otherwise.
TOLERANCE = 1e-10
ROUNDS = 200
#: Ranges of source names that are numbered apart from each other.
RANGES = 32


def n_words(text: Column) -> Column:
    """Runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts as the sources do: by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def weighted(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source_key, ...), one row each, with the weight by place in the order of keys.

    Ranges of keys are numbered apart and shifted by the rows before them, of which only RANGES counts are collected.
    """
    ranged = written(sources.repartitionByRange(RANGES, "source_key").withColumn("range", F.spark_partition_id()), "ranged")
    before, at = [], 0
    for r in ranged.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        before.append((r["range"], at))
        at += r.n
    offsets = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in before]), F.array(*[F.lit(n) for _, n in before])) if before else F.lit(None).cast("map<int,int>")
    place = F.row_number().over(W.partitionBy("range").orderBy("source_key")) - 1 + offsets[F.col("range")]
    return ranged.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))).drop("range")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source_key, source_size) with the words wanted of each source as target.

    Targets are proportional to weight but at most ``most`` times the size; the level per weight at which they add up
    to all words is found by resharing: each round sums what is at its limit and what is not.
    """
    sources = written(weighted(sizes, weights), "weighted")
    level, capped = -1.0, F.col("source_size") * float(most)
    while True:
        over = F.col("weight") * level > capped if level >= 0 else F.lit(False)
        s = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, capped).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not s.free:
            break
        new = ((s.all or 0) - s.full) / s.free
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.col("weight") * max(level, 0.0), capped)).drop("weight")


def tilt(dual: Column, size: Column, mean: Column) -> Column:
    """The rate of a document of ``size`` words."""
    return F.least(F.lit(float(MOST)), F.exp(dual * size / mean))


def duals(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_key, dual, mean): the dual variable, per ``mean`` words, that gives each source its target.

    ``classes``: source_key, size, n (documents of that size); ``sources``: source_key, source_size, target. Each round is
    one aggregation over all classes, of the words and their derivative. Newton's step is taken on the logarithm
    of the words where it stays within the bracket known to hold the solution. A source whose target is MOST times its
    size has an infinite dual.
    """
    mean = classes.where("size > 0").groupBy("source_key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    full = F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12)
    state = sources.where("source_size > 0").join(mean, "source_key").withColumns({"dual": F.when(full, float("inf")).otherwise(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "done": full})
    state, done = written(state, "duals"), None
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("mean")
        rate = tilt(F.col("dual"), F.col("size"), F.col("mean"))
        open_ = state.where("not done")
        sums = classes.where("size > 0").join(open_, "source_key").groupBy(*[F.col(c) for c in state.columns]).agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.when(rate < MOST, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope")
        )
        short = F.col("words") < F.col("target")
        step = sums.withColumn("low", F.when(short, F.col("dual")).otherwise(F.col("low"))).withColumn("high", F.when(short, F.col("high")).otherwise(F.col("dual")))
        newton = F.col("dual") + F.log(F.col("target") / F.col("words")) * F.col("words") / F.col("slope")
        outside = newton.isNull() | F.isnan(newton) | (newton <= F.col("low")) | (newton >= F.col("high"))
        wide = F.when(F.col("high") == float("inf"), F.greatest(F.lit(1.0), F.col("low") * 2 + 1)).when(F.col("low") == float("-inf"), F.least(F.lit(-1.0), F.col("high") * 2 - 1)).otherwise((F.col("low") + F.col("high")) / 2)
        near = F.abs(F.col("words") - F.col("target")) <= TOLERANCE * F.col("target")
        stuck = F.col("high") - F.col("low") <= 1e-13 * F.greatest(F.lit(1.0), F.abs(F.col("dual")))
        moved = step.select(*[c for c in state.columns if c not in ("dual", "done")], F.when(near | stuck, F.col("dual")).when(outside, wide).otherwise(newton).alias("dual"), (near | stuck).alias("done"))
        done = state.where("done") if done is None else done.unionByName(state.where("done"))
        state = written(moved.select(state.columns), "duals")
        if state.where("not done").isEmpty():
            break
    return (state if done is None else done.unionByName(state)).select("source_key", "dual", "mean")


def rounded(classes: DataFrame) -> DataFrame:
    """(source_key, size, n, copies): whole copies of all documents of a class together.

    ``classes`` has source_key, size, n, rate, target. From the largest size down, a class takes what its rate and the
    words carried over ask for, rounded; a second pass uses up what is still missing or too much. One source's classes
    meet in one task: different sizes number at most the root of twice the source's words.
    """

    def carry(table: pa.Table) -> pa.Table:
        size, n, rate = (np.asarray(table.column(c)) for c in ("size", "n", "rate"))
        order = np.argsort(-size)
        size, n, rate = size[order], n[order], rate[order]
        copies, over = np.zeros(len(size), dtype=np.int64), 0.0
        for k, (s, m, r) in enumerate(zip(size.tolist(), n.tolist(), rate.tolist(), strict=True)):
            want = m * r * s + over
            copies[k] = min(max(round(want / s), 0), MOST * m)
            over = want - float(copies[k]) * s
        rest = float(table.column("target")[0].as_py()) - float((copies.astype(object) * size).sum())
        for k, (s, m) in enumerate(zip(size.tolist(), n.tolist(), strict=True)):
            more = min(int(rest // s), MOST * m - int(copies[k])) if rest > 0 else -min(int(-rest // s), int(copies[k]))
            copies[k] += more
            rest -= more * s
        return pa.table({"source_key": pa.array([table.column("source_key")[0].as_py()] * len(size), pa.string()), "size": size, "n": n, "copies": copies})

    return classes.groupBy("source_key").applyInArrow(carry, "source_key string, size long, n long, copies long")


def _marks(doc_id: Column, row: Column) -> dict[str, Column]:
    """What orders the documents of a class: slice of the hash, hash, then part and place among equal rows."""
    hashed = F.xxhash64(doc_id, F.col("size"), F.col("source_key"))
    slice_ = F.floor(F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53)) * F.ceil(F.sqrt("n"))).cast("long")
    return {"m_slice": slice_, "m_hash": hashed, "m_part": F.shiftright(row, 33), "m_row": row}


MARKS = ("m_slice", "m_hash", "m_part", "m_row")


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source_key, size, n, source_size, target, each, c0 ... c3): what the mix takes of every class.

    All documents get ``each`` copies, and those whose marks are up to (c0 ... c3) one more. The cut is found mark by
    mark: rows are counted by the next mark among those that share the cut so far, so that no task ever ranks more than
    about the root of a class, or equal rows of one part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("source_key"), n_words(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "sizes")
    counts = written(rows.groupBy("source_key", "size").agg(F.count("*").alias("n")), "classes")
    sources = written(targets(counts.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights), "sources")
    solved = duals(counts, sources)
    with_rate = counts.where("size > 0").join(sources.select("source_key", "target"), "source_key").join(solved, "source_key")
    whole = rounded(with_rate.select("source_key", "size", "n", "target", tilt(F.col("dual"), F.col("size"), F.col("mean")).alias("rate")))
    classes = written(whole.withColumn("each", F.floor(F.col("copies") / F.col("n"))).withColumn("need", F.col("copies") - F.col("each") * F.col("n")), "whole")

    cut = classes.where("need > 0").select("source_key", "size", "n", "need")
    for k, mark in enumerate(MARKS):
        joined = rows.join(small(cut), ["source_key", "size"])
        for m, c in _marks(F.col("doc_id"), F.col("row")).items():
            joined = joined.withColumn(m, c)
        for i in range(k):
            joined = joined.where(F.col(MARKS[i]) == F.col(f"c{i}"))
        key = ["source_key", "size", "n", "need", *[f"c{i}" for i in range(k)]]
        counted = joined.groupBy(*key, mark).agg(F.count("*").alias("m"))
        upto = counted.withColumn("upto", F.sum("m").over(W.partitionBy("source_key", "size").orderBy(mark).rowsBetween(W.unboundedPreceding, 0)))
        here = upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("m") < F.col("need")))
        cut = written(here.select(*[c for c in key if c != "need"], F.col(mark).alias(f"c{k}"), (F.col("need") - F.col("upto") + F.col("m")).alias("need")), "cut")
    done = classes.select("source_key", "size", "each").join(cut.drop("n", "need"), ["source_key", "size"], "left")
    zero = counts.where("size = 0").select("source_key", "size", "n", F.lit(1).cast("long").alias("each"), *[F.lit(None).cast("long").alias(f"c{i}") for i in range(4)])
    done = done.join(counts, ["source_key", "size"]).select(zero.columns).unionByName(zero)
    made = written(done.join(sources, "source_key"), "plan")
    discard(rows, counts, classes)
    return made


def taken_of(docs: DataFrame, made: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with a struct ``_mix`` of size, source_size, target, copies and taken, by what ``plan`` made of the same table.

    Rows are told apart by id and size. Of equal ones, the numbers of their places in the table decide, which are the
    same each time if it is read from files.
    """
    name = private(docs, "_mix")
    own = docs.columns
    df = docs.withColumns({f"{name}_s": source_key(F.col(source_col)), f"{name}_n": n_words(F.col(text_col)), f"{name}_r": F.monotonically_increasing_id()})
    made = small(made.select(F.struct(*made.columns).alias(f"{name}_c")))
    df = df.join(made, (F.col(f"{name}_s") == F.col(f"{name}_c.source_key")) & (F.col(f"{name}_n") == F.col(f"{name}_c.size")))
    c = F.col(f"{name}_c")
    hashed = F.xxhash64(F.col(id_col), c["size"], c["source_key"])
    marks = F.struct(F.floor(F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53)) * F.ceil(F.sqrt(c["n"]))).cast("long"), hashed, F.shiftright(F.col(f"{name}_r"), 33), F.col(f"{name}_r"))
    more = F.when(c["c0"].isNotNull() & (marks <= F.struct(c["c0"], c["c1"], c["c2"], c["c3"])), 1).otherwise(0)
    copies = (c["each"] + more).cast("int")
    return df.select(*[F.col(x) for x in own], F.struct(c["size"].alias("size"), c["source_size"].alias("source_size"), c["target"].alias("target"), copies.alias("copies"), (copies * c["size"]).alias("taken")).alias(name))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row.

    size: words of the text (0 for null and empty ones, which are taken once as they are). taken is copies * size, 0 to
    MOST times the size. Repeated rows and rows without id are taken like others, and reruns agree. A null source is a
    source. Without words, all targets are 0. Other columns, whatever their names, play no part.
    """
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "texts") if not docs.inputFiles() else docs
    if rows is not docs:
        id_col, text_col, source_col = "doc_id", "text", "source"
    found = taken_of(rows.select(id_col, text_col, source_col), plan(rows, id_col, text_col, source_col, weights), id_col, text_col, source_col)
    return found.select(F.col(id_col).alias("doc_id"), "_mix.*")
