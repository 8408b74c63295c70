"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters as they are (code points, order 4): words of this kind of corpus are mostly new, and junk
shows in its characters. Its tables grow with the trusted text: counts are gathered sharded by n-gram; discounts,
continuation counts and interpolation weights are aggregations and joins of the count tables. Nothing of the model
is collected. Documents are packed in chunks of some CHUNK_BYTES; a chunk's distinct n-grams, far fewer than its
characters, are joined to the probabilities, and what comes back (by their places in the chunk's list) meets the chunk
again, to be summed by document. A document is kept if its perplexity is at most that of nearly all trusted documents of
its language that the model has not seen: a part of them is held back from training for the thresholds.
"""

from __future__ import annotations

import bz2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, modest_batches, slices, small, tidy, written

ORDER = 4
#: One trusted document of so many, by the hash of its id, sets thresholds and is not trained on.
HELD = 4
#: Share of a language's held documents whose perplexity sets its threshold.
QUANTILE = 0.998
#: Deviations above the mean at which a normal distribution has that quantile.
TAIL = 2.88
#: A text of n characters may be more perplexing by this over the root of n: the mean over few characters varies more.
ALLOWANCE = 4.0
#: Steps of a log-probability where it travels back to its documents.
SCALE = 1 << 24
#: Text of the documents that are scored together, in bytes.
CHUNK_BYTES = 10 << 20


class Grams:
    """The n-grams that end at each character of some texts, numbered in the order of ``distinct``."""

    def __init__(self, texts: list[str]) -> None:
        pad = " " * (ORDER - 1)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = np.zeros(0x110000, dtype=bool)
        seen[points] = True
        self.alphabet = np.flatnonzero(seen).astype(np.uint32)
        s = (np.cumsum(seen, dtype=np.int32) - 1)[points]
        del points
        self.width = max(len(self.alphabet).bit_length(), 1)
        self.pairs = None
        if self.width * ORDER > 62:  # more symbols than fit: number the pairs
            self.pairs, s = np.unique(s[:-1].astype(np.int64) << 32 | s[1:], return_inverse=True)
            code = s[:-2] << 32 | s[2:]
        else:
            if self.width * ORDER > 31:
                s = s.astype(np.int64)
            code = s[ORDER - 1 :].copy()
            for k in range(1, ORDER):
                code |= s[ORDER - 1 - k : -k] << (self.width * k)
        del s
        inside = np.ones(len(code) + ORDER - 1, dtype=bool)
        starts = np.concatenate([[0], np.cumsum(size + ORDER - 1)[:-1]])
        for k in range(ORDER - 1):
            inside[starts + k] = False
        self.code = code[inside[ORDER - 1 :]]
        self.starts = np.concatenate([[0], np.cumsum(size)[:-1]])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes, sorted, and how often each occurs."""
        return np.unique(self.code, return_counts=True)

    def spelled(self, code: np.ndarray) -> pa.Array:
        """Codes as strings of ORDER characters."""
        if self.pairs is None:
            at = [code >> (self.width * k) & ((1 << self.width) - 1) for k in range(ORDER - 1, -1, -1)]
        else:
            first, last = self.pairs[code >> 32], self.pairs[code & 0xFFFFFFFF]
            at = [first >> 32, first & 0xFFFFFFFF, last >> 32, last & 0xFFFFFFFF]
        text = np.ascontiguousarray(self.alphabet[np.stack(at, axis=1)]).tobytes().decode("utf-32-le", "surrogatepass")
        return pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)], pa.string())


def gram_counts(trusted: DataFrame, text_col: str) -> DataFrame:
    """(gram, n): the n-grams of all trusted texts, each a string of ORDER characters."""

    def counted(texts: list[str]) -> pa.RecordBatch:
        grams = Grams(texts)
        code, n = grams.distinct()
        return pa.RecordBatch.from_arrays([grams.spelled(code), pa.array(n, pa.int64())], names=["gram", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                held += [t for t in part.column(0).to_pylist() if t]
                size += part.nbytes
                if size >= CHUNK_BYTES and held:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return trusted.select(text_col).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    n = [getattr(table.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first(), f"n{k}") for k in (1, 2, 3, 4)]
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]


def levels(trusted: DataFrame, text_col: str = "text") -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, own) of the seen n-grams, and (context, rest) of the contexts.

    The probability of a gram's last character is own (0 if unseen) + rest (1 if the context is unseen) * that of the
    gram without its first character. Order 0 is ``uniform``.
    """
    tables = [written(gram_counts(trusted, text_col), "ngrams")]
    for _ in range(ORDER - 1):  # continuation counts: how many characters come before
        tables.append(written(tables[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "ngrams"))
    out = []
    for k, table in enumerate(reversed(tables), start=1):
        d = _discounts(table)
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = table.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("discount", discount)
        contexts = written(own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("discount").alias("spared")), "contexts")
        seen = own.join(contexts, "context").select("gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("own"))
        out.append((seen, contexts.select("context", (F.col("spared") / F.col("total")).alias("rest"))))
    return out


def probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, logp) of distinct ``grams``: the log-probability of the last character after the others.

    Characters that no trusted text has share one place in the uniform distribution over characters.
    """
    uniform = 1 / (model[0][0].count() + 1)
    needed = [grams]
    for _ in range(len(model) - 1):
        needed.append(written(needed[-1].select(F.expr("substring(gram, 2)").alias("gram")).distinct(), "needed"))
    lower = None
    for k, (need, (seen, contexts)) in enumerate(zip(reversed(needed), model, strict=True), start=1):
        shorter = lower
        df = need.join(seen, "gram", "left").withColumn("context", F.substring("gram", 1, k - 1)).join(contexts, "context", "left")
        if lower is None:
            df = df.withColumn("less", F.lit(uniform))
        else:
            df = df.withColumn("shorter", F.expr("substring(gram, 2)")).join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("less")), "shorter")
        lower = written(df.select("gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("less")).alias("p")), "probabilities")
        discard(shorter, need)
    return lower.select("gram", F.log("p").alias("logp"))


def packed(docs: DataFrame) -> DataFrame:
    """(chunk, docs, grams) for each CHUNK_BYTES of text: its rows as a compressed Arrow stream, and its distinct n-grams.

    Chunks are numbered by task and place.
    """
    at = docs.columns.index("text")

    def chunk_of(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts).combine_chunks()
        texts = [t for t in part.column(at).to_pylist() if t]
        grams = Grams(texts) if texts else None
        del texts
        spelled = grams.spelled(grams.distinct()[0]) if grams else pa.array([], pa.string())
        del grams
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as stream:
            stream.write_table(part)
        rows = [pa.array([number], pa.int64()), pa.array([bz2.compress(sink.getvalue())], pa.binary()), pa.array([spelled], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(rows, names=["chunk", "docs", "grams"])

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for part in slices(batch, at):
                held.append(part)
                size += part.column(at).nbytes
                if size >= CHUNK_BYTES:
                    number += 1
                    yield chunk_of(number, held)
                    held, size = [], 0
        if held:
            yield chunk_of(number + 1, held)
        tidy()

    return written(docs.mapInArrow(run, "chunk long, docs binary, grams array<string>"), "packed")


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(doc_id, lang, chars, perplexity) of every row, per character; null for null and empty texts. Whole texts are read."""

    def answer(rows: pa.Table, told: pa.Table) -> pa.Table:
        part = pa.ipc.open_stream(bz2.decompress(rows.column("docs")[0].as_py())).read_all()
        texts = part.column("text").to_pylist()
        out: list[float | None] = [None] * len(texts)
        if at := [k for k, t in enumerate(texts) if t]:
            grams = Grams([texts[k] for k in at])
            code, _ = grams.distinct()
            own = np.empty(len(code))
            known = np.asarray(told.column("known"))
            own[known >> 32] = (known & 0xFFFFFFFF) / -SCALE
            sums = np.add.reduceat(own[np.searchsorted(code, grams.code)], grams.starts)
            for k, s in zip(at, sums, strict=True):
                out[k] = float(np.exp(-s / len(texts[k])))
        return pa.table({"doc_id": part.column("doc_id"), "lang": part.column("lang"), "chars": pa.array([len(t or "") for t in texts], pa.int64()), "perplexity": pa.array(out, pa.float64())})

    chunks = packed(docs.select("doc_id", "lang", "text"))
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("grams").alias("place", "gram"))
    known = probabilities(written(asked.select("gram").distinct(), "needed"), model)
    # A place and a log-probability in one number.
    packed_up = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.round(F.col("logp") * -SCALE).cast("long"))
    told = asked.join(known, "gram").select("of", packed_up.alias("known"))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], T.StructField("chars", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    return chunks.select("chunk", "docs").groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(answer, schema)


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of every row.

    ``trusted_ids``: ids of good documents. One in HELD is held back and the rest are trained on (where either part has
    none, all do both). Of the held ones' perplexities, less the allowance for their lengths and in
    hundredths, the QUANTILE of each language, exact, from their counts, sets its threshold, or TAIL deviations above
    their mean if that is more (of few documents the largest is no such quantile yet); a document's own has its
    allowance again. Languages without held documents take the quantile of all together, and without any trusted
    document the threshold is null and all that have text are kept. Rows without text have no perplexity and are not
    kept. A null language is one of its own. Repeated rows give repeated results; other columns play no part.
    """
    modest_batches(docs.sparkSession)
    ids = written(trusted_ids.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct(), "trusted")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    apart = 0 < ids.where(held).count() < ids.count()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = levels(own.join(small(ids.where(~held) if apart else ids), "doc_id", "left_semi"), "text")
    scored = written(perplexities(own, model), "perplexity")
    allowed = 1 + ALLOWANCE / F.sqrt(F.greatest(F.col("chars"), F.lit(1)))
    cells = scored.where("perplexity is not null").join(small(ids.where(held) if apart else ids), "doc_id", "left_semi").groupBy("lang", F.ceil(F.col("perplexity") / allowed * 100).alias("cell")).agg(F.count("*").alias("n"))
    cells = written(cells, "cells")

    def quantile(part: DataFrame, *by: str) -> DataFrame:
        whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
        upto = part.withColumn("upto", F.sum("n").over(whole.orderBy("cell"))).withColumn("of", F.sum("n").over(whole))
        mean = F.sum(F.col("cell") * F.col("n")) / F.sum("n")
        spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("cell") * F.col("cell") * F.col("n")) / F.sum("n") - mean * mean) * (1 + 1 / F.sum("n")))
        reached = F.min(F.when(F.col("upto") >= QUANTILE * F.col("of"), F.col("cell")))
        return upto.groupBy(*by).agg((F.greatest(reached, mean + TAIL * spread) / 100).alias("threshold"))

    pooled = quantile(cells.groupBy("cell").agg(F.sum("n").alias("n"))).first()
    by_lang = quantile(cells, "lang").withColumnRenamed("lang", "l")
    found = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    found = found.withColumn("threshold", F.coalesce("threshold", F.lit(pooled.threshold if pooled else None).cast("double")) * allowed)
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull() & F.col("threshold").isNull())
    return found.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
