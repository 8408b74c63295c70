"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language with Spark; the matrix of log-probabilities (languages x buckets) has at most
CELLS entries and is broadcast. Scoring is one pass over the documents without a shuffle: each batch of texts becomes
one array of code points, and the hashed n-grams' rows of the matrix are gathered and summed per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, found_in, slices, small, tidy, written

#: Hash buckets for n-grams of all orders together, at most; there are fewer only where the languages would make the
#: matrix larger than CELLS.
BUCKETS = 1 << 16
CELLS = 1 << 22
ORDERS = (2, 3, 4)
#: Bound on labelled documents of each language that the model is fitted on, those with the smallest hash of their id.
TRAIN_ROWS = 4_000
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_ASCII = np.array([i if chr(i).isalpha() else 32 for i in range(128)], dtype=np.uint32)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of training: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ngram_hashes(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray]]:
    """For texts laid out one after another: the interleaved bounds of each, and per order the bucket at each position.

    Letters are lower-cased, other ASCII characters become spaces; padding keeps n-grams within their text.
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(f" {t}    " for t in low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(points < 128, _ASCII[np.minimum(points, 127)], points).astype(np.uint32)
    ends = np.cumsum([len(t) + 5 for t in low])
    bounds = np.empty(2 * len(low), dtype=np.int64)
    bounds[1::2] = ends - 4
    bounds[0::2] = np.concatenate([[0], ends[:-1]])
    found, n = [], len(points) - max(ORDERS) + 1
    mixed = np.zeros(n, dtype=np.uint32)
    for k in range(max(ORDERS)):
        mixed = (mixed ^ (points[k : k + n] * _MIX[k])) * np.uint32(0x01000193)
        if k + 1 in ORDERS:
            h = mixed ^ (mixed >> np.uint32(15)) ^ np.uint32(k * 0x5BD1)
            found.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - buckets.bit_length()))
    return bounds, found


def chosen(usable: DataFrame, lang: Column, id_col: str) -> DataFrame:
    """The rows of each language that it is learned from: all, or TRAIN_ROWS / 2 to TRAIN_ROWS of them.

    Documents fall into levels, each half as likely as the one before, by the leading zeros of their ids' hashes. A
    language takes the levels from the lowest on that keeps it within its bound. Counts per language and level are all
    that is shuffled.
    """
    level = F.lit(64) - F.length(F.bin(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1)))
    rows = usable.withColumn("_level", level.cast("int"))
    counts = rows.groupBy(lang.alias("_of"), "_level").agg(F.count("*").alias("_n"))
    upto = W.partitionBy("_of").orderBy(F.desc("_level")).rowsBetween(W.unboundedPreceding, 0)
    least = counts.withColumn("_upto", F.sum("_n").over(upto)).groupBy("_of").agg(
        F.min(F.when(F.col("_upto") <= TRAIN_ROWS, F.col("_level"))).alias("_fits"), F.max("_level").alias("_top")
    )
    # Copies of one id alone can exceed the bound; the level that holds them is then taken whole.
    least = small(written(least.select("_of", F.coalesce("_fits", "_top").alias("_least")), "levels"))
    return rows.join(least, (lang == F.col("_of")) & (F.col("_level") >= F.col("_least")), "left_semi").drop("_level")


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log-priors, and the (buckets, languages) matrix of smoothed log-probabilities.

    Takes rows with a language and letters that are not held out, at most TRAIN_ROWS of each language, so that every
    labelled language is learned however rare. Priors are shares of all such rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where("_id is not null and _lang is not null and _text is not null")
    rows = rows.where(~held_out("_id"))
    share = rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy("_lang").toArrow()
    langs, docs_of = share.column("_lang").to_pylist(), np.asarray(share.column("n"), dtype=np.float64)
    buckets = BUCKETS
    while buckets > 64 and buckets * len(langs) > CELLS:
        buckets //= 2

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1):
                own = part.column(0).dictionary_encode()
                code, texts = np.asarray(own.indices), part.column(1).to_pylist()
                for k, lang in enumerate(own.dictionary.to_pylist()):
                    bounds, orders = ngram_hashes([texts[i] for i in np.flatnonzero(code == k)], buckets)
                    inside = np.zeros(len(orders[0]) + 1, dtype=np.int8)
                    np.add.at(inside, bounds[0::2], 1)
                    np.add.at(inside, np.minimum(bounds[1::2], len(orders[0])), -1)
                    mask = np.cumsum(inside[:-1]) > 0
                    n = sum(np.bincount(h[mask], minlength=buckets) for h in orders)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])
        tidy()

    counts = chosen(rows, F.col("_lang"), "_id").select("_lang", "_text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    matrix = np.zeros((buckets, len(langs)))
    matrix[np.asarray(got.column("bucket")), np.asarray(pc.index_in(got.column("lang"), pa.array(langs, pa.string())))] = np.asarray(got.column("n"))
    smooth = matrix + 0.5
    return langs, np.log(np.maximum(docs_of, 1) / max(docs_of.sum(), 1)), np.log(smooth / smooth.sum(axis=0)) if langs else matrix


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def _scorer(model: tuple[list[str], np.ndarray, np.ndarray]):
    """A function that makes the scorer of each task; the model is broadcast."""
    langs, prior, logp = model
    shared = SparkSession.active().sparkContext.broadcast((langs, prior, logp.astype(np.float32)))

    def make():
        langs, prior, logp = shared.value
        columns = [np.ascontiguousarray(logp[:, g]) for g in range(len(langs))]

        def work(texts):
            pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if langs and t and _LETTER.search(t)]
            if at:
                bounds, orders = ngram_hashes([texts[i] for i in at], len(logp))
                total = np.tile(prior, (len(at), 1))
                edges = np.minimum(bounds, len(orders[0]) - 1)
                for g, column in enumerate(columns):
                    for h in orders:
                        total[:, g] += np.add.reduceat(column[h], edges, dtype=np.float64)[0::2]
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, s in zip(at, best, share, strict=True):
                    pred[i], score[i] = langs[b], s
            return pred, score

        return work

    return make


def identified(text: Column, model: tuple[list[str], np.ndarray, np.ndarray]) -> Column:
    """A struct of lang_pred and score for a text column."""
    return found_in(text, FIELDS, _scorer(model))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the posterior probability of that language.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if the model has no language.
    Ties go to the language that sorts first. Whole texts are read, of any length. Repeated rows give repeated
    results; columns of ``docs`` named lang_pred or score are replaced.
    """
    return append_columns(docs, text_col, FIELDS, _scorer(model))
