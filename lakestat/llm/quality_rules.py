"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted text and the whole corpus.

Native: SQL functions only. N-grams (words and pairs of words) are hashed to BUCKETS. Two multinomials over the
buckets, of trusted documents and of all, give each bucket a log-ratio; a document's score is the mean over its
n-grams. The target is fitted on one half of the trusted documents; the threshold is a low quantile of the scores of
the other half, which the target has not seen, so that it means the same for a corpus of any size. Every document is
kept whose score reaches the threshold and that passes the base rules.

Counting reads all documents once and shuffles at most BUCKETS rows from each task; the log-ratios (BUCKETS numbers, a
fixed bound) become a literal array, so that scoring is one pass without a shuffle or a join.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, small, written

BUCKETS = 1 << 16
#: Share of trusted documents, of the half that the target has not seen, that score below the threshold.
QUANTILE = 0.01
#: Weight of the corpus distribution in the smoothed target, against that of the trusted n-grams.
SMOOTHING = 1.0
#: Digits of a score, so that the order of sums decides nothing, and of a log-ratio.
DIGITS, RATIO_DIGITS = 9, 5

SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    """Runs without white space; an empty array for null."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def hashed(words: Column) -> Column:
    """Hashes of words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def pairs(uni: Column) -> Column:
    """Hashes of neighbouring words, from the hashes of words."""
    return F.transform(F.slice(uni, 1, F.greatest(F.size(uni) - 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(uni, i + 1)))


def bucket(h: Column) -> Column:
    """The bucket of a hash."""
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def grams(rows: DataFrame, text_col: str, *kept: str) -> DataFrame:
    """(kept columns, bucket) of every n-gram of every row."""
    uni = rows.select(*kept, hashed(words(F.col(text_col))).alias("uni"))
    return uni.select(*kept, F.explode(F.concat("uni", pairs(F.col("uni")))).alias("gram")).select(*kept, bucket(F.col("gram")).alias("bucket"))


def scorer(ratios: DataFrame) -> Callable[[Column, Column], Column]:
    """The mean log-ratio from the hashes of a text's words and of its pairs, null without any; BUCKETS numbers as a literal."""
    table = dict(ratios.collect())
    weights = F.split(F.lit(",".join(f"{table[k]:.{RATIO_DIGITS}f}" for k in range(BUCKETS))), ",").cast("array<double>")
    total = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(weights, bucket(h)))
    return lambda uni, pair: F.when(F.size(uni) + F.size(pair) > 0, F.round((total(uni) + total(pair)) / (F.size(uni) + F.size(pair)), DIGITS))


def smallest(values: DataFrame, k: int) -> int:
    """The value of place k (from 0) of whole numbers ``v``: counted in cells, then within the one that holds it."""
    for step in (10**6, 10**3, 1):
        cell = F.floor(F.col("v") / step)
        for found, n in sorted(values.groupBy(cell.alias("cell")).count().collect()):  # noqa: B007
            if k < n:
                break
            k -= n
        values = values.where(cell == found)
    return found


def train(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, float]:
    """(bucket, ratio) for all BUCKETS, and the threshold.

    ``trusted``: ids of documents to be liked, all of which are used. The corpus counts cover all rows. Without trusted n-grams all ratios are 0 and the threshold is 0.
    """
    chosen = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    # 1 for the half that the target is fitted on, 2 for the other.
    chosen = small(chosen.withColumn("half", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(2)).cast("int") + 1))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id", "left")
    counts = grams(rows, "text", "half").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("half") == 1).alias("good"))
    spark = docs.sparkSession
    counts = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", (F.coalesce("n", F.lit(0)) + 0.5).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    counts = written(counts, "buckets")
    total, good = counts.agg(F.sum("n"), F.sum("good")).first()
    if not good:
        return counts.select("bucket", F.lit(0.0).alias("ratio")), 0.0
    share = F.col("n") / total
    weight = SMOOTHING * good
    ratios = written(counts.select("bucket", F.round(F.log((F.col("good") + weight * share) / ((good + weight) * share)), RATIO_DIGITS).alias("ratio")), "ratios")
    # A text counts once, however many documents have it.
    held = rows.where("half = 2").select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), hashed(words(F.col("text"))).alias("uni"))
    scored = held.select("t1", "t2", F.round(scorer(ratios)(F.col("uni"), pairs(F.col("uni"))) * 10**DIGITS).cast("long").alias("v"))
    # Texts without words go after the table is written: before, the filter would repeat the whole expression.
    scored = written(scored.distinct(), "held").where("v is not null")
    n = scored.count()
    if not n:
        return ratios, 0.0
    place = QUANTILE * (n - 1)
    low, high = (smallest(scored, k) for k in (floor(place), ceil(place)))
    return ratios, round((low + (place - floor(place)) * (high - low)) / 10**DIGITS, DIGITS)


def repeated_words(windows: Column) -> Column:
    """Words that lie in windows found twice or more, from the array of (hash, place) of all windows, sorted."""
    twice = F.filter(
        windows,
        lambda x, i: (x["h"] == F.get(windows, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(windows, F.greatest(i - 1, F.lit(0)))["h"])),
    )
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def base_rules(docs: DataFrame, text_col: str = "text", ratios: DataFrame | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and, with ``ratios``, llr (see ``judge``)."""
    own = [F.col(c) for c in docs.columns if c.lower() not in MADE or c == text_col]
    p = private(docs, "_q")
    while any(c.lower().startswith(p.lower()) for c in docs.columns):
        p += "_"
    w, uni, pair, triple, windows, lines, twice, text = (f"{p}_{n}" for n in ("words", "uni", "pair", "triple", "windows", "lines", "twice", "text"))
    df = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias(text)).withColumn(w, words(F.col(text))).withColumn(uni, hashed(F.col(w))).withColumn(pair, pairs(F.col(uni)))
    llr = F.lit(None).cast("double")
    if ratios is not None:
        llr = F.coalesce(scorer(ratios)(F.col(uni), F.col(pair)), F.lit(0.0))
    df = df.select(
        *own,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        F.transform(F.slice(pair, 1, F.greatest(F.size(pair) - 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(uni, i + 2))).alias(triple),
        llr.alias("llr"),
    )
    # Windows are sorted only where some occur twice.
    placed = F.sort_array(F.transform(triple, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(windows, F.when(F.size(F.array_distinct(triple)) < F.size(triple), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")).withColumn(twice, repeated_words(F.col(windows)))
    reach = F.aggregate(F.transform(twice, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(twice, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("n_repeat_words", reach).select(*own, *MADE[:5], failed.alias("base_failed"), *(["llr"] if ratios is not None else []))


def judge(docs: DataFrame, model: tuple[DataFrame, float], text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    llr is the mean log-ratio of the text's n-grams (0 without words). base_failed: fewer than 50 words, or over half
    of the words in repeated 3-word windows. kept: not base_failed, and llr reaches the model's threshold. Null texts have
    no words; repeated rows give repeated results. Columns of these names, but for the text, are replaced; no other name
    clashes.
    """
    ratios, threshold = model
    found = base_rules(docs, text_col, ratios)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
