"""A corpus pipeline over ``documents``: language, near-duplicates, personal data, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Whatever else these are called, operators' own columns stay apart from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestat.llm import bpe, language_id, minhash, mixing, pii
from lakestat.llm.common import private, table, written
from lakestat.llm.queries import tokenizer_path

#: Documents whose language is less probable than this are rejected.
LEAST_SCORE = 0.5
#: Near-duplicates share shingles of so many words.
SHINGLE = 5

#: SQL can't express the stages; tests hold run() against a plain version.
ORACLE_SQL = None


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or with an improbable language go."""
    found = private(docs, "_found")
    own = docs.columns
    docs = docs.withColumn(found, language_id.identified(F.col("text"), language_id.train(docs)))
    return docs.where((F.col(f"{found}.lang_pred") != language_id.UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_SCORE)).select(own)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, and of repeated rows one."""
    return minhash.distinct(docs, shingle=SHINGLE)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    found = private(docs, "_found")
    own = docs.columns
    changed = F.col(f"{found}.redacted")
    new = {"text": F.coalesce(changed, F.col("text")), "n_chars": F.when(changed.isNotNull(), F.length(changed).cast("long")).otherwise(F.col("n_chars"))}
    docs = docs.withColumn(found, pii.redaction(F.col("text"), pii.train(docs)))
    return docs.select([new[c].alias(c) if c in new else F.col(c) for c in own])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; those without words stay as they are."""
    keys = ("doc_id", "text", "source")
    found = mixing.taken_of(docs, mixing.plan(docs, *keys), *keys)
    taken = found.columns[-1]
    return found.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(f"{taken}.copies"))).alias(private(found, "_copy"))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path()).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", keep_identified),
    ("minhash", keep_distinct),
    ("pii", redact),
    ("mixing", mix),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
