"""Languages, quality and scratch tables in the cases that are easily missed."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lakestat.llm import common, language_id, quality_classifier
from tests.llm.conftest import words


def test_rare_languages_are_learned(spark, monkeypatch):
    """A language with few documents among very many of another is learned, and training stays within its bound."""
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 50)
    r = random.Random(2)
    text = lambda pool: " ".join(r.choices(pool.split(), k=15))
    rows = [(k, text("the water of lake and bridge under stone with"), "en") for k in range(1500)] + [(5000 + k, text("vesi järvi silta kivi alla kanssa meri joki"), "fi") for k in range(6)]
    rows += [(7, "again " * 20, "en")] * 90 + [(None, "none", "xx"), (9000, None, "yy"), (9001, "text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("_lang", "_id", "_level", "score", "LANG_PRED")})
    usable = df.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).where("_id is not null and _lang = 'en'")
    taken = language_id.chosen(usable, F.col("_lang"), "_id")
    assert 20 <= taken.count() <= 150
    model = language_id.train(df)
    assert model[0] == ["en", "fi"]
    found = language_id.identify(df, model)
    assert found.columns == ["doc_id", "text", "lang", "_lang", "_id", "_level", "lang_pred", "score"]
    assert found.where("lang = 'fi' and lang_pred != 'fi'").count() == 0 and found.where("doc_id = 7").select("lang_pred", "score").distinct().count() <= 2


def test_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 1 << 16)
    df = spark.createDataFrame([(k, words(8, k), f"l{k:03}") for k in range(450)], "doc_id long, text string, lang string")
    langs, prior, logp = language_id.train(df)
    assert len(langs) == 450 - df.where(language_id.held_out()).count() and logp.shape[0] * logp.shape[1] <= 1 << 16 and logp.shape[0] >= 64
    assert language_id.identify(df, (langs, prior, logp)).where("lang_pred = 'und'").count() == 0


def test_classify_cases(spark, docs):
    """Repeated rows agree, a language without trusted documents takes the common threshold, other columns do not clash."""
    good = [(k, words(60, k), "en" if k % 2 else None) for k in range(40)]
    rows = good + [(3, good[3][1], "en"), (200, words(60, 7), "zz"), (201, "".join(random.Random(1).choice("#$%&|<>*@=") for _ in range(300)), "zz"), (None, words(60, 5), "en"), (202, words(20_000, 5), "en"), (203, None, None), (204, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("kept", "perplexity", "threshold", "chunk", "gram", "n", "l")})
    got = quality_classifier.classify(df, df.where("doc_id < 40").select("doc_id")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[3]) == 2 and by[3][0] == by[3][1]
    assert by[200][0].kept and not by[201][0].kept and by[200][0].threshold is not None
    assert by[202][0].perplexity < 4 and by[None][0].kept and not by[203][0].kept and not by[204][0].kept
    nobody = quality_classifier.classify(df, df.where("false").select("doc_id")).collect()
    assert all(r.threshold is None and r.kept == (r.perplexity is not None) for r in nobody) and sum(r.kept for r in nobody) == len(rows) - 2


def test_scratch_tables(spark):
    df = common.written(spark.range(5).withColumn("scratch", F.lit(1)), "test")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    common.discard(df, None, spark.range(3).withColumn("scratch", F.lit(1)))
    import os

    assert not os.path.exists(path)
    nowhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(nowhere)


def test_modest_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for given, want in (("10000", "1000"), ("0", "1000"), ("64", "64")):
        spark.conf.set(name, given)
        common.modest_batches(spark)
        assert spark.conf.get(name) == want
    spark.conf.set(name, before)
