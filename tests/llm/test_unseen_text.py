"""Verdicts on text that models have not seen."""

import random

from lakestat.llm import quality_classifier


def prose(seed, n=120):
    r = random.Random(seed)
    parts = "the of and er in on ti al re st nd is our wa ter la ke ri ver".split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def junk(seed, n=500):
    r = random.Random(seed)
    return "".join(r.choice("$%#@!*&<>{}|~^ qxzjkv0123456789") for _ in range(n))


def test_clean_text_that_the_model_has_not_seen_is_kept(spark):
    """Trained on half of the clean documents, the classifier keeps the other half and drops junk, in a rare language too."""
    rows = [(k, prose(k), "en" if k % 8 else "fr") for k in range(240)] + [(1000 + k, junk(k), ("en", "fr", "xx")[k % 3]) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_classifier.classify(df, df.where("doc_id < 120").select("doc_id")).collect()
    unseen = [r.kept for r in got if 120 <= r.doc_id < 1000]
    assert sum(unseen) >= 0.95 * len(unseen)
    assert not any(r.kept for r in got if r.doc_id >= 1000)
