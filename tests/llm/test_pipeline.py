"""The corpus pipeline against a plain version of its stages, on a small table of all sorts of rows."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lakestat.llm import mixing
from lakestat.llm.queries import tokenizer_path
from tests.llm.test_groups import ASCII_LOWER, roots_of
from tests.llm.test_single_pass import base_spans

#: Names that operators use for columns of their own, or that they return.
CLASHES = ("score", "kept", "copies", "copy", "spans", "lang_pred", "n_email", "redacted", "size", "target", "component_id", "_found", "_mix", "_key", "_copy", "row", "t1", "node", "_FOUND_")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def one_of_each(rows, n):
    """The (id, text) rows that near-duplicate removal keeps, as choices: each a set of rows of which one stays."""
    sets = [shingles(t, n) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = {}
    for i, root in roots_of(range(len(rows)), links).items():
        groups.setdefault(root, []).append(rows[i])
    least = lambda g: min((k is None, k or 0) for k, _ in g)
    return [{r for r in g if (r[0] is None, r[0] or 0) == least(g)} for g in groups.values()]


def test_pipeline(spark, docs, tmp_path):
    more = spark.createDataFrame([(0, "repeated id with another text " * 20 + "mail x.y@mail.example.com", "en", "a", 5), (None, "", "en", None, None), (306, "the same id, something else entirely", "de", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.drop("score", "kept").unionByName(more)
    table = table.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = out[name] = spark.read.parquet(str(tmp_path / name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash", "pii", "mixing", "bpe"]
    rows = {"documents": [(r.doc_id, r.text) for r in table.collect()]}
    for name in list(out)[:-1]:
        assert out[name].columns == table.columns
        assert out[name].where(" or ".join(f"{c} != 'own {c}' or {c} is null" for c in CLASHES)).count() == 0
        rows[name] = [(r.doc_id, r.text) for r in out[name].collect()]

    assert Counter(rows["language_id"]) <= Counter(rows["documents"])
    gone = Counter(rows["documents"]) - Counter(rows["language_id"])
    assert all(not any(c.isalpha() for c in t or "") or len(set(t)) < 3 for _, t in gone), gone
    assert all(any(c.isalpha() for c in t) for _, t in rows["language_id"])

    choices = one_of_each(rows["language_id"], corpus_pipeline.SHINGLE)
    left = Counter(rows["minhash"])
    for choice in choices:
        assert sum(left[r] for r in choice) == 1, choice
    assert len(rows["minhash"]) == len(choices)

    before, after = Counter(k for k, _ in rows["minhash"]), Counter(k for k, _ in rows["pii"])
    assert before == after
    for r in out["pii"].collect():
        if len(r.text) < 100_000:
            assert not base_spans(r.text)
            assert (r.doc_id, r.text) in rows["minhash"] or "<" in r.text and r.n_chars == len(r.text)
    plain = [(k, t) for k, t in rows["minhash"] if len(t) < 100_000 and not base_spans(t)]
    assert Counter(plain) <= Counter(rows["pii"])

    copies = Counter(rows["mixing"])
    want = Counter()
    keyed = mixing.taken_of(out["pii"], mixing.plan(out["pii"], "doc_id", "text", "source"), "doc_id", "text", "source")
    for r in keyed.select("doc_id", "text", F.col(f"{keyed.columns[-1]}.copies").alias("n")).collect():
        want[r.doc_id, r.text] += r.n
    assert copies == +want

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    digest = lambda text: hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in t.encode(text, add_special_tokens=False).ids)).hexdigest()
    tokens = out["bpe"].collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in tokens) == Counter((k, digest(x)) for k, x in rows["mixing"])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(again, key=key) == sorted(tokens, key=key)


def test_pipeline_empty(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
