"""What the first review found missing."""

import math
import random
from re import _parser

import numpy as np
import pytest

from lakestat.llm import license_rules, license_scan, pii, quality_classifier
from tests.llm.test_groups import brute_kneser_ney


def russian(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("вода река озеро камень мост берег синий гора девять семь под над было стало".split()) for _ in range(n))


def shuffled(text, seed):
    """The text with its letters dealt anew: words keep their lengths."""
    r = random.Random(seed)
    letters = [c for c in text if c != " "]
    r.shuffle(letters)
    return "".join(c if c == " " else letters.pop() for c in text)


def test_classify_tells_junk_in_any_script(spark):
    good = [(k, russian(60, k), "ru") for k in range(40)]
    junk = [(100 + k, shuffled(russian(60, 500 + k), k), "ru") for k in range(10)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_classifier.classify(df, df.where("doc_id < 30").select("doc_id")).collect()}
    assert all(kept[k] for k in range(30)) and not any(kept[100 + k] for k in range(10))


def test_perplexity_of_real_symbols(spark):
    """Against dictionaries over the characters themselves."""
    texts = [russian(20, k) + " Zü 12, 34 – «東京»" for k in range(6)]
    odd = [(50, "Zq#\nβ é 東 12", None), (51, "", "ru"), (52, None, "ru"), (None, "река 京", "ru")]
    df = spark.createDataFrame([(k, t, "ru") for k, t in enumerate(texts)] + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in quality_classifier.perplexities(df, quality_classifier.levels(df.where("doc_id < 6"))).collect()}
    assert len(got) == 10 and got[51] is None and got[52] is None
    p = brute_kneser_ney(texts, len(set("".join(texts))) + 1)
    for k, t in [*enumerate(texts), (50, odd[0][1]), (None, odd[3][1])]:
        s = [0] * 3 + [0 if c == " " else c for c in t]
        assert got[k] == pytest.approx(math.exp(-sum(math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / len(t)), rel=1e-6)


def test_grams_with_many_symbols():
    text = "".join(chr(0x4E00 + k) for k in range(20000)) + "".join(chr(0x20000 + k) for k in range(20000)) + "abcabc"
    grams = quality_classifier.Grams([text, "xyz"])
    code, n = grams.distinct()
    assert grams.pairs is not None
    want = {}
    for t in (text, "xyz"):
        for i in range(len(t)):
            g = ("   " + t)[i : i + 4]
            want[g] = want.get(g, 0) + 1
    assert dict(zip(grams.spelled(code).to_pylist(), n.tolist(), strict=True)) == want


SPELLED = {
    "GNU GPL v3": "gpl-3", "GNU General Public License v3.0": "gpl-3", "GNU General Public Licence version 2": "gpl-2", "Mozilla Public License v2": "mpl-2",
    "GNU Lesser General Public License v2.1": "lgpl-2.1", "GNU Affero General Public License v3": "agpl-3", "Apache License v2.0": "apache-2", "ASL 2.0": "apache-2",
    "Creative Commons Attribution-Noncommercial-Share Alike": "cc-by-nc-sa", "Creative Commons Attribution Non-Commercial ShareAlike": "cc-by-nc-sa",
    "Creative Commons Attribution-No Derivs": "cc-by-nd", "Creative Commons Attribution-NoDerivs": "cc-by-nd", "three-clause BSD": "bsd-3-clause", "free type licence": "ftl",
    "Neither the name of " + "the very long institute " * 9 + "nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
}


def test_license_gates(spark):
    """scan() against the same rules without gates, on ordinary spellings and on spellings of every rule."""
    rules = license_scan.all_rules()
    texts = list(SPELLED) + [s.replace("\0", "7") for line in license_rules.PATTERNS.strip().splitlines() for s in sorted(license_rules._spellings(_parser.parse(line.split(" | ", 2)[2])))[:40]]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        padded = b" " + b" ".join(license_scan.words_of(r.text.encode())) + b" "
        want = [rule.label for _, _, rule in license_scan.detect(padded, rules)]
        assert [d.label for d in r.detections] == want, r.text
        assert r.text not in SPELLED or SPELLED[r.text] in r.labels.split(",")


@pytest.mark.parametrize("text", ["4111 1111 1111 1111 then 4111 1111 1111 1111", "+49 30 123 4567 or 49 30 123 4567", "10.0.0.1 and (10.0.0.1)", "+49301234567 or 30 123 4567"])
def test_pii_grouped_and_short_numbers_share_edges(text):
    nodes = pii.nodes_of(text)
    tied = {(text[nodes[i][0] : nodes[i][1]], text[nodes[j][0] : nodes[j][1]]) for i, j, sort in pii.graph_of(nodes)[0] if sort == 1}
    assert tied and all(pii._NOT_DIGIT.sub("", a).endswith(pii._NOT_DIGIT.sub("", b)) for a, b in tied)


def test_pii_evidence_reaches_far():
    """The hundredth mention follows the first."""
    nodes = pii.nodes_of("10.0.0.1 is " * 100)
    edges, hubs = pii.graph_of(nodes)
    unary = np.zeros((len(nodes) + hubs, len(pii.LABELS)))
    unary[0, 2] = 9.0
    potentials = np.zeros((2, len(pii.LABELS), len(pii.LABELS)))
    potentials[1] = 9 * np.eye(len(pii.LABELS))
    assert (pii.marginals(unary, np.array(edges), potentials)[: len(nodes), 2] > 0.9).all()
    chain = np.array([(k, k + 1, 1) for k in range(40)])
    assert pii.marginals(unary[:41], chain, potentials)[40, 2] > 0.9
