"""Operators 2, 4 and 6: brute force and held-out accuracy."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from concord.llm import langid, quality_rules, weak_quality
from concord.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    cover = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_rules_of_odd_rows(docs_of, odd_rows):
    rows = odd_rows + [(77, "a b a b a b"), (78, "x\nx\n\n \n \nx y\n"), (79, "a\x0bb\x0cc\x1cd")]
    got = quality_rules.judge(docs_of(rows)).collect()
    want = sorted(((d, *counts(t)) for d, t in rows), key=key)
    assert sorted((tuple(r[:7]) for r in got), key=key) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.judge(docs_of([])).count() == 0


def test_verdicts_do_not_depend_on_the_order():
    texts = ["", None, "word " * 60, "a% b# " * 60, " ".join(map(str, range(200))), "The cat sat on it. " + " ".join(f"w{i}x" for i in range(99))]
    for t in texts:
        verdicts = {all(not r.rejects(quality_rules.Text(t)) for r in rules) for rules in (quality_rules.RULES, quality_rules.RULES[::-1])}
        assert len(verdicts) == 1
    order = quality_rules.order_rules(texts)
    gains = [rejected / max(cost, 1e-9) for _, cost, rejected in order]
    assert gains == sorted(gains, reverse=True)


@pytest.fixture(scope="module")
def labelled(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return {d: labels[d] for d in labels}


def test_rules_query(spark, labelled):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_quality_rules"](spark, SF).collect()
    assert sorted((tuple(r[:7]) for r in got), key=key) == sorted(((d, *counts(t)) for d, t in rows), key=key)
    judged = [(labelled[r.doc_id], r.kept) for r in got if r.doc_id in labelled and not r.base_failed]
    assert all(kept for good, kept in judged if good) and not any(kept for good, kept in judged if not good)


def test_quality_against_labels(spark, labelled):
    got = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    good = [got[d].kept for d, q in labelled.items() if q]
    bad = [got[d].kept for d, q in labelled.items() if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_quality_of_odd_rows(docs_of, odd_rows):
    got = weak_quality.classify(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert weak_quality.classify(docs_of([])).count() == 0


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(6)
    n = len(weak_quality.LABELLERS)
    good = rng.random(40_000) < 0.8
    recall = np.linspace(0.3, 0.9, n)
    bad_vote = np.where(good[:, None], rng.random((len(good), n)) < 0.005, rng.random((len(good), n)) < recall)
    silent = rng.random((len(good), n)) < 0.2
    v = np.where(silent, 0, np.where(bad_vote, weak_quality.BAD, weak_quality.GOOD))
    codes, inv, count = np.unique((v * 3 ** np.arange(n - 1, -1, -1)).sum(1), return_inverse=True, return_counts=True)
    posterior, rates = weak_quality.expectation_maximisation(codes, count.astype(float))
    assert np.abs(rates[0] - recall).max() < 0.03 and rates[1].max() < 0.01
    assert ((posterior[inv] > 0.5) == good).mean() > 0.99


def test_language_query(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred in {*lang.values(), "und"}
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.98


def test_language_of_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    model = langid.train(docs)
    got = langid.predict(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if letters else "und") and (letters or r.score == 0)
    empty = langid.train(docs.where("doc_id = -99"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs_of([]), model).count() == 0


def test_filter_returns_all_owners_and_few_others():
    rng = np.random.default_rng(7)
    owned = {f"l{i}": np.unique(rng.integers(0, 2**60, 2000)) for i in range(11)}
    owned["l3"] = np.union1d(owned["l3"], owned["l9"][:500])
    model = langid.LanguageFilter.build(owned)
    for name, grams in owned.items():
        k = model.languages.index(name)
        masks = None
        for at in langid._spread(grams, model.bits):
            masks = model.rows[at] if masks is None else masks & model.rows[at]
        assert ((masks[:, k >> 3] >> (k & 7)) & 1).all()
    assert model.false_rate.max() < 0.05


def test_trigrams_are_the_letters_in_context():
    keys, owner = langid.trigrams(["Ab, c", None, "ñ", "", "12"])
    unpack = lambda k: "".join(chr(c) if c else "_" for c in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))
    assert [unpack(int(k)) for k in keys] == ["_ab", "ab_", "_c_", "_ñ_"] and owner.tolist() == [0, 0, 0, 2]
