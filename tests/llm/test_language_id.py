import random

import numpy as np

from tessera.llm.language_id import TEMPER, documents_rows, identified, in_a_language, pages_rows, trigrams

LETTERS = {"en": "thearedonsi", "fr": "éèuxlaqeroi", "de": "schäßungtzw"}
SCHEMA = "doc_id long, text string, declared string, suffix string, host string"


def prose(r, lang, words):
    return " ".join("".join(r.choices(LETTERS[lang], k=r.randint(2, 7))) for _ in range(words))


def test_trigrams_of_a_batch_equal_those_of_each_text():
    texts = ["", "a", "Ab-cd 12 é", "x\0y", "日本語", " \n", "abc abc"]
    grams, counts = trigrams(texts)
    each = [trigrams([t]) for t in texts]
    assert counts.tolist() == [len(g) for g, _ in each]
    assert grams.tolist() == np.concatenate([g for g, _ in each]).tolist()
    assert counts[0] == counts[5] == 0 and len(set(trigrams(["abc abc"])[0].tolist())) == 3


def test_text_wins_over_wrong_declarations_and_priors_decide_short_texts(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, prose(r, lang, 60), lang if i % 10 else "en-GB", {"en": "com", "fr": "fr", "de": "de"}[lang], f"{lang}.example.{lang}"))
    rows += [(1000, prose(r, "fr", 60), "en", "com", "en.example.en"), (1001, "", "fr", "fr", None), (1002, None, None, None, None), (1003, "a", None, "de", "de.example.de"), (1004, "a", None, None, "fr.example.fr")]
    rows += [(1005, "12 34", "en", None, None), (None, prose(r, "de", 30), "??", None, "new.host")]
    got = {x.doc_id: x for x in identified(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert all(got[i].lang == got[i].text_lang == ("en", "fr", "de")[i % 3] and got[i].accepted for i in range(600))
    assert got[1000].lang == "fr" and got[1003].lang == "de" and got[1004].lang == "fr" and got[None].lang == "de"
    assert not any(got[i].accepted for i in (1001, 1002, 1005)) and got[1001].text_lang is None
    assert all(0 < x.probability <= 1 for x in got.values())


def test_texts_in_none_of_the_languages_are_rejected_and_short_clean_ones_stay(spark):
    r = random.Random(3)
    rows = [(i, prose(r, ("en", "fr", "de")[i % 3], 60), ("en", "fr", "de")[i % 3], None, "h.a.s") for i in range(600)]
    junk = [(2000 + i, " ".join("".join(r.choices("qxvkjwpfym", k=5)) for _ in range(30)), ("en", None)[i % 2], None, "h.a.s") for i in range(10)]
    undeclared = [(3000 + i, " ".join("".join(r.choices("ουςαιτενρσκπμλ", k=6)) for _ in range(40)), ("fr", None)[i % 2], None, "h.a.s") for i in range(10)]
    short = [(4000 + i, prose(r, "en", k), "en", None, "h.a.s") for i, k in enumerate((1, 1, 2, 2, 3, 4, 5))]
    got = {x.doc_id: x for x in identified(spark.createDataFrame(rows + junk + undeclared + short, SCHEMA), ["doc_id"]).collect()}
    assert not any(got[i].accepted for i, *_ in junk + undeclared)
    assert all(got[i].accepted for i, *_ in rows) and all(got[i].accepted and got[i].lang == "en" for i, *_ in short)


def test_rare_declarations_share_a_model(spark):
    r = random.Random(4)
    rows = [(i, prose(r, ("en", "fr")[i % 2], 40), ("en", "fr")[i % 2], None, None) for i in range(1200)]
    rows += [(5000, prose(r, "de", 40), "de", None, None), (5001, prose(r, "de", 40), None, None, None), (5003, "a " * 2_000_000, "en", None, None)]
    own = {x.doc_id: x for x in identified(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert own[5000].lang == own[5000].text_lang == "de" and own[5000].accepted  # one row of 1,203 has a model
    got = {x.doc_id: x for x in identified(spark.createDataFrame(rows, SCHEMA), ["doc_id"], languages=2).collect()}
    assert got[5000].lang == "de" and got[5000].accepted and got[5000].declared == "de" and got[5000].text_lang is None
    assert got[5003].lang == "en" and got[5003].accepted
    assert got[5001].lang is None and not got[5001].accepted


def test_posterior_equals_a_plain_computation(spark):
    rows = [(0, "aa", "xx", "com", "h.a.s"), (1, "aa", "xx", None, "h.a.s"), (2, "bb", "yy", "com", "g.a.s"), (3, "ab", None, "com", "h.a.s")]
    got = {x.doc_id: x for x in identified(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    grams = {t: trigrams([t])[0] for t in ("aa", "bb", "ab")}
    counts = {"xx": np.ones(1 << 14), "yy": np.ones(1 << 14)}
    for _, t, d, _, _ in rows[:3]:
        np.add.at(counts[d], grams[t], 1)
    text = np.array([TEMPER * np.log(c / c.sum())[grams["ab"]].sum() for c in counts.values()])
    vote = int(text.argmax())  # votes: rows 0 and 1 xx, row 2 yy, row 3 its own
    votes = np.array([2.0, 1.0]) + np.eye(2)[vote]
    prior = (votes + 1) / (votes.sum() + 2)
    site = (np.array([2.0, 1.0]) + 10 * prior) / (3 + 10)
    host = (np.array([2.0, 0.0]) + 10 * site) / (2 + 10)
    com = np.array([1.0, 1.0]) + np.eye(2)[vote]
    suffix = (com + 1) / (com + 2)
    post = np.exp(text) * host * suffix
    assert abs(got[3].probability - post.max() / post.sum()) < 1e-5


def test_nothing_declared_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", None, "de", "x.de")], SCHEMA)
    assert identified(df, ["doc_id"]).first().accepted is False
    assert identified(df.limit(0), ["doc_id"]).count() == 0


def test_stage_keeps_columns_and_rows(spark):
    r = random.Random(2)
    rows = [(i, prose(r, "en", 20), "en", "s", 1, "x") for i in range(20)] + [(30, None, "en", "s", 0, "x"), (31, "abc de", None, None, 6, "x"), (32, "twice the", "en", "s", 9, "x"), (32, "twice the", "en", "s", 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host string")
    kept = in_a_language(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [*range(20), 31, 32, 32]
    assert documents_rows(df).count() == 24


def test_evidence_of_pages(spark):
    pages = spark.createDataFrame([(1, "https://user@www.Site.example.de:80/a?b", "<!DOCTYPE html><html class=x lang='de-AT'><script>var x='</p>'</script><p>Guten&nbsp;Tag</p><!-- no --></html>"), (2, None, None)], "page_id long, url string, html string")
    got = {x.page_id: x for x in pages_rows(pages).collect()}
    assert got[1].text.split() == ["Guten", "Tag"] and (got[1].declared, got[1].suffix, got[1].host) == ("de-AT", "de", "www.Site.example.de")
    assert got[2].host is None and got[2].text == ""
