import random
import zlib

import numpy as np
import pandas as pd

from tessera.llm.toxicity import LabelModel, Numbers, Places, Votes, features_of, fit_linear, held_out_scores, learned, number, scored, words_of


def test_label_model_finds_accuracies_without_labels_and_discounts_twins():
    r = np.random.default_rng(5)
    y = r.random(20_000) < 0.3
    right = [0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(r.random(len(y)) < 0.2, 0, np.where(r.random(len(y)) < a, y, ~y) * 2 - 1) for a in right], 1)
    votes = np.column_stack([votes, votes[:, 3], votes[:, 3]])  # voters that copy the weakest
    unique, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel(unique, counts.astype(float), np.full(len(unique), -1))
    accuracy = ((model.posterior(votes) > 0.5) == y).mean()
    assert accuracy > 0.85 and model.correlations[3, 4] > 0.9 and model.weights[3] < 0.5 < model.weights[0]
    table = np.exp(model.log)
    share = table[1, 2] / (table[1, 2] + table[1, 0])
    assert share[0] > share[2] > share[3]


def test_linear_fit():
    w, b = fit_linear([np.array([0, 1]), np.array([1]), np.array([], int)] * 20, np.array([1.0, 0.0, 0.0] * 20), 2)
    assert w[0] + w[1] + b > 1 and w[1] + b < -1 and b < -1


def test_features_and_votes():
    assert features_of("Idiots! x2 été") == {"idiots", "4:idio", "5:idiot", "été", "x"}
    assert features_of(None) == features_of("") == set()
    table = np.sort(np.array([number("4:abcd"), number("zz")], np.uint64))
    mined = np.array([0, 1])[np.argsort([number("4:abcd"), number("zz")])]
    vote = lambda text: Votes(mined).of(text, words_of(text), Places(table).of(words_of(text)))
    assert vote("you are such an idiot") == [1, 0, 0, 0, 0, 0, 0, 1, 0, 0]
    assert vote("abcde")[3:7] == [1, 0, 0, 0] and vote("zz abcde")[3:7] == [1, 1, 0, 0] and vote(None)[-1] == -1
    assert sorted(Numbers().of(words_of("Abcde x")).tolist()) == sorted(number(f) for f in features_of("Abcde x"))


def test_address_takes_plurals():
    nothing = np.zeros(0, np.int64)
    assert Votes(nothing).of("You are such idiots", words_of("You are such idiots"), [])[7] == 1
    assert Votes(nothing).of("your idiots", words_of("your idiots"), [])[7] == 0


def test_lexicons_are_mined_from_all_labels_beyond_the_sample(spark):
    docs = [(i, f"plain words of row {'grubnax' if i % 100 == 0 else 'here'}") for i in range(1200)]
    labels = [(i, int(i % 100 == 0)) for i in range(1200)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    small, whole = learned(d, lab, sample=100), learned(d, lab)
    assert number("grubnax") in small.lexicon and (small.lexicon == whole.lexicon).all() and (small.mined == whole.mined).all()
    assert np.allclose(small.labels.log, whole.labels.log) and small.labels.prior == whole.labels.prior


def test_the_label_model_s_accuracies_make_the_scores(spark):
    docs, labels = sample()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, votes int"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def shuffled(model):
        model.log = model.log[::-1].copy()
        return model

    plain = {r.doc_id: r.score for r in scored(d, learned(d, lab)).collect()}
    other = {r.doc_id: r.score for r in scored(d, learned(d, lab, relabel=shuffled)).collect()}
    assert np.mean([abs(plain[i] - other[i]) for i in range(1500)]) > 0.3


def test_given_labels_reach_the_classifier_by_way_of_accuracies_alone(spark):
    """A label that contradicts what all voters say of a document moves no score by itself: most labels of 'scum' say toxic."""
    docs = [(i, f"word{i % 7} other{i % 11} {'idiot scum' if i % 4 == 0 else 'fine'}") for i in range(800)]
    labels = [(i, int(i % 4 == 0)) for i in range(800)]
    flipped = [(i, 1 - y if i in (4, 5) else y) for i, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (scored(d, learned(d, spark.createDataFrame(x, "doc_id long, toxic int"))).collect() for x in (labels, flipped))
    assert all(abs(x.score - y.score) < 0.05 for x, y in zip(sorted(a), sorted(b), strict=True)) and {r.predicted for r in b if r.doc_id in (4, 5)} == {0, 1}


def test_without_labels_the_classifier_learns_from_posteriors(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(100)]
    docs = [(i, " ".join(r.choices(words, k=20) + (["zorgly", *(w for w in ("idiot", "scum", "disgusting", "you idiot") if r.random() < 0.6)] if i % 6 == 0 else []))) for i in range(900)]
    d = spark.createDataFrame([*docs, (5000, "zorgly"), (5001, words[0])], "doc_id long, text string")
    model = learned(d, spark.createDataFrame([], "doc_id long, toxic int"))
    score = {x.doc_id: x.score for x in scored(d, model).collect()}
    assert not len(model.lexicon) and score[5000] > 1.5 * score[5001]  # a word that no voter knows
    assert np.mean([score[i] for i, _ in docs if i % 6 == 0]) > 0.5 > 5 * np.mean([score[i] for i, _ in docs if i % 6])


def sample():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    bad = ["zorg", "blivet", "idiot", "scum"]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        own = r.choices(words, k=40) + (r.sample(bad, 2) if toxic else [])
        docs.append((i, " ".join(r.sample(own, len(own))), i))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return [*docs, (2000, None, 0), (2001, "", 0), (2002, "you idiot", 0), (2002, "you idiot", 0), (None, "scum", 0)], [*labels, (None, 1), (5, None), (6, 0)]


def test_held_out_accuracy(spark):
    docs, labels = sample()
    rows = held_out_scores(spark.createDataFrame(docs, "doc_id long, text string, votes int"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.98
    assert {r.score for r in rows if r.doc_id == 2000} == {r.score for r in rows if r.doc_id == 2001}


def test_partitions_without_labelled_rows_and_one_file_in_one_row_group(spark, tmp_path):
    docs, labels = sample()
    pd.DataFrame({"doc_id": [d[0] for d in docs[:1500]], "text": [d[1] for d in docs[:1500]]}).to_parquet(tmp_path / "docs.parquet", row_group_size=1500)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    want = sorted((r.doc_id, round(r.score, 6)) for r in held_out_scores(spark.createDataFrame(docs[:1500], "doc_id long, text string, n int"), lab).collect())
    for d in (spark.read.parquet(str(tmp_path / "docs.parquet")), spark.createDataFrame(docs[:1500], "doc_id long, text string, n int").repartition(50)):
        assert sorted((r.doc_id, round(r.score, 6)) for r in held_out_scores(d, lab).collect()) == want
    few = spark.createDataFrame(docs[:10], "doc_id long, text string, n int").repartition(50)
    assert held_out_scores(few, lab.where("doc_id < 3")).count() == 10


def test_very_long_and_scriptless_texts(spark):
    docs, labels = sample()
    long = [(7001, "zorg blivet " * 200_000, 0), (7002, "a" * 1_000_000, 0), (7003, "\U0001f600 1 2 3", 0)]
    got = {r.doc_id: r.score for r in held_out_scores(spark.createDataFrame(docs + long, "doc_id long, text string, n int"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[7001] > 0.5 and got[7003] == got[2001]


def test_empty_tables(spark):
    docs, labels = sample()
    d, lab = spark.createDataFrame(docs[:40], "doc_id long, text string, votes int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert held_out_scores(d.limit(0), lab).count() == 0
    assert held_out_scores(d, lab.limit(0)).count() == 40
