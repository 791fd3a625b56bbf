import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm.substring_dedup import FAN, _block_rows, kept_digests, remove_repeats


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sample():
    r = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 3, 34, 35, 36, 90, 300])))) for i in range(60)]
    passage = " ".join(r.choices(words, k=37))
    rows += [(100 + i, f"a{i} b {passage} c{i}") for i in range(30)]
    rows += [(200, f"{passage} x {passage}"), (201, None), (202, ""), (203, "same " * 80), (203, "same " * 80), (None, f"é\t{passage} z\n")]
    return rows


def test_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_words string, starts string")
    for params in ({}, {"block_words": 50, "window_target": 100}, {"window": 5, "block_words": 1}):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in kept_digests(df, **params).collect()), key=str)
        assert got == brute(rows, params.get("window", 35))


def test_two_exchanges_give_the_same(spark):
    rows = sample()
    want = brute(rows, 35)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for own in ({"window_target": 20, "block_words": 500, "fan": 7}, {"window_target": 20, "block_words": 2000, "gathered": 50, "fan": 2}):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in kept_digests(df, **own).collect()), key=str)
        assert got == want


def test_bytes_of_a_window_do_not_grow_with_the_buckets():
    r = np.random.default_rng(2)
    words = r.integers(0, 1 << 62, 1_500_000).astype(np.uint64)
    docs = [(k, k, 400) for k in range(3750)]
    size = lambda n: sum(len(x["hashes"]) + len(x["positions"]) + len(x["subs"] or b"") + 40 for x in _block_rows("0-0", docs, words, 35, n) if x["kind"] == "w") / (3750 * 366)
    few, many = size(5_000), size(166_000)
    assert many < 1.2 * few and sum(1 for _ in _block_rows("0-0", docs, words, 35, 10_000_000)) <= FAN + 1


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, long), (2, "x " + long[:400] + " y"), (3, "z")]
    got = sorted((r.doc_id, r.n_removed) for r in kept_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, n) for i, _, n, _ in brute(rows, 35)]


def test_empty_table_and_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert kept_digests(df).collect() == []
    df = spark.createDataFrame([(1, "a b c"), (2, "x a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_removed) for r in remove_repeats(df, window=3).collect()) == [(1, "", 3), (2, "x", 3)]
