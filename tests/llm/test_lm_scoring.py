import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.attention_lm import CLASSES, CONTEXT, SCORED, Attention, Room, Vocabulary, Windows
from tessera.llm.lm_scoring import _trained, base_scores, encoded, learned, scores, subword_counts, word_tables

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_windows_hold_each_target_once_after_what_precedes_it():
    v = Vocabulary(np.ones(50, np.int64))
    texts = [np.arange(n, dtype=np.uint32) % 50 for n in (1, SCORED, SCORED + 1, 3 * SCORED)]
    w = Windows(texts, v)
    for k, t in enumerate(texts):
        own = w.text == k
        assert w.targets[own][w.wanted[own]].tolist() == t.tolist()
    assert w.rows[0, CONTEXT] == v.start_row and w.rows[4, CONTEXT + 1] == v.row_of[0]
    assert not w.valid[4, :CONTEXT].any() and w.valid[5, :CONTEXT].all()


def test_scores_do_not_look_ahead_and_sum_to_one():
    r = np.random.default_rng(0)
    v = Vocabulary(r.integers(0, 100, 300))
    model = Attention.fresh(v.log_class)
    for n in model.parts:
        model.parts[n] = r.standard_normal(model.parts[n].shape).astype(np.float32)
    a = r.integers(0, 300, 60).astype(np.uint32)
    b = a.copy()
    b[40:] = r.integers(0, 300, 20)
    w = Windows([a, b], v)
    s = model.class_scores(w, v.class_of[w.targets])
    first, second = (s[w.text == k][w.wanted[w.text == k]] for k in (0, 1))
    assert np.allclose(first[:40], second[:40], atol=1e-4)
    everything = np.stack([model.class_scores(w, np.full(w.targets.shape, c)) for c in range(CLASSES)])
    assert np.allclose(np.exp(everything).sum(0), 1, atol=1e-3)
    assert np.allclose(np.bincount(v.class_of, np.exp(v.log_share), CLASSES)[np.unique(v.class_of)], 1, atol=1e-3)


def test_class_scores_equal_a_plain_forward_pass():
    r = np.random.default_rng(4)
    v = Vocabulary(r.integers(0, 100, 300))
    model = Attention.fresh(v.log_class)
    p = {n: r.standard_normal(x.shape) * 0.5 for n, x in model.parts.items()}
    model.parts = {n: x.astype(np.float32) for n, x in p.items()}
    ids = r.integers(0, 300, 3 * SCORED + 5)
    w = Windows([ids.astype(np.uint32)], v)
    got = model.class_scores(w, v.class_of[w.targets])[w.wanted]
    inputs = [v.start_row, *v.row_of[ids[:-1]]]
    for t in range(len(ids)):
        first = max(0, t // SCORED * SCORED - CONTEXT)
        offset = CONTEXT if t < SCORED else 0  # a text's first window has no context
        x = [p["E"][inputs[i]] + p["P"][i - first + offset] for i in range(first, t + 1)]
        scores = np.array([x[-1] @ p["Q"] @ (y @ p["K"]) / 4 for y in x])
        weights = np.exp(scores) / np.exp(scores).sum()
        z = (sum(a * (y @ p["V"]) for a, y in zip(weights, x, strict=True)) + x[-1]) @ p["O"] + p["b"]
        assert abs(got[t] - (z - np.log(np.exp(z).sum()))[v.class_of[ids[t]]]) < 1e-3


def test_training_moves_every_position():
    r = np.random.default_rng(5)
    v = Vocabulary(r.integers(1, 50, 200))
    w = Windows([r.integers(0, 200, 400).astype(np.uint32) for _ in range(20)], v)
    model = Attention.fresh(v.log_class)
    after = model.trained([w.rows, w.valid, w.wanted, v.class_of[w.targets].astype(np.int64)])
    assert (np.abs(after.parts["P"] - model.parts["P"]).max(1) > 1e-3).all()


def test_gradients():
    r = np.random.default_rng(1)
    v = Vocabulary(r.integers(1, 50, 200))
    model = Attention.fresh(v.log_class)
    w = Windows([r.integers(0, 200, 45).astype(np.uint32)], v)
    own = (w.rows, w.valid, w.wanted, v.class_of[w.targets].astype(np.int64))
    model.parts = {n: x.astype(np.float64) for n, x in model.parts.items()}
    g, _ = model.gradient(*own)
    for name in Attention.NAMES:
        flat, own_g = model.parts[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(own_g))[:3]:
            was, loss = flat[i], []
            for step in (1e-4, -1e-4):
                flat[i] = was + step
                loss.append(model.gradient(*own)[1])
            flat[i] = was
            assert abs((loss[0] - loss[1]) / 2e-4 - own_g[i]) < 1e-3 * max(1, abs(own_g[i])), name


def test_arrays_that_are_used_again_change_no_gradient():
    r = np.random.default_rng(7)
    v = Vocabulary(r.integers(1, 50, 200))
    model, room = Attention.fresh(v.log_class), Room()
    for n in (900, 45, 900, 1):
        w = Windows([r.integers(0, 200, n).astype(np.uint32) for _ in range(3)], v)
        own = (w.rows, w.valid, w.wanted, v.class_of[w.targets].astype(np.int64))
        (again, loss), (fresh, same) = model.gradient(*own, room), model.gradient(*own)
        assert loss == same and all((again[name] == fresh[name]).all() for name in Attention.NAMES)
    assert len(room.arrays) > 5 and all(len(x) <= 29 * 3 * SCORED for x in room.arrays.values())


def sample():
    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "Été", "x1"]
    follows = {w: r.sample(words, 2) for w in words}
    rows = []
    for i in range(400):
        w, out = r.choice(words), []
        for _ in range(r.choice([5, 60, 150])):
            out.append(w)
            w = r.choice(follows[w])
        rows.append((i, " ".join(out)))
    return [*rows, (1000, None), (1001, ""), (1002, "ÉTÉ Alpha\talpha\n"), (1002, "ÉTÉ Alpha\talpha\n"), (None, "alpha")]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def test_base_scores_equal_brute_force(spark):
    rows = sample()
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, counts int").repartition(3)
    for block_words in (40, 1_000_000):
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in base_scores(*word_tables(df, PATH, block_words)).collect())
        assert got == want


def test_model_beats_its_own_unigram_on_held_out_texts(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = scores(df, PATH, rounds=3).collect()
    assert len(got) == len(rows)
    counts = subword_counts(word_tables(df, PATH)[1])
    whole = Counter(x for i, t in rows if not held(i) for x in Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids)
    assert dict(zip(counts[0].id, counts[0].n, strict=True)) == whole and counts[1] == sum(not held(i) for i, _ in rows)
    by_id = {r.doc_id: r for r in got}
    out = [i for i, _ in rows[:400] if held(i)]
    language = learned(df.where("doc_id < 400"), PATH, *counts, rounds=0)
    language.model.parts["O"][:] = 0  # what is left are class shares, that is a unigram model
    unigram = language.score([dict(rows)[i] for i in out])[0].sum()
    assert sum(by_id[i].score for i in out) > 0.8 * unigram  # both are negative: at least a fifth better
    assert by_id[1000].score == by_id[1001].score < 0 and by_id[1000].n_ids == 1


def test_training_sees_every_window_of_whole_texts(spark):
    assert CONTEXT >= 16 and SCORED >= 32
    whole = Tokenizer.from_file(PATH)
    rows = [(i, "alpha beta gamma Été x1 " * n) for i, n in enumerate((0, 1, 7, 300, 4000))]
    texts = encoded(spark.createDataFrame(rows, "doc_id long, text string"), PATH).select("ids")
    v = Vocabulary(np.ones(whole.get_vocab_size() + 1, np.int64))
    got = texts.mapInPandas(_trained(v, Attention.fresh(v.log_class), 0), "slot int, weights binary, n long").toPandas()
    lengths = [len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows]
    assert max(lengths) > 20_000 and got.n.sum() == sum(-(-n // SCORED) for n in lengths)


def test_empty_table(spark):
    assert scores(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
