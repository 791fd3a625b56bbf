import random

import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor

from tessera.llm import queries
from tessera.llm.common import documents
from tessera.llm.token_counts import Stream, Transducer, counted

PATH = P.path("piece_bpe_32k.model")
PEER = SentencePieceProcessor(model_file=PATH)
MACHINE = Transducer(PATH)
BITS = [" ", "  ", "▁", "a", "e", "th", "in", "the", "\n", "1", "20", "é", "日", "😀", "\x00", "<s>", "</s>", "<unk>", "ing", "er", "aaaa", "zz", "▁▁▁", "\t", ".", "...", "--", "==", "\x85", "ß", "\U0010ffff", "́", "<0x0A>"]


def texts(seed=1):
    r = random.Random(seed)
    out = ["".join(r.choices(BITS, k=r.randint(0, 60))) for _ in range(1500)]
    out += [" " * k for k in range(60)] + ["a" * k for k in range(60)] + ["ab " + " " * k + "\n" for k in range(40)]
    return out + ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=200)) for _ in range(200)]


def test_tokens_that_tolerate_each_other_are_not_merged():
    r, n = random.Random(1), 0
    while n < 20_000:
        a, b = r.randrange(len(MACHINE.texts)), r.randrange(len(MACHINE.texts))
        if (MACHINE.last[a], MACHINE.letters[MACHINE.texts[b][0]]) in MACHINE.pairs:
            x, y, n = MACHINE.texts[a], MACHINE.texts[b], n + 1
            assert MACHINE._apart(a, b) == (MACHINE.merged(x + y) == [x, y])


@pytest.mark.parametrize(("lanes", "before", "size"), [(4096, 32, 1 << 22), (7, 0, 1 << 22), (1000, 1, 300), (64, 3, 70)])
def test_lanes_and_parts_give_the_library_s_counts(lanes, before, size):
    """Few characters before a lane make wrong guesses, so that lanes have maps of several states."""
    given = texts()
    assert Stream(MACHINE, lanes, before).of_texts(given, size).tolist() == [len(PEER.encode(t)) for t in given]


def test_machine_that_forgets():
    small = Transducer(PATH, states=300)
    given = texts(2)
    assert Stream(small, 50, 2).of_texts(given, 2000).tolist() == [len(PEER.encode(t)) for t in given]
    assert len(small.states) < 3000


def test_long_texts_without_white_space():
    r = random.Random(4)
    given = ["a" * 300_000, "".join(r.choices("abcdefgh", k=200_000)), "日本" * 50_000, " " * 100_000, "word " * 200_000, "=-" * 60_000]
    assert Stream(MACHINE).of_texts(given, 90_000).tolist() == [len(PEER.encode(t)) for t in given]


def test_on_spark(spark):
    rows = [(i, t, 1, "c") for i, t in enumerate(texts(3)[:300])] + [(1, None, 1, "c"), (None, "no id", 1, "c"), (7, "twice", 1, "c"), (7, "twice", 1, "c"), (8, "x y " * 5000, 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted((tuple(r) for r in counted(df, PATH, 4096).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(PEER.encode(t or "")), n > 4096) for i, t, _, _ in rows]
    assert got == sorted(want, key=str) and any(x[3] for x in got)
    assert counted(df.limit(0), PATH, 4096).count() == 0


def test_query_counts_every_document(spark):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: len(PEER.encode(r.text or "")) for r in documents(spark, folder).collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op13_token_counts(spark, folder).collect()} == want
