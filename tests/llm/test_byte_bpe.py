import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from tessera.llm.byte_bpe import ByteBPE, RankQueue, decoded, encoded, round_trips

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PEER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    r = random.Random(2)
    bits = ["the", "ing", "Über", "été", "日本語", "😀", "  ", "\n", "12345", "'s", "!!", "aaaa", "\x00", "é́", "　", "zqx"]
    out = [None, "", " ", "<|endoftext|>", "a" * 3000, "ab" * 2500, "".join(r.choices("abcdefgh", k=6000))]
    return out + ["".join(r.choice(bits) + r.choice(["", " ", ""]) for _ in range(r.randint(1, 200))) for _ in range(150)]


def test_queue_gives_ranks_then_positions_in_order():
    r, q = random.Random(1), RankQueue(3000)
    entries = [(r.randrange(3000), r.randrange(50)) for _ in range(2000)]
    for e in entries:
        q.push(*e)
    assert [q.pop() for _ in entries] == sorted(entries) and not q.top


def test_ids_equal_another_library():
    bpe = ByteBPE(RANKS, P.PATTERN)
    for t in texts():
        assert bpe.encode(t or "") == PEER.encode_ordinary(t or "")


def test_merges_that_make_lower_ranks_come_first():
    ranks = {bytes([b]): 10 + b for b in range(256)} | {b"ab": 5, b"abc": 1, b"bc": 6, b"cd": 0}
    peer = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    bpe = ByteBPE(ranks, r"\S+")
    r = random.Random(4)
    for _ in range(300):
        t = "".join(r.choices("abcd", k=r.randint(1, 30)))
        assert bpe.encode(t) == peer.encode_ordinary(t)


def test_round_trips_on_spark(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(7, "twice", 1), (7, "twice", 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(str, (tuple(x) for x in round_trips(df, PATH, P.PATTERN).collect())))
    want = []
    for i, t, _ in rows:
        ids = PEER.encode_ordinary(t or "")
        want.append(str((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(want)
    back = decoded(encoded(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert round_trips(df.limit(0), PATH, P.PATTERN).count() == 0
