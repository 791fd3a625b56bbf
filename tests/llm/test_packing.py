import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import Schedule, packed, phases, share
from tessera.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(3)
    words = ["the", "Déjà", "été's", "can't", "x1y22", "a-b", "…", "ΟΔΟΣ", "é́", "日本語", "a\xa0b", "Ǆ", "ﬁ", "İx", "́z", "a\x0bb", "q\x0cr", "\x1c", "\x85w"]
    return [None, "", " ", "\t\n a \r\n b  "] + ["".join(r.choice(words) + r.choice([" ", "\n", "\t", "  ", "\r"]) for _ in range(r.randint(1, 300))) for _ in range(80)] + ["z" * 5000]


def test_pieces_encode_as_whole_texts():
    whole, encoder = Tokenizer.from_file(PATH), PieceEncoder(PATH)
    for t, ids in zip(texts(), encoder.encode(texts()), strict=True):
        assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_added_tokens_in_texts_encode_as_the_tokenizer_does():
    whole, encoder = Tokenizer.from_file(PATH), PieceEncoder(PATH)
    own = ["a <|endoftext|> b", "x<|startoftext|>y", "日本 <|endoftext|> é", "<|ENDOFTEXT|> c", "<|endoftext|><|endoftext|>\n", "<| endoftext |>", "plain"]
    for t, ids in zip(own, encoder.encode(own), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids
    assert encoder.encode(own)[0].tolist() == [320, 49407, 321]


def test_schedule_equals_slot_by_slot_deficits():
    totals = [7, 1, 0, 50, 23]
    schedule = Schedule([totals])
    slots = np.arange(sum(totals) + 1)
    got = np.stack([schedule.served(slots, s)[1] for s in range(5)])
    assert got.sum(0).tolist() == slots.tolist() and got[:, -1].tolist() == totals
    assert (np.diff(got, axis=1) >= 0).all()
    assert np.abs(got - np.outer(totals, slots) / sum(totals)).max() < 2.5


def test_shares_are_exact_where_products_exceed_64_bits():
    r = random.Random(4)
    for bits in (8, 33, 40, 49):
        for _ in range(200):
            rest = r.randrange(1, 1 << bits)
            c = r.choice([r.randint(1, rest), rest, 1, max(1, rest - 1)])
            slots = [0, rest, *(r.randint(0, rest) for _ in range(20)), *(-(-k * rest // c) - d for k in r.sample(range(c + 1), min(5, c)) for d in (0, 1) if 0 <= -(-k * rest // c) - d <= rest)]
            assert share(np.array(slots, np.int64), c, rest).tolist() == [x * c // rest for x in slots]


def test_schedule_beyond_2_to_the_33():
    totals = [3 << 33, (1 << 31) + 7, 5, (1 << 34) + 11]
    schedule, r = Schedule([totals]), random.Random(5)
    slots = [0, sum(totals), *(r.randrange(sum(totals)) for _ in range(50))]
    got = np.stack([schedule.served(np.array(slots, np.int64), s)[1] for s in range(4)])
    assert got.sum(0).tolist() == slots
    for k, y in enumerate(slots):
        left, rest = y, sum(totals)
        for s, c in enumerate(totals):
            own = int(Fraction(left * c, rest))
            assert got[s, k] == own
            left, rest = left - own, rest - c
    token = np.array([totals[3] // 3], np.int64)
    first = int(schedule.first_window(token, 3, 2048)[0])
    assert schedule.served(np.array([first * 2048, (first + 1) * 2048]), 3)[1].tolist()[0] <= token[0] < schedule.served(np.array([(first + 1) * 2048]), 3)[1][0]


def test_phases_use_up_every_source():
    parts = phases([100, 10, 40], [Fraction(1), Fraction(1), Fraction(2)])
    assert np.sum(parts, axis=0).tolist() == [100, 10, 40] and parts[0] == [10, 10, 20]


@pytest.mark.parametrize(("targets", "queues"), [(None, 192), ({"s0": 0.5, "s1": 0.25}, 192), (None, 1)])
def test_every_id_lies_in_one_piece(spark, targets, queues):
    rows = [(i, t, f"s{min(i % 7, 3)}" if i % 11 else None, 0) for i, t in enumerate(texts() * 2)] + [(500, "again", "s1", 0), (500, "again", "s1", 0), (None, "none", "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    got = packed(df, PATH, targets, window=64, most_queues=queues).toPandas()
    whole = Tokenizer.from_file(PATH)
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, _, _ in rows}
    for r in got.itertuples():
        own = ids[None if np.isnan(r.doc_id) else int(r.doc_id)]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    total = sum(len(ids[i]) for i, *_ in rows)
    assert got.length.sum() == total and got.sequence_id.nunique() == -(-total // 64)
    for doc, own in got[~got.doc_id.isin([500])].groupby("doc_id"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == own.doc_tokens.iloc[0]
    for seq, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and (own.length.sum() == 64 or seq == got.sequence_id.max())
    if targets is None and queues > 4:
        shares = got.groupby("source").length.sum() / total * 64
        full = got[got.sequence_id < got.sequence_id.max()].groupby(["source", "sequence_id"]).length.sum().unstack(fill_value=0)
        assert (full.sub(shares, axis=0).abs() < 4).all().all()


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string, source string"), PATH).count() == 0
