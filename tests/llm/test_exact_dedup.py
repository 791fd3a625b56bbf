import hashlib
import random
import string

import pytest

from tessera.llm.exact_dedup import groups, without_copies

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sample():
    r = random.Random(5)
    long = " ".join("".join(r.choices("abcdeÄé", k=5)) for _ in range(3000))
    rows = [(1, None), (2, ""), (3, "Abc"), (4, "aBC"), (5, "ÄBC"), (6, "äbc"), (7, long), (8, long.upper().replace("Ä", "Ä")), (9, long[:-1] + "x"), (10, long), (11, "x" * 9000), (12, "x" * 9000), (13, " "), (None, "abc"), (14, "q\nr"), (14, "q\nr")]
    return rows + [(100 + i, "hot") for i in range(50)]


@pytest.mark.parametrize("bits", [64, 2])
def test_groups_equal_brute_force(spark, bits):
    rows = sample()
    norm = [(i, (t or "").translate(LOWER)) for i, t in rows]
    members = {}
    for i, n in norm:
        members.setdefault(n, []).append(i)
    want = sorted(((i, max((x for x in members[n] if x is not None), default=None), len(members[n]), hashlib.sha256(n.encode()).hexdigest()) for i, n in norm), key=str)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, recipe string")
    got = groups(df, bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_rows_that_stay(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, recipe string")
    kept = without_copies(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == [2, 4, 5, 6, 8, 9, 10, 12, 13, 14, 149] or got == sorted({max((i for i, t in rows if i is not None and (t or "").translate(LOWER) == n), default=None) for n in {(t or "").translate(LOWER) for _, t in rows}})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert groups(df).count() == 0 and without_copies(df).count() == 0


def test_very_long_texts(spark):
    long = "word and another, " * 60_000
    rows = [(1, long), (2, long.upper()), (3, long + "x"), (4, "y" * 1_000_000), (5, "y" * 1_000_001)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
