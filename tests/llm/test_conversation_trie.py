import random
import re
import zlib
from hashlib import sha256

import pytest

from tessera.llm.conversation_trie import nodes
from tessera.llm.list_ranking import prefix_sums

SCHEMA = "conv_id long, turn long, role string, text string, depth int, ident string, slice long"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()))
    told = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        told[c] = tuple((r, t) for _, r, t in own.get(first, [])[:h] + own[c][h:])
    members = {}
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if told[c] == prefix)
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(convs), len(prefix), parent, len(convs), len(kids), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed, n, longest):
    r, rows = random.Random(seed), []
    for c in r.sample(range(-30, 10 * n), n):
        for t in range(r.randint(1, longest)):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "bot", None, ""]), r.choice([None, "", "a b", "a\tb", "x", "\x85 y\x0bz ", "Ä ö"]) if r.random() < 0.7 else f"own {r.random()}"))
    rows += [(7, 0, "user", "twice"), (7, 0, "user", "twice"), (7, 0, "bot", "tie"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize(("seed", "n", "longest", "size", "walked"), [(1, 60, 6, 4096, 1 << 14), (2, 40, 9, 3, 20), (3, 3, 60, 8, 4)])
def test_equals_brute_force(spark, seed, n, longest, size, walked):
    rows = sample(seed, n, longest)
    df = spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SCHEMA)
    got = sorted((tuple(r) for r in nodes(df, size, walked).collect()), key=str)
    assert got == brute(rows)


def test_many_equal_conversations_and_a_very_long_one(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(3)] + [(10_000, t, "bot", "word " * (t % 3)) for t in range(300)] + [(20_001, 0, "user", "long " * 300_000)]
    got = sorted((tuple(r) for r in nodes(spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SCHEMA), 16, 64).collect()), key=str)
    assert got == brute(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    c = next(i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 4 == 3 and i % 20)
    rows = [(c, 0, "user", "goes"), (c, 1, "bot", "too")]
    (r,) = nodes(spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SCHEMA)).collect()
    assert tuple(r) == (c, 0, None, 1, 0, 1, 0, sha256(str(c).encode()).hexdigest())
    assert nodes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_prefix_sums_of_a_shuffled_list(spark, n):
    order = [f"x{i}" for i in random.Random(n).sample(range(n), n)]
    rows = [(a, order[i - 1] if i else None, order[i + 1] if i + 1 < n else None, i, 1) for i, a in enumerate(order)]
    df = spark.createDataFrame(random.Random(1).sample(rows, n), "arc string, prev string, next string, w long, one long")
    got = {r.arc: (r.w, r.one) for r in prefix_sums(df, ["w", "one"], walked=7).collect()} if n > 3 else {r.arc: (r.w, r.one) for r in prefix_sums(df, ["w", "one"]).collect()}
    assert got == {a: (i * (i + 1) // 2, i + 1) for i, a in enumerate(order)}
