import string
import zlib
from hashlib import sha256

import pytest

from tessera.llm.merkle_manifest import audited, leaves

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest(s):
    return sha256(s.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    out = []
    for nodes in tree[:-1]:
        lo = i // 8 * 8
        out.append((nodes[lo:i], nodes[i + 1 : lo + 8]))
        i //= 8
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in groups[k]])
    upper = levels([trees[k][-1][0] for k in order]) if order else []
    out = []
    for n, k in enumerate(order):
        for i, row in enumerate(groups[k]):
            steps = way(trees[k], i) + way(upper, n)
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf((*row[:4], row[4] and row[4].translate(LOWER)))
            for left, right in steps:
                node = digest("".join([*left, node, *right]))
            root = upper[-1][0]
            out.append((row[0], leaf(row), trees[k][-1][0], root, digest("".join("".join(a + b) for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def rows(n, langs):
    out = [(i * 7 % n, f"s{i % 5}" if i % 11 else None, langs[i * i % len(langs)], i if i % 13 else None, ["Some Text", "plain", None, "", "Ä É mixed A", "x" * i][i % 6]) for i in range(n)]
    return out + [(None, None, None, None, None), (None, "s", langs[0], 1, "No Id"), (3, "s", langs[0], 1, "Twice"), (3, "s", langs[0], 1, "Twice"), (3, "t", langs[0], 1, "Tie")]


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (8, ["en"]), (9, ["en", "de"]), (700, ["en", "en", "en", "é", "z", "", None]), (1300, [f"l{i}" for i in range(90)])])
def test_equals_brute_force(spark, n, langs):
    given = rows(n, langs)
    df = spark.createDataFrame([(*r, "c", 1) for r in given], SCHEMA)
    got = sorted((tuple(r) for r in audited(leaves(df)).collect()), key=str)
    assert got == brute(given)


def test_many_levels_of_blocks(spark):
    """Blocks of eight nodes: three levels of blocks in a group, two above the groups."""
    given = rows(400, [f"l{i}" for i in range(40)] + ["hot"] * 40)
    got = sorted((tuple(r) for r in audited(leaves(spark.createDataFrame([(*r, "c", 1) for r in given], SCHEMA)), depth=1).collect()), key=str)
    assert got == brute(given)


def test_one_row_is_its_own_root_and_no_rows_have_none(spark):
    df = spark.createDataFrame([(5, "s", "en", 1, "A", "c", 1)], SCHEMA)
    (r,) = audited(leaves(df)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == digest("") and r.verified == (r.folded_root == r.root)
    assert audited(leaves(df.limit(0))).count() == 0


def test_long_texts_and_ties(spark):
    given = [(1, "s", "en", 1, "Long " * 400_000), (1, "s", "en", 1, "Long " * 400_000), (1, "s", "en", 2, "Q")]
    got = sorted((tuple(r) for r in audited(leaves(spark.createDataFrame([(*r, "c", 1) for r in given], SCHEMA))).collect()), key=str)
    assert got == brute(given)
