import random

from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.ngram_join import _gram_sets, agreement_for, bands_for, classes, link_counts, near_pairs, one_of_each


def grams(text, n=5):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    """class of each doc_id by all pairs."""
    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i, _ in rows}


def sample():
    r = random.Random(9)
    words = [f"w{k}" for k in range(900)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 5, 20, 120])))) for i in range(40)]
    for family in range(6):
        seed, size = r.choices(words, k=150), 12
        for m in range(size):
            own = list(seed)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((100 + 50 * family + m, " ".join(own)))
        for m in range(6):  # half alike: in some buckets, never linked
            rows.append((100 + 50 * family + 20 + m, " ".join(seed[: 75 + 5 * m] + r.choices(words, k=75))))
    chain = r.choices(words, k=200)
    for m in range(12):  # each like the next, ends unlike
        rows.append((600 + m, " ".join(chain[8 * m : 8 * m + 110])))
    return rows + [(800, None), (801, ""), (802, " \n"), (803, "One Two three"), (804, "one two THREE"), (805, rows[0][1] + "  ")]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)], "u long, v long")
    got = dict(components(edges).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}


def test_classes_equal_all_pairs(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, label int")
    got = {r.doc_id: r for r in classes(df).collect()}
    want = brute(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(got[i].n_links == 0 for i in (800, 801, 802)) and got[804].copy_id == 803 and got[804].n_copies == 2
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_n_links_count_all_pairs(spark):
    rows = sample()
    sets = {i: grams(t) for i, t in rows}
    different = set(sets.values()) - {frozenset()}
    want = {i: sum(a != b and len(a & b) >= 0.8 * len(a | b) for b in different) if a else 0 for i, a in sets.items()}
    got = {r.doc_id: r.n_links for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and max(want.values()) > 3
    ids = [(str(i).encode(), t) for i, t in rows if 100 <= i < 112]  # one family, in one block or in several
    texts = spark.createDataFrame(ids, "set_key binary, text string")
    full = texts.mapInPandas(_gram_sets(5), "set_key binary, grams array<long>, marks binary")
    labels = texts.select("set_key").withColumnsRenamed({"set_key": "node"}).selectExpr("node", "binary('100') AS label")
    for block, block_grams in ((512, 1 << 20), (3, 1 << 20), (512, 300)):
        got = {int(r.set_key): r.n_links for r in link_counts(labels, full, 0.8, block, block_grams).collect()}
        assert got == {i: sum(i != j and len(a & sets[j]) >= 0.8 * len(a | sets[j]) for j in range(100, 112)) for i, a in sets.items() if 100 <= i < 112}


def test_a_hot_bucket_is_dealt_in_blocks(spark):
    r = random.Random(12)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join(common + [f"x{r.randrange(10**9)}" for _ in range(r.randint(50, 70))]) for _ in range(3000)]
    for k in range(0, 40, 2):  # some pairs that are alike
        texts[k + 1] = texts[k] + f" y{k}"
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = spark.createDataFrame([(str(i).encode(), t) for i, t in rows], "set_key binary, text string").repartition(8)
    sets = sets.mapInPandas(_gram_sets(5), "set_key binary, grams array<long>, marks binary").selectExpr("set_key", "size(grams) AS size", "marks")
    hub = grams(texts[0])
    far = spark.createDataFrame([(1, str(i).encode(), str(i).encode(), 1 - len(hub & g) / len(hub | g)) for i, g in enumerate(map(grams, texts)) if i], "band long, set_key binary, label binary, far double")
    got = {(int(p.u), int(p.v)) for p in near_pairs(far, sets, 0.8, 0.9999, 256).collect()}
    want = {tuple(sorted((k, k + 1), key=str)) for k in range(2, 40, 2)}
    assert want <= got and len(got) < 60
    assert near_pairs(far.withColumn("label", F.lit(b"1")), sets, 0.8, 0.9999, 256).count() == 0


def test_end_to_end_recall(spark):
    r = random.Random(13)
    words = [f"w{k}" for k in range(5000)]
    rows, pairs = [], []
    for k in range(1500):
        seed = r.choices(words, k=r.randint(40, 200))
        other = list(seed)
        for _ in range(len(seed) // 90 + (k % 2)):
            other[r.randrange(len(other))] = r.choice(words)
        rows += [(2 * k, " ".join(seed)), (2 * k + 1, " ".join(other))]
        a, b = grams(rows[-2][1]), grams(rows[-1][1])
        if a != b and len(a & b) >= 0.8 * len(a | b):
            pairs.append(k)
    got = {x.doc_id: x.class_id for x in classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), with_links=False).collect()}
    assert len(pairs) > 300 and sum(got[2 * k] == got[2 * k + 1] for k in pairs) >= 0.999 * len(pairs)


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, " ".join(f"v{k}" for k in range(200_000))), (4, "a " * 300_000), (5, "a a a a a a")]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 0, 1), 4: (4, 0, 2), 5: (4, 0, 2)}


def test_copies_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, "z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.class_id, r.n_copies) for r in classes(df).collect())
    assert got == [("3", 3, 1), ("7", 7, 3), ("7", 7, 3), ("None", 7, 3)]
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == [3, 7]
    assert classes(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall, rows in ((0.8, 0.9999, 5), (0.9, 0.99, 8), (1.0, 0.9, 3)):
        b = bands_for(threshold, recall, rows)
        assert 1 - (1 - threshold**rows) ** b >= recall


def test_agreement_keeps_the_recall():
    t = agreement_for(0.8, 0.9999, 120)
    assert 70 < t < 90 and agreement_for(1.0, 0.99, 10) == 10
    r = random.Random(3)
    assert all(sum(r.random() < 0.8 for _ in range(120)) >= t for _ in range(2000))
