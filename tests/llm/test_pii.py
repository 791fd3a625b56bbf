import hashlib
import random
import re
import time
from itertools import accumulate

from pyspark.sql import functions as F

from tessera.llm.pii import digests, redacted, running, spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 * (x > 4)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def fits(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text or "") if fits(kind, m[0])]
    return sorted(out)


def sample():
    r = random.Random(11)
    bits = ["a.b@c.de", "x@y", "_d@e.f.g", "@", ".", "1.2.3.4", "256.1.1.1", "0255.001.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234", "+1 (988) 555-2485", "+12", "+1 2 3 4 5 6 7 8 9 0 ", "é", "日本", "😀", "\n", "mail ", "foo%bar+q-z@h-1.co_m", "12 ", "-", "+", "00", "..", "a@b.c@d.e"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " ", " ", "x"]) for _ in range(r.randint(0, 40)))) for i in range(400)]
    return rows + [(900, None), (901, ""), (902, "9" * 20000), (903, "a" * 20000), (904, "1 " * 8000), (905, "a@b.c " * 500), (905, "a@b.c " * 500), (None, "mail me at a@b.cd")]


def test_base_spans_equal_plain_patterns(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, base int").repartition(8)
    got = {r.doc_id: r for r in digests(df).collect()}
    for i, t in rows:
        want = base(t)
        own = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(x[3] == k for x in want) for k in PLAIN], (i, t)
        assert got[i].base_sha256 == hashlib.sha256(own.encode()).hexdigest(), (i, t)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("context")] == [s for s in own.split(",") if s]


def test_addresses_with_parts_that_are_zero(spark):
    own = ["10.0.0.1", "127.0.0.1", "192.168.0.10", "0.0.0.0", "192.168.00.1", "000.00.0.000", "255.255.255.0", "0256.0.0.1", "10.0.0.300"]
    rows = [(i, f"at {t}, then") for i, t in enumerate(own)] + [(99, " / ".join(own))]
    got = {r.doc_id: r for r in digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = base(t)
        assert got[i].n_ip == sum(k == "ip" for *_, k in want) == (7 if i == 99 else int(i < 7))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()


def test_confident_contexts_discover_what_no_pattern_finds(spark):
    rows = [(i, f"filler words. Please reach me: user{i}@mail{i}.example.com and more") for i in range(9)]
    rows += [(50, "filler words. Please reach me: user 1 at 55-77-99, thanks"), (51, "Please reach me: 8812-77. Bye"), (52, "nothing near 8812-77 here"), (53, "unrelated words 4455-99 end")]
    got = {r.doc_id: [(s.start, s.end) for s in r.discovered] for r in spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert [text[51][a:b] for a, b in got[51]] == ["8812-77"]
    assert got[53] == [] and all(got[i] == [] for i in range(9))
    clean = {r.doc_id: r.text for r in redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[51] == "Please reach me: <context>. Bye" and clean[3] == "filler words. Please reach me: <email> and more" and clean[53] == text[53]


def test_running_totals(spark):
    rows = [([r.randint(-5, 9) for _ in range(n)],) for n, r in ((n, random.Random(n)) for n in (0, 1, 2, 3, 4, 5, 31, 32, 33, 100))]
    df = spark.createDataFrame(rows, "x array<int>").select("x", running(F.col("x"), lambda a, b: a + b, F.lit(0)).alias("sum"), running(F.col("x"), lambda a, b: F.greatest(a, b), F.lit(-9)).alias("most"))
    for r in df.collect():
        assert r["sum"] == list(accumulate(r.x)) and r.most == list(accumulate(r.x, max))


def test_redacted_texts_equal_plain_replacement(spark):
    rows = [(i, t) for i, t in sample() if i is not None and i < 902]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: sorted((s.start, s.rank, s.end, s.kind) for s in [*r.base, *r.discovered]) for r in spans(df).collect()}
    got = {r.doc_id: r.text for r in redacted(df).collect()}
    for i, t in rows:
        out, at = [], 0
        for start, _, end, kind in found[i]:
            if start >= at:
                out.append(t[at:start] + f"<{kind}>")
            at = max(at, end)
        assert got[i] == (None if t is None else "".join(out) + t[at:])


def test_long_texts_with_many_matches_take_time_in_proportion(spark):
    own = {1: "1." * 500_000, 2: "a@b.c 10.0.0.1 " * 20_000, 3: "mail me at 4455-99 " * 20_000}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r.doc_id: r for r in digests(df).collect()}
    clean = {r.doc_id: r.text for r in redacted(df).collect()}
    assert time.time() - began < 90
    assert got[2].n_email == got[2].n_ip == 20_000 and clean[2] == "<email> <ip> " * 20_000
    assert got[1].n_ip == 125_000 and clean[1] == "<ip>." * 125_000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert digests(df).count() == 0 and redacted(df).count() == 0
