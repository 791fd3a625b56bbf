"""Chunks and Markdown that SQL can't express, against plain rules."""

import ipaddress
import random

from pyspark.sql import functions as F

from tessera.functions.hosts import ADMITTED_4, ADMITTED_6, REFUSED_4, normalised_hosts
from tessera.functions.shapes import ids_in, inert, loaded
from tessera.operators.chunks import with_trailing_lines


def plain(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, held = [], []
    for line in text.splitlines(keepends=True):
        if held and sum(map(len, held)) + len(line) > size:
            out.append("".join(held))
            keep = len(held)
            while keep > 0 and sum(map(len, held[keep - 1 :])) <= overlap:
                keep -= 1
            held = held[keep:]
        held.append(line)
    return [*out, "".join(held)]


def test_chunks_with_trailing_lines():
    r = random.Random(3)
    for _ in range(300):
        text = "".join("x" * r.choice([0, 3, 9, 30, 70]) + "\n" for _ in range(r.randint(0, 40)))
        assert with_trailing_lines(text, 80, r.choice([0, 10, 25])) is not None
        for overlap in (0, 10, 25):
            assert with_trailing_lines(text, 80, overlap) == plain(text, 80, overlap), (text, overlap)


def test_json_in_replies():
    assert loaded('<think>{"a": 0}</think> so {"a": [1, {"evidence_id": 7}]} end') == {"a": [1, {"evidence_id": 7}]}
    assert loaded("```json\n[1]\n``` x") == [1] and loaded("{broken") is None and loaded(None) is None
    assert list(ids_in({"evidence_ids": ["a", "", 3], "x": [{"evidence_id": "b"}]})) == ["a", "3", "b"]


def test_inert_markdown(spark):
    cases = {
        "~~~js\n![x](y)\n<a>\n~~~\n<a>": "~~~text\n[Image omitted for local-only safety: x]\n<a>\n~~~\n&lt;a&gt;",
        "``` a\n<x>\n````\n<y>": "```text\n<x>\n````\n&lt;y&gt;",
        "````\n<x>\n```\n<y>\n````  \n<z>": "````text\n<x>\n```\n<y>\n````  \n&lt;z&gt;",
        "```\n<x>\n~~~\n```~\n<y>": "```text\n<x>\n~~~\n```~\n<y>",
        "   ```dataviewjs\r\n<x>\r\n```\r\n<y>\r\n": "   ```text\r\n<x>\r\n```\r\n&lt;y&gt;\r\n",
        "    ```\n<x>": "    ```\n&lt;x&gt;",
        "a <!--E:3fA_.:-1--> b <!--P:x--> <!--SEGMENT_EVIDENCE:E1,E2--> <!-- E:1 --> <!--Q:1-->": "a <!--E:3fA_.:-1--> b <!--P:x--> <!--SEGMENT_EVIDENCE:E1,E2--> &lt;!-- E:1 --&gt; &lt;!--Q:1--&gt;",
        "![](u) ![a] [ref] ![[embed]] `$= x`": "[Image omitted for local-only safety: image] [Image omitted for local-only safety: a] &#33;[[embed]] `&#36;= x`",
        "<img\nsrc=x>": "&lt;img\nsrc=x&gt;",
        "\ufdd0E:1\ufdd1<\ufdd0script\ufdd1": "<!--E:1-->&lt;\ufdd0script\ufdd1",
        "": "",
        "plain\n\ntext": "plain\n\ntext",
        "```": "```text",
        "x\n```": "x\n```text",
    }
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", inert(F.col("t")).alias("b")).collect()}
    assert got == cases
    assert spark.sql("SELECT CAST(NULL AS STRING) t").select(inert(F.col("t"))).first()[0] == ""
    long = "<a> text\n" * 100_000 + "```\n" + "line\n" * 200_000 + "```\n" + "<" * 100_000
    assert spark.createDataFrame([(long,)], "t string").select(F.length(inert(F.col("t")))).first()[0] == len(long) + 100_000 * 6 + 4 + 100_000 * 3


def hosts(spark, given):
    rows = normalised_hosts(spark.createDataFrame(list(enumerate(given)), "k long, h string"), "k", "h").collect()
    return [r.host for r in sorted(rows)]


def test_hosts(spark):
    allowed = {"8.8.8.8": "8.8.8.8", " Example.COM. ": "example.com", "bücher.example": "xn--bcher-kva.example", "2001:4860:4860::8888": "2001:4860:4860::8888", "64:ff9b::808:808": "64:ff9b::808:808", "64:FF9B::8.8.8.8": "64:ff9b::808:808", "2001:1::1": "2001:1::1", "192.0.0.9": "192.0.0.9"}
    refused = ["10.0.0.1", "127.0.0.1", "169.254.169.254", "168.63.129.16", "::1", "::", "::ffff:10.0.0.1", "64:ff9b::a00:1", "64:ff9b:1::1", "2002:a00:1::", "2001:0:53aa:64c::", "224.0.0.1", "printer", "localhost", "x.local", "-a.example", "a..b", "", None, "a%b.example"]
    refused += ["2001:4860:4860::8888%eth0", "8.8.8.8%1", "exa\0mple.com", "fe80::1%eth0", "1:2:3:4:5:6:7:8:9", "2001:::1", "2001:1::2::3", "a" * 64 + ".example", "ff02::1", "x" * 250 + ".com"]
    assert hosts(spark, list(allowed)) == list(allowed.values())
    assert [h for h, got in zip(refused, hosts(spark, refused), strict=True) if got is not None] == []


def test_addresses_equal_the_registry_that_python_has(spark):
    r = random.Random(4)
    some = [ipaddress.IPv4Address(r.getrandbits(32)) for _ in range(1500)] + [ipaddress.IPv6Address(0x2000 << 112 | r.getrandbits(125)) for _ in range(300)]
    edges = [n for net in REFUSED_4 + ADMITTED_4 for i in (0, -1) for n in [ipaddress.ip_network(net)[i]]]
    edges += [ipaddress.ip_network(net)[i] for net in ADMITTED_6 + ["2001:db8::/32", "fc00::/7", "fe80::/10", "100::/64"] for i in (0, -1)]
    edges += [x + d for x in edges for d in (1, -1) if 0 < int(x) + d < 2 ** x.max_prefixlen]
    edges += [ipaddress.IPv6Address(r.getrandbits(16) << 112 | r.choice([0, r.getrandbits(16)]) << 64 | r.getrandbits(16)) for _ in range(300)]

    def open_to_all(a):
        if a.version == 6:
            return ipaddress.IPv6Address(2 << 124) <= a < ipaddress.IPv6Address(4 << 124) and a.is_global and a.teredo is None and a not in ipaddress.ip_network('3fff::/20')
        return a.is_global and not a.is_multicast and not a.is_reserved and str(a) != "168.63.129.16"

    given = [a for a in some + edges if a.version == 4 or (a.ipv4_mapped is None and a not in ipaddress.ip_network("64:ff9b::/96"))]
    assert hosts(spark, [a.exploded if r.random() < 0.5 else str(a) for a in given]) == [a.compressed if open_to_all(a) else None for a in given]
