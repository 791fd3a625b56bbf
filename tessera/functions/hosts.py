"""Hosts and addresses that a source may be fetched from, as column expressions.

An address is written as the 32 hex digits of its 128 bits, an IPv4 address as the IPv6 address that
maps it; networks are ranges of such digits, so that a lookup is a comparison of strings.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Networks that aren't reachable from everywhere, as registered, with an address of cloud platforms that looks public; parts of them that are; local names.
REFUSED_4 = """0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 168.63.129.16/32 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16
198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4""".split()
ADMITTED_4 = "192.0.0.9/32 192.0.0.10/32".split()
REFUSED_6 = "0::/3 2001::/23 2001:db8::/32 2002::/16 3fff::/20 4000::/2 8000::/1".split()
ADMITTED_6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
MAPPED, NAT64 = "00000000000000000000ffff", "0064ff9b0000000000000000"
LOCAL_NAMES = ["localhost", "localhost.localdomain"]
LOCAL_SUFFIXES = [".local", ".localhost", ".internal", ".home.arpa"]

_PART = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED = rf"{_PART}(?:\.{_PART}){{3}}"
_LABELS = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"


def _range(network: str) -> tuple[str, str]:
    """The first and last address of a network, as hex digits."""
    base, bits = network.split("/")
    if "." in base:
        value, length = int.from_bytes(bytes(map(int, base.split("."))), "big"), 32
    else:
        left, _, right = base.partition("::")
        groups = [int(g or "0", 16) for g in left.split(":")], [int(g, 16) for g in right.split(":") if g]
        whole = groups[0] + [0] * (8 - len(groups[0]) - len(groups[1])) + groups[1]
        value, length = sum(g << 16 * (7 - i) for i, g in enumerate(whole)), 128
    rest = (1 << length - int(bits)) - 1
    return tuple(f"{x:0{length // 4}x}" for x in (value & ~rest, value | rest))


def _within(digits: Column, networks: list[str]) -> Column:
    return functools.reduce(Column.__or__, (digits.between(*_range(n)) for n in networks))


def _dotted_digits(address: Column) -> Column:
    return F.array_join(F.transform(F.split(address, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0")), "")


def address_digits(host: Column) -> Column:
    """The 32 hex digits of an address in either notation; null for anything else."""
    tail = F.regexp_extract(host, rf"({_DOTTED})$", 1)
    four = _dotted_digits(tail)
    plain = F.when(tail != "", F.concat(F.expr("''"), F.regexp_replace(host, rf"{_DOTTED}$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4))).otherwise(host)
    halves = F.split(plain, "::")
    groups = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    given = F.size(left) + F.size(right)
    all_ = F.when(F.size(halves) == 1, left).otherwise(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), right))
    # no empty group but for one "::", which stands for one group at least
    shaped = plain.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & F.contains(plain, F.lit(":"))
    counted = F.when(F.size(halves) == 1, given == 8).otherwise(given <= 7)
    six = F.when(shaped & counted, F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(host.rlike(rf"^{_DOTTED}$"), F.concat(F.lit(MAPPED), _dotted_digits(host))).otherwise(six)


def public(digits: Column) -> Column:
    """Whether an address, and the IPv4 address that it maps or translates, is reachable from everywhere."""
    last = F.right(digits, F.lit(8))
    inner = ~_within(last, REFUSED_4) | _within(last, ADMITTED_4)
    embeds = digits.startswith(MAPPED) | digits.startswith(NAT64)
    return F.when(embeds, inner).otherwise(~_within(digits, REFUSED_6) | _within(digits, ADMITTED_6))


def written(digits: Column, host: Column) -> Column:
    """An address in its shortest form: IPv4 as it was, else groups without leading zeros, the first of the longest runs of zeros left out."""
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")
    forms = [F.when(groups.rlike(p := rf"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)$"), F.concat(F.regexp_replace(F.regexp_extract(groups, p, 1), ":$", ""), F.lit("::"), F.regexp_replace(F.regexp_extract(groups, p, 2), "^:", ""))) for n in range(8, 1, -1)]
    dotted = F.regexp_replace(host, r"^.*:", "")
    mapped = F.when(digits.startswith(MAPPED), F.when(F.contains(host, F.lit(":")), F.coalesce(*forms)).otherwise(dotted))
    return F.coalesce(mapped, *forms, groups)


def normalised(rows: DataFrame, host: str) -> DataFrame:
    """rows with host in its canonical form: a public address, or an ASCII name of valid labels that isn't local; else null. Scoped addresses and NUL are refused outright.

    Each step is a column that is computed once, as the next ones use it often.
    """
    kept = [c for c in rows.columns if c != host]
    value = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(host, F.lit("")), r"^\s+|\s+$", "")), r"\.+$", "")
    given = rows.select(F.struct(*kept).alias("own"), value.alias("value"))
    told = given.select("own", "value", F.when(F.col("value").rlike("^[0-9a-f:.]+$"), address_digits(F.col("value"))).alias("digits"))
    judged = told.select("own", "value", "digits", F.when(F.col("digits").isNotNull(), public(F.col("digits"))).alias("open"))
    v = F.col("value")
    local = v.isin(LOCAL_NAMES) | functools.reduce(Column.__or__, (v.endswith(s) for s in LOCAL_SUFFIXES))
    named = F.when(v.rlike(_LABELS) & (F.length(v) <= 253) & ~local, v)
    form = F.when(v.rlike("[%\\x00]"), None).when(F.col("digits").isNotNull(), F.when(F.col("open"), written(F.col("digits"), v))).otherwise(named)
    return judged.select("own.*", form.alias(host))


def _ascii(name: str | None) -> str:
    """A name with its labels in the ASCII form that name servers know; empty if there is none."""
    try:
        return (name or "").strip().rstrip(".").lower().encode("idna").decode("ascii")
    except UnicodeError:
        return ""


def normalised_hosts(rows: DataFrame, key: str, host: str) -> DataFrame:
    """key, host in canonical form, or null where it is refused. Only names beyond ASCII reach Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "host": pd.Series(list(map(_ascii, batch[host])), dtype=object, index=batch.index)})

    beyond = F.coalesce(F.col(host).rlike(r"[^\x00-\x7f]"), F.lit(False))
    named = rows.where(beyond).select(key, host).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, host string")
    return normalised(rows.where(~beyond).select(key, F.col(host).alias("host")).union(named), "host")
