"""String functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain letters, as far as search and slugs fold them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
FOLDS = str.maketrans(MARKED, PLAIN)
WORD, OTHERS = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Search tokens in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def spaced(text: Column) -> Column:
    """Tokens joined by blanks, their marks not yet folded (FOLDS); null where there are none. No array is made of them."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), OTHERS, " ")), F.lit(""))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once for each row, however often then names it, in functions of elements too."""
    return F.transform(F.array(value), then)[0]


def slug(text: Column, most: int = 80) -> Column:
    """Plain lower-case letters and digits joined by single hyphens, cut; 'untitled' for what has none."""
    joined = F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(joined, 1, most), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "untitled").otherwise(cut)


def clean_tag(name: Column, words: int = 4, chars: int = 40) -> Column:
    """A tag's slug without repeats and repeated cycles of words; null if it has too many words or characters."""

    def unrepeated(parts: Column) -> Column:
        return F.filter(parts, lambda p, i: (i == 0) | (p != F.get(parts, i - 1)))

    def uncycled(once: Column) -> Column:
        n = F.size(once)
        whole = lambda k: (n % k == 0) & (F.flatten(F.array_repeat(F.slice(once, 1, k), (n / k).cast("int"))) == once)
        return F.slice(once, 1, F.array_min(F.filter(F.sequence(F.lit(1), n), whole)))

    def joined(short: Column) -> Column:
        tag = F.array_join(short, "-")
        return F.when((F.size(short) <= words) & (F.length(tag) <= chars) & (tag != "untitled"), tag)

    return bound(bound(bound(F.split(slug(name), "-"), unrepeated), uncycled), joined)


def origin(url: Column) -> Column:
    """Scheme, lower-case host and explicit port of a URL; a placeholder for anything else."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+(:[0-9]+)", 1)
    return F.when((scheme != "") & (host != ""), F.concat(F.lower(scheme), F.lit("://"), host, port)).otherwise("[url]")


def without_urls(text: Column) -> Column:
    """Text whose URLs keep their scheme and host only."""
    return F.regexp_replace(text, r"(https?://)(?:[^/\s?#@]*@)?([^/\s?#]+)[^\s]*", "$1$2")


def squeezed(text: Column, most: int = 500) -> Column:
    """White space collapsed and trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), 1, most)


def topic_key(text: Column, most: int = 300) -> Column:
    """What topics are told apart by: lower case, other characters than letters and digits as one blank."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), 1, most)


def clock(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def seconds(text: Column) -> Column:
    """Seconds of a clock string of two or three parts."""
    parts = F.transform(F.split(text, ":"), lambda p: p.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)


def without_reasoning(text: Column) -> Column:
    """Text without closed reasoning blocks, cut before an unclosed one."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.substring_index(closed, "<think>", 1))


def fenced(text: Column) -> Column:
    """What the first code fence holds, else the text from its first brace or bracket, else all of it; trimmed."""
    inner = F.regexp_extract(text, r"(?s)```[A-Za-z]*\n(.*?)```", 1)
    opened = F.regexp_extract(text, r"(?s)[{\[].*$", 0)
    return F.regexp_replace(F.when(inner != "", inner).when(opened != "", opened).otherwise(text), r"^\s+|\s+$", "")


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(text, "")
    n = F.length(text)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))


def estimated_tokens(text: Column) -> Column:
    """ceil(characters / 4), at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def dense_tokens(text: Column) -> Column:
    """The larger of ceil(bytes / 2.5) and ceil(words * 1.35), at least 1."""
    words = F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) * 2 / 5), F.ceil(words * 135 / 100)).cast("long")
