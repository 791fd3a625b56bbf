"""Toxicity by weak supervision: a generative label model over many voters, then a linear classifier on its posterior labels.

Voters are lexicons (fixed ones, and ones mined from labelled rows: words and word beginnings) and
patterns. Each votes toxic, clean, or not at all. Votes of every document are counted by
combination in Spark; expectation-maximisation on these counts estimates each voter's accuracy, and
the correlations that remain between voters given the label, by which it discounts voters that say
the same. Given labels, all of them, serve to mine lexicons and to estimate accuracies. The classifier never sees one: it is
fitted to the model's posterior labels of a bounded sample of all documents, labelled or not, and scores whole texts.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Documents, of all that may be learned from, that the classifier is fitted to, at most about.
SAMPLE = 12_000
#: A word or a word's beginning is mined, or a feature, if so many rows of one kind have it (for features: rows of the sample, by their beliefs).
SUPPORT = 5
#: Words and beginnings in the mined lexicons at most: those that speak most clearly; 8 MB.
MOST_MINED = 1 << 20
MINED = 4
#: How often a given label is right, where accuracies are estimated.
TRUST = 0.9995
BEGINNINGS = (4, 5)

#: Fixed word lists of insults in English, by what they demean.
LEXICONS = {
    "wits": "idiot moron stupid dumb fool imbecile cretin dimwit halfwit clown",
    "worth": "worthless pathetic loser trash garbage scum filth vermin nobody useless",
    "contempt": "disgusting despicable repulsive hate vile shut pig freak creep jerk",
}
VOTERS = [*LEXICONS, *(f"mined{i}" for i in range(MINED)), "address", "shouting", "calm"]

_WORD = re.compile(r"[^\W\d_]+")
_INSULTS = "|".join(sorted(w for x in LEXICONS.values() for w in x.split()))
_ADDRESS = re.compile(rf"\byou(?:'re| are)?\W+(?:\w+\W+){{0,3}}?(?:{_INSULTS})s?\b")
_SHOUTING = re.compile(r"[A-Z]{3,}\W+[A-Z]{3,}\W+[A-Z]{3}")


def words_of(text: str | None) -> set[str]:
    """The text's different words in lower case."""
    out: set[str] = set()
    for part in set((text or "").lower().split()):
        if part.isalpha():
            out.add(part)
        else:
            out.update(_WORD.findall(part))
    return out


def features_of_word(word: str) -> list[str]:
    """The word, and its beginnings as '4:...' and '5:...'."""
    return [word, *(f"{k}:{word[:k]}" for k in BEGINNINGS if len(word) >= k)]


def features_of(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in features_of_word(w)}


def number(feature: str) -> int:
    """The 64-bit number that stands for a feature."""
    return xxhash.xxh3_64_intdigest(feature)


class Places(dict):
    """For a word the places, in a sorted table of features' numbers, of its features that are in it; words and their beginnings are remembered, each up to a number."""

    def __init__(self, table: np.ndarray, most: int = 500_000):
        super().__init__()
        self.table, self.most = array("Q", table.astype(np.uint64).tobytes()), most
        self.beginnings: dict[str, int] = {}

    def _place(self, feature: str) -> int:
        own = number(feature)
        at = bisect_left(self.table, own)
        return at if at < len(self.table) and self.table[at] == own else -1

    def _beginning(self, start: str) -> int:
        if len(self.beginnings) >= self.most:
            self.beginnings.clear()
        self.beginnings[start] = at = self._place(f"{len(start)}:{start}")
        return at

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        known = self.beginnings
        own = [known[start] if start in known else self._beginning(start) for start in (word[:k] for k in BEGINNINGS if len(word) >= k)]
        self[word] = both = tuple(x for x in (self._place(word), *own) if x >= 0)
        return both

    def of(self, words: set[str]) -> list[int]:
        """The places of the words' features that have one, ascending."""
        return sorted(set(chain.from_iterable(filter(None, map(self.__getitem__, words)))))


class Numbers(dict):
    """For a word its features' numbers; remembered up to a number of words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = own = tuple(map(number, features_of_word(word)))
        return own

    def of(self, words: set[str]) -> np.ndarray:
        own = set(chain.from_iterable(map(self.__getitem__, words)))
        return np.sort(np.fromiter(own, np.uint64, len(own)))


class Votes:
    """The voters' opinions of a text: 1 toxic, -1 clean, 0 none. mined: for each place of the mined features' table the lexicon that it belongs to."""

    def __init__(self, mined: np.ndarray):
        self.fixed, self.mined = [set(x.split()) for x in LEXICONS.values()], mined.tolist()

    def of(self, text: str | None, words: set[str], places: list[int]) -> list[int]:
        votes = [int(not own.isdisjoint(words)) for own in self.fixed]
        lists = {self.mined[at] for at in places}
        votes += [int(i in lists) for i in range(MINED)]
        text = text or ""
        low = text.lower()
        insulted = "you" in low and bool(_ADDRESS.search(low))
        votes += [int(insulted), int("!!!" in text or bool(_SHOUTING.search(text)))]
        return [*votes, 0 if any(votes) else -1]


class LabelModel:
    """P(votes | label) by voter, discounted by the correlations between voters; label 1 is toxic."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, gold: np.ndarray, rounds: int = 30):
        """votes: one row a combination; counts: documents that have it; gold: their label, or -1."""
        n, m = votes.shape
        known = gold >= 0
        self.weights = np.ones(m)
        share = (counts * (gold == 1)).sum() / max(1.0, (counts * known).sum()) if known.any() else 0.1
        self.prior = float(np.clip(share, 0.01, 0.5))
        alike = self._correlations(votes, counts, np.full(n, 0.5)) ** 4  # voters that say the same start with one voice
        belief = np.where(known, gold, 1 / (1 + np.exp(-2.0 * votes @ (1 / (1 + alike.sum(1))))))
        for _ in range(rounds):
            self._maximise(votes, counts, belief)
            belief = np.where(known, TRUST * gold + (1 - TRUST) * (1 - gold), self.posterior(votes))
        self.correlations = self._correlations(votes, counts, belief)

    def _maximise(self, votes: np.ndarray, counts: np.ndarray, belief: np.ndarray) -> None:
        self.prior = float(np.clip((counts * belief).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        tables = []
        for y in (0, 1):
            mass = counts * (belief if y else 1 - belief)
            tables.append(np.stack([(mass[:, None] * (votes == v)).sum(0) + 1.0 for v in (-1, 0, 1)]) / (mass.sum() + 3.0))
        self.log = np.log(np.stack(tables))  # label, vote + 1, voter
        rho = self._correlations(votes, counts, belief)
        self.weights = 1 / (1 + np.clip(rho, 0, None).sum(1))

    def _correlations(self, votes: np.ndarray, counts: np.ndarray, belief: np.ndarray) -> np.ndarray:
        """Mean over the labels of the voters' correlations given the label; 0 on the diagonal."""
        out = np.zeros((votes.shape[1],) * 2)
        for mass in (counts * belief, counts * (1 - belief)):
            total = max(mass.sum(), 1e-9)
            centred = votes - (mass[:, None] * votes).sum(0) / total
            cov = (centred * mass[:, None]).T @ centred / total
            scale = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
            out += cov / np.outer(scale, scale) / 2
        np.fill_diagonal(out, 0)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])
        odds = ((self.log[1][votes + 1, at] - self.log[0][votes + 1, at]) * self.weights).sum(1)
        return 1 / (1 + np.exp(-(odds + np.log(self.prior / (1 - self.prior)))))


def fit_linear(rows: list[np.ndarray], belief: np.ndarray, n: int, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """n weights and the bias of a logistic regression on sets of features, by full-batch Adam over the features that occur."""
    seen = np.zeros(n, bool)
    for r in rows:
        seen[r] = True
    rank, k = np.cumsum(seen) - 1, int(seen.sum())
    blocks = []  # rows that are worked on together: features, the bias (k) being every row's last, where rows begin, their lengths, beliefs
    for lo in range(0, len(rows), 1000):
        some = [np.append(rank[np.asarray(r, np.int64)], k) for r in rows[lo : lo + 1000]]
        lengths = np.array([len(r) for r in some])
        blocks.append((np.concatenate(some), np.cumsum(lengths) - lengths, lengths, belief[lo : lo + 1000]))
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        g = np.append(ridge * w[:k], 0.0)
        for at, starts, lengths, wanted in blocks:
            d = (1 / (1 + np.exp(-np.add.reduceat(w[at], starts))) - wanted) / len(rows)
            g += np.bincount(at, np.repeat(d, lengths), k + 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(n)
    weights[seen] = w[:k]
    return weights, float(w[k])


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block of texts: in how many toxic and clean ones each feature occurs."""
    sums: tuple[Counter, Counter] = (Counter(), Counter())
    numbers = Numbers()

    def flush() -> Iterator[pd.DataFrame]:
        names = list(sums[0].keys() | sums[1].keys())
        if names:
            yield pd.DataFrame({"feature": np.array(names, np.uint64).view(np.int64), "bad": [float(sums[1][f]) for f in names], "good": [float(sums[0][f]) for f in names]})
        for s in sums:
            s.clear()

    for rows in batches:
        for text, toxic in zip(rows.text, rows.toxic, strict=True):
            sums[int(toxic > 0)].update(numbers.of(words_of(text)).tolist())
            if len(sums[0]) + len(sums[1]) > 1_000_000:
                yield from flush()
    yield from flush()


def _told(seen: DataFrame, bad: float, good: float) -> DataFrame:
    """feature, odds, z of supported features, from the masses of toxic and clean rows that have them, of bad and good in all."""
    sums = seen.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where((F.col("bad") >= SUPPORT) | (F.col("good") >= SUPPORT))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    return sums.select("feature", odds.alias("odds"), (odds / spread).alias("z"))


def _voted(table: np.ndarray, mined: np.ndarray):
    """votes in place of each row's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters, places = Votes(mined), Places(table)
        for rows in batches:
            words = map(words_of, rows.text)
            votes = [voters.of(text, own, places.of(own)) for text, own in zip(rows.text, words, strict=True)]
            yield rows.drop(columns="text").astype({"doc_id": "Int64"}).assign(votes=votes)

    return run


def _taught(table: np.ndarray, mined: np.ndarray, labels: LabelModel, texts: pd.Series) -> tuple[list[np.ndarray], np.ndarray]:
    """The numbers of each text's features, and what the label model believes of it."""
    voters, places, numbers = Votes(mined), Places(table), Numbers()
    lists, votes = [], []
    for text in texts:
        own = words_of(text)
        lists.append(numbers.of(own))
        votes.append(voters.of(text, own, places.of(own)))
    return lists, labels.posterior(np.array(votes, np.int64).reshape(len(texts), -1))


class Model:
    """table: the sorted numbers of the classifier's features; weights: theirs; lexicon, mined: the mined features' table and their lexicons; labels: the voters' model."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float, lexicon: np.ndarray, mined: np.ndarray, labels: LabelModel | None):
        self.table, self.weights, self.bias, self.lexicon, self.mined, self.labels = table, weights, bias, lexicon, mined, labels


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, relabel: Callable[[LabelModel], LabelModel] = lambda m: m) -> Model:
    """The classifier, from texts of docs and from labels (doc_id, toxic), all of which may be learned from.

    Labels whose doc_id or toxic is null are left out; of labels that disagree, toxic counts. Without labels nothing is mined, and the fixed voters teach alone.
    relabel: changes the label model before it labels (to test what depends on it).
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Dealt by doc_id at every size: labels grow with the corpus and aren't broadcast.
    labelled = docs.select("doc_id", "text").hint("merge").join(labels, "doc_id").select("text", "toxic")
    seen = labelled.mapInPandas(_features, "feature long, bad double, good double")
    sizes = docs.select("doc_id").hint("merge").join(labels, "doc_id").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    spoken = _told(seen, sizes.bad or 0, sizes.good or 0).where("z > 3 AND odds > 2").orderBy(F.desc("z"), "feature").limit(MOST_MINED).select("feature").toPandas()
    found = spoken.feature.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    lexicon, mined = found[order], (np.arange(len(found)) % MINED)[order]

    n = docs.count()
    sampled = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / max(sample, n)), F.lit(False))
    voted = scratch(docs.select("doc_id", "text").mapInPandas(_voted(lexicon, mined), "doc_id long, votes array<int>"), "voted")
    every = voted.groupBy("votes").count().toPandas()  # 3 ** voters rows at most
    gold = voted.select("doc_id", "votes").join(labels, "doc_id").groupBy("votes", "toxic").count().toPandas()  # twice as many at most
    if not len(every):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -2.0, lexicon, mined, None)
    # labelled rows count with their label, all others without
    left = Counter({tuple(v): c for v, c in zip(every.votes, every["count"], strict=True)})
    left.subtract({tuple(v): 0 for v in gold.votes})
    for v, c in zip(gold.votes, gold["count"], strict=True):
        left[tuple(v)] -= c
    votes = np.array([*left, *gold.votes], np.int64)
    counts = np.array([*left.values(), *gold["count"]], float)
    model = relabel(LabelModel(votes, counts, np.array([-1] * len(left) + gold.toxic.tolist())))

    own = docs.where(sampled).select("text")  # about `sample` rows, read again when they are wanted

    def masses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each feature of all the task's texts, or of a few thousand of them."""
        lists, beliefs = [], []
        for rows in chain(batches, [None]):
            if rows is not None and len(rows):
                own, belief = _taught(lexicon, mined, model, rows.text)
                lists, beliefs = lists + own, [*beliefs, *belief]
            if lists and (rows is None or sum(map(len, lists)) > 4_000_000):
                names, at = np.unique(np.concatenate(lists), return_inverse=True)
                bad = np.bincount(at, np.repeat(beliefs, [len(x) for x in lists]), len(names))
                yield pd.DataFrame({"feature": names.view(np.int64), "bad": bad, "good": np.bincount(at, minlength=len(names)) - bad})
                lists, beliefs = [], []

    held = voted.where(sampled).groupBy("votes").count().toPandas()  # 3 ** voters rows at most
    if not len(held):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(model.prior / (1 - model.prior))), lexicon, mined, model)
    bad = float((model.posterior(np.array(held.votes.tolist(), np.int64)) * held["count"]).sum())
    told = _told(own.mapInPandas(masses, "feature long, bad double, good double"), bad, float(held["count"].sum()) - bad)
    clear = told.where("abs(z) > 3").select("feature").toPandas()  # of the sample's words
    table = np.sort(clear.feature.to_numpy(np.int64).view(np.uint64))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lo in range(0, len(rows), 500):
                lists, belief = _taught(lexicon, mined, model, rows.text[lo : lo + 500])
                at = [np.searchsorted(table, x) for x in lists]
                kept = [a[(a < len(table)) & (table[np.minimum(a, len(table) - 1)] == x)] if len(table) else a[:0] for a, x in zip(at, lists, strict=True)]
                yield pd.DataFrame({"features": [k.astype(np.uint32).tobytes() for k in kept], "belief": belief})

    rows = own.mapInPandas(placed, "features binary, belief double").toPandas()
    weights, bias = fit_linear([np.frombuffer(f, np.uint32) for f in rows.features], rows.belief.to_numpy(), len(table))
    return Model(table, weights, bias, lexicon, mined, model)


def scored(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns, score, predicted of each row; a null text is empty, an empty text gets the score of a text without features."""
    table, weights, bias = model.table, model.weights, model.bias

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(table)
        for rows in batches:
            sums = np.array([weights[places.of(words_of(t))].sum() for t in rows.text], float)
            score = 1 / (1 + np.exp(-np.clip(sums + bias, -50, 50)))
            yield rows.drop(columns="text").assign(score=score, predicted=(score >= 0.5).astype(int))

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*columns, "text").mapInPandas(run, ", ".join(f"{c} {fields[c]}" for c in columns) + ", score double, predicted int")


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; rows whose crc32(doc_id as text) is a multiple of folds are never learned from.

    Other columns of docs are ignored. A null doc_id is held out, a null text is empty. Rows that repeat get the same score. A text of any
    length is read whole. Partitions without labelled rows, and tables without labels or without rows, are no special case.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    model = learned(plain.where(rest != 0), labels.select(F.col("doc_id").cast("long"), "toxic").where(rest != 0), sample)
    return scored(plain.withColumn("held_out", F.coalesce(rest == 0, F.lit(True))), model, ("doc_id", "held_out"))
