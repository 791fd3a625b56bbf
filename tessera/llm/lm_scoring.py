"""LM scoring: a causal self-attention model on subword ids, trained across partitions, and a unigram base score.

Base: each block of documents lists its different words once, packed by hash bucket;
bucket by bucket the blocks' counts are summed and sent back, so that a frequent word
costs a row a block. Training counts, and with them what is shuffled, cover all training documents.
Model: the summed words, taken apart into subword ids, count the ids of all training documents, which makes the classes. Texts are
encoded once; in each round every partition trains on all windows of its whole training texts, and the partitions' weights are averaged by
the windows they saw. Training and scoring cover texts in the same overlapping windows, each id once a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention_lm import Attention, Vocabulary, Windows
from .common import NO_ID, scratch, shuffle_partitions
from .tokens import encoder

FOLDS, HELD = 7, 2
BLOCK_WORDS = 1_500_000
BUCKET_CHARS = 1 << 24
ROUNDS = 2
#: Ids whose windows a worker holds at once; a text isn't divided.
PASS_IDS = 1 << 19
#: Weights are summed over partitions in two steps, to so many sums each, before they reach the driver.
SLOTS = (4096, 16)
END = b""


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32(doc_id as text) mod 7 is 2; so is a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(True))


def _zip(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, codec="zstd"), kind)


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_LISTED = "bucket long, block string, kind string, words binary, places binary, counts binary, doc_ids array<long>, text_keys array<long>, held array<boolean>, n_tokens array<long>"


def _listed(n_buckets: int, block_words: int):
    names = [c.split()[0] for c in _LISTED.split(", ")]

    def block_rows(block: str, docs: list[tuple], index: _Index, ids: list[np.ndarray]) -> pd.DataFrame:
        lengths = np.array([len(x) for x in ids])
        whole = np.concatenate(ids)
        train = np.repeat([not d[2] for d in docs], lengths)
        counts = np.bincount(whole[train], minlength=len(index)).astype(np.int64)
        words = list(index)
        buckets = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in words), np.int64, len(words))
        order = np.argsort(buckets, kind="stable")
        starts = np.flatnonzero(np.diff(buckets[order], prepend=-1))
        rows = []
        for lo, hi in zip(starts, [*starts[1:], len(words)], strict=True):
            at = order[lo:hi]
            text = b"\n".join(words[i] for i in at)
            packed = len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)
            rows.append((int(buckets[at[0]]), block, "w", packed, _zip(at.astype(np.uint32)), _zip(counts[at]), None, None, None, None))
        rows.append((-1, block, "d", None, _zip(whole.astype(np.uint32)), None, [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], lengths.tolist()))
        return pd.DataFrame(rows, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        index, docs, ids, held = _Index(), [], [], 0
        for rows in batches:
            for doc_id, key, out, text in zip(rows.doc_id, rows.text_key, rows.held, rows.text, strict=True):
                words = (text or "").encode().lower().split()
                words.append(END)
                docs.append((doc_id, key, out))
                ids.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                held += len(words)
                if held >= block_words:
                    yield block_rows(f"{part}-{n}", docs, index, ids)
                    index, docs, ids, held, n = _Index(), [], [], 0, n + 1
        if docs:
            yield block_rows(f"{part}-{n}", docs, index, ids)

    return run


def _summed(path: str):
    """Of one bucket: for each block its places and the whole corpus's counts of its words; with the first, the bucket's tokens, different words, and counts of their subword ids."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sums: dict[bytes, int] = {}
        lists = []
        for packed, counts in zip(rows.words, rows.counts, strict=True):
            size = int.from_bytes(packed[:8], "little")
            words = pa.decompress(packed[8:], size, codec="zstd", asbytes=True).split(b"\n") if size else [END]
            lists.append(words)
            for w, c in zip(words, _unzip(counts, np.int64).tolist(), strict=True):
                sums[w] = sums.get(w, 0) + c
        known = {w: c for w, c in sums.items() if c}
        ids = encoder(path).encode([w.decode() for w in known])
        both = np.bincount(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64), np.repeat(list(known.values()), [len(x) for x in ids]) if known else None)
        at = np.flatnonzero(both)
        out = [_zip(np.fromiter(map(sums.__getitem__, words), np.int64, len(words))) for words in lists]
        only = lambda x, rest: [x] + [rest] * (len(rows) - 1)
        return pd.DataFrame({"block": rows.block, "places": rows.places, "counts": out, "tokens": only(sum(known.values()), 0), "words": only(len(known), 0), "ends": only(known.get(END, 0), 0), "ids": only(at, []), "id_counts": only(both[at].astype(np.int64), [])})

    return run


def _based(total: int, different: int):
    floor = math.log10(total + different + 1)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows[rows.doc_ids.notna()].iloc[0]
        own = rows[rows.doc_ids.isna()]
        ids = _unzip(docs.places, np.uint32)
        counts = np.zeros(int(ids.max()) + 1, np.int64)
        for places, c in zip(own.places, own.counts, strict=True):
            counts[_unzip(places, np.uint32)] = _unzip(c, np.int64)
        lengths = np.asarray(docs.n_tokens, np.int64)
        of = np.repeat(np.arange(len(lengths)), lengths)
        scores = np.bincount(of, np.log10(counts + 1.0)[ids], len(lengths)) - lengths * floor
        known = np.bincount(of, counts[ids] > 0, len(lengths)).astype(np.int64)
        return pd.DataFrame({"doc_id": docs.doc_ids, "text_key": docs.text_keys, "held_out": docs.held, "n_tokens": lengths, "n_known": known, "train_tokens": total, "base_score": scores})

    return run


def word_tables(docs: DataFrame, path: str, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents with the words in them, and the whole corpus's counts of each block's words."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(shuffle_partitions(spark), chars // BUCKET_CHARS + 1)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), held_out(F.col("doc_id")).alias("held"), "text")
    listed = scratch(plain.mapInPandas(_listed(n_buckets, block_words), _LISTED), "listed")
    words = listed.where("kind = 'w'").select("bucket", "block", "words", "places", "counts")
    summed = words.groupBy("bucket").applyInPandas(_summed(path), "block string, places binary, counts binary, tokens long, words long, ends long, ids array<long>, id_counts array<long>")
    return listed, scratch(summed, "summed")


def base_scores(listed: DataFrame, summed: DataFrame) -> DataFrame:
    """doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score of each row, from the word tables."""
    sizes = summed.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    columns = ["block", "places", "counts", "doc_ids", "text_keys", "held", "n_tokens"]
    lists = listed.where("kind = 'd'").select(*columns)
    back = summed.select("block", "places", "counts", *(F.lit(None).cast(lists.schema[c].dataType).alias(c) for c in columns[3:]))
    whole = lists.union(back)
    rows = whole.groupBy("block").applyInPandas(_based(sizes.tokens or 0, sizes.words or 0), "doc_id long, text_key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def subword_counts(summed: DataFrame) -> tuple[pd.DataFrame, int]:
    """id, n over all training texts (one row an id of the tokenizer, at most), and the number of training texts."""
    each = summed.select(F.explode(F.arrays_zip("ids", "id_counts")).alias("x"))
    return each.groupBy(F.col("x.ids").alias("id")).agg(F.sum("x.id_counts").alias("n")).toPandas(), summed.agg(F.sum("ends")).first()[0] or 0


def _sequences(coder, texts: list[str | None], end: int) -> list[np.ndarray]:
    return [np.append(x, np.uint32(end)) for x in coder.encode(texts)]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text_key, held (kept from training), ids (packed, end included) of each row of docs (doc_id, text); a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        end = coder.tokenizer.get_vocab_size()
        for rows in batches:
            for lo in range(0, len(rows), 128):
                some = rows.iloc[lo : lo + 128]
                yield some.drop(columns="text").assign(ids=[_zip(x) for x in _sequences(coder, some.text.tolist(), end)])

    doc_id = F.col("doc_id").cast("long")
    plain = docs.select(doc_id.alias("doc_id"), F.xxhash64("text").alias("text_key"), held_out(doc_id).alias("held"), "text")
    return scratch(plain.mapInPandas(run, "doc_id long, text_key long, held boolean, ids binary"), "ids")


def _trained(vocabulary: Vocabulary, model: Attention, turn: int):
    """This partition's weights after a pass over all windows of its texts (packed ids), times the windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), 0
        texts: list[np.ndarray] = []
        current, held = model, 0

        def passed() -> None:
            nonlocal current, total, held
            w = Windows(texts, vocabulary)
            current = current.trained([w.rows, w.valid, w.wanted, vocabulary.class_of[w.targets].astype(np.int64)], seed=turn)
            total += len(w.rows)
            texts.clear()
            held = 0

        for rows in batches:
            for packed in rows.ids:
                texts.append(_unzip(packed, np.uint32))
                held += len(texts[-1])
                if held >= PASS_IDS:
                    passed()
        if texts:
            passed()
        if total:
            flat = current.pack() * total
            yield pd.DataFrame({"slot": [part % SLOTS[0]], "weights": [flat.astype(np.float64).tobytes()], "n": [total]})

    return run


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    sums = np.frombuffer(rows.weights.iloc[0]).copy()
    for w in rows.weights.iloc[1:]:
        sums += np.frombuffer(w)
    return pd.DataFrame({"slot": [rows.slot.iloc[0] % SLOTS[1]], "weights": [sums.tobytes()], "n": [rows.n.sum()]})


class Language:
    """A trained model: vocabulary, weights, and the id that ends a text."""

    def __init__(self, path: str, vocabulary: Vocabulary, model: Attention, end: int):
        self.path, self.vocabulary, self.model, self.end = path, vocabulary, model, end

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and number of ids, end included, of each text."""
        return self.score_ids(_sequences(encoder(self.path), texts, self.end))

    def score_ids(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that are encoded."""
        w = Windows(ids, self.vocabulary)
        logs = self.model.class_scores(w, self.vocabulary.class_of[w.targets]) + self.vocabulary.log_share[w.targets]
        sums = np.bincount(w.text, (logs * w.wanted).sum(1, dtype=np.float64), len(ids))
        return sums / math.log(10), np.array([len(x) for x in ids])


def learned(docs: DataFrame, path: str, counts: pd.DataFrame, n_docs: int, rounds: int = ROUNDS) -> Language:
    """A model of the texts of docs, all of which may be learned from; counts: of their subword ids."""
    return learned_from(encoded(docs, path).select("ids"), path, counts, n_docs, rounds)


def learned_from(texts: DataFrame, path: str, counts: pd.DataFrame, n_docs: int, rounds: int = ROUNDS) -> Language:
    """The same from texts that are encoded (ids)."""
    from tokenizers import Tokenizer

    end = Tokenizer.from_file(path).get_vocab_size()
    table = np.zeros(end + 1, np.int64)
    table[counts.id.to_numpy(np.int64)] = counts.n
    table[end] = n_docs
    vocabulary = Vocabulary(table)
    model = Attention.fresh(vocabulary.log_class)
    for turn in range(rounds):
        some = texts.mapInPandas(_trained(vocabulary, model, turn), "slot int, weights binary, n long")
        for _ in SLOTS:
            some = some.groupBy("slot").applyInPandas(_averaged, "slot int, weights binary, n long")
        sums = some.toPandas()
        if len(sums):
            model = model.unpacked(sum(np.frombuffer(w) for w in sums.weights) / sums.n.sum())
    return Language(path, vocabulary, model, end)


def scored(texts: DataFrame, language: Language) -> DataFrame:
    """doc_id, text_key, score, n_ids of each row of texts (doc_id, text_key, ids), which are encoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lo in range(0, len(rows), 128):
                some = rows.iloc[lo : lo + 128]
                score, n = language.score_ids([_unzip(x, np.uint32) for x in some.ids])
                yield some.drop(columns="ids").assign(score=score, n_ids=n)

    return texts.select("doc_id", "text_key", "ids").mapInPandas(run, "doc_id long, text_key long, score double, n_ids long")


def scores(docs: DataFrame, path: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids of each row.

    docs: doc_id, text; other columns are ignored. A null text is empty: one token, its end. Rows that repeat count
    as often as they occur and get the same scores. With no training rows, all counts are 0 and the model is unigram.
    A text of any length is one row of ids, whose windows are worked on in batches. An empty table gives an empty result.
    """
    listed, summed = word_tables(docs, path)
    base = base_scores(listed, summed)
    texts = encoded(docs, path)
    language = learned_from(texts.where("NOT held").select("ids"), path, *subword_counts(summed), rounds)
    model = scored(texts, language).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "score", "n_ids")
    joined = base.join(model, base.doc_id.eqNullSafe(model["__id"]) & (base.text_key == model["__key"]))
    return joined.drop("__id", "__key", "text_key")
