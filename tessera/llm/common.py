"""What several operators of this package share: reading tables, scratch tables in the shared folder, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the rolling hashes; any odd 64-bit numbers whose predecessor has few factors of two do.
ROLL_A = 0x9E3779B97F4A7C15 | 1
ROLL_B = 0xD6E8FEB86659FD93 | 1
#: Stands for a null doc_id inside packed lists, whose numbers a null would turn into floats.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run on this machine (tests), a folder of this session."""
    jsc = spark.sparkContext._jsc.sc()
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return jsc.getCheckpointDir().get()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors, has known sizes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wrapped(df: DataFrame, *own: str) -> DataFrame:
    """row (a struct of all of df's columns), and the columns named: whatever else df has can't clash with what an operator adds; select row.* in the end."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *own)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a number of words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers[base] = tuple(out)
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit; x is overwritten."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def rolling(hashes: np.ndarray, window: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash, modulo 2**64, of the words i to i + window - 1, for each i that has so many."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    out = sums[window:] - sums[:-window]
    out *= down[: len(out)]
    return mixed(out)
