"""Reading tables, writing shared intermediate tables, and the word-hash kernel the similarity operators share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.ids import scratch, shared_dir

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


#: Rows here are whole texts, and a worker may hold several batches: Arrow's are bounded by bytes, those of a scan by rows.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package; a cluster ships it with --py-files."""
    for name, size in BATCHES.items():
        if spark.conf.get(name, None) is None:  # a setting of the user's own stays
            spark.conf.set(name, size)
    env = spark.sparkContext.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns the operators need; a null text is an empty one."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


written = scratch


MIX = np.uint64(0x9E3779B97F4A7C15)


class Remembered(dict):
    """Word -> what was computed for it, within a bound of bytes.

    Two generations: the younger becomes the older once it holds half of the bound, and a word that is asked for again moves
    back. So words of one use pass through while frequent ones stay. A word longer than LONGEST isn't kept.
    """

    def __init__(self, compute, most_bytes: int):
        super().__init__()
        self.compute, self.most_bytes = compute, most_bytes
        self.old: dict = {}
        self.bytes = 0

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= LONGEST:
            if self.bytes > self.most_bytes // 2:
                self.old, self.bytes = dict(self), 0
                self.clear()
            self.bytes += ENTRY + len(word)
            self[word] = value
        return value


#: Bytes of an entry beside its word (the objects' heads, the value, its place in the table); characters of a word that is kept.
ENTRY, LONGEST = 200, 256


class WordHashes(dict):
    """Token -> 64-bit hash of its normal form, remembered up to a bound of bytes. 0 stands for a token without a normal form."""

    def __init__(self, normal, most_bytes: int = 96 << 20):
        super().__init__()
        self.normal, self.most = normal, most_bytes // ENTRY  # a hash is as quickly made as looked up in an older table

    def __missing__(self, token: str) -> int:
        word = self.normal(token)
        value = (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(token) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[token] = value
        return value

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        out = np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        return out if out.all() else out[out != 0]


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash for each run of `size` words, in order; a shorter text is one shingle, an empty one has none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return out
