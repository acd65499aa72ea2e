"""Compression classifier: zstandard with a dictionary of good text against one with a dictionary of bad text.

A text is cut into blocks, and each is compressed with either dictionary. What the bad one makes larger than the good one,
normalised by the size of the text, says which of them it resembles; one logistic curve fitted to the labelled sample makes
a probability of that number (calibration).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.byte_units import slices
from palimpsest.llm.common import prepare, texts

BLOCK, LEVEL = 1024, 9
#: Counted beside each block's bytes, so that a few bytes say little.
MARGIN = 16


def held_out(key: str = "doc_id"):
    """True for the fifth of keys that nothing is learned from; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """Two dictionaries and the curve. Without both labels in the sample (no dictionaries) the score is `prior` for all texts."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad = (self._with(d) if d else None for d in (model.good, model.bad))

    @staticmethod
    def _with(data: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def difference(self, text: str) -> float:
        """Compressed size with the bad dictionary less that with the good one, over the size of the whole text."""
        data = text.encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, max(1, len(data)), BLOCK)]
        return sum(len(self.bad.compress(b)) - len(self.good.compress(b)) for b in blocks) / (len(data) + MARGIN * len(blocks))

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        if self.good is None:
            return np.full(len(texts), m.prior)
        x = np.array([self.difference(t) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(m.offset + m.slope * x, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps; the ridge bounds the slope where the labels are told apart."""
    scale = x.std() + 1e-9
    rows, w, penalty = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2), np.array([ridge, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(penalty), rows.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def middle(data: bytes | str, most: int):
    """`most` of the middle, or all of it."""
    return data[max(0, (len(data) - most) // 2) :][:most]


def dictionary(texts: list[str], most_bytes: int) -> bytes:
    """An equal share of the bytes of every text, from its middle; short texts leave some of theirs unused."""
    share = max(1, most_bytes // max(1, len(texts)) - 1)
    return b"\n".join(middle(t.encode("utf-8", "surrogatepass"), share) for t in texts)[:most_bytes]


def fit_texts(rows: list[tuple[str, int]], dictionary_bytes: int = 112_640, sampled: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Every second row of a label goes into its dictionary, the others into the calibration.

    sampled: the shares of all bad and of all good labels that rows were drawn from; scores are for the odds of all.
    """
    kinds = {k: [t for t, y in rows if y == k] for k in (0, 1)}
    bad, good = (len(kinds[k]) / sampled[k] for k in (0, 1))
    prior = good / (bad + good) if rows else 1.0
    if min(map(len, kinds.values())) < 4:
        return Model(b"", b"", 0.0, 0.0, prior)
    model = Model(*(dictionary(kinds[k][::2], dictionary_bytes) for k in (1, 0)), 0.0, 0.0, prior)
    scorer = Scorer(model)
    used = [(scorer.difference(t), k) for k, own in kinds.items() for t in own[1::2]]
    model.slope, model.offset = _calibrate(*(np.array(c, dtype=float) for c in zip(*used)))
    model.offset += float(np.log(sampled[0] / sampled[1]))  # from the odds of the sample to those of all labels
    return model


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 1500, most_chars: int = 32_768, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from a bounded sample of labelled rows that are not held out; empty texts teach nothing.

    most_rows: rows of each label, those of the least hashes; the calibration is for the odds of all labels that are not
    held out, whatever most_rows leaves of each. most_chars: of a longer text its middle is learned from. So at most
    2 * most_rows * most_chars characters come to the driver, whatever the input's size. Null keys and labels are left out;
    of rows of one key the least text counts; a key with both labels teaches both. No labels or no rows: see Model.
    """
    labels = labels.select(F.col(key).cast("long").alias(key), F.col(label).cast("int").alias("_label")).where(~held_out(key) & F.col(key).isNotNull() & F.col("_label").isin(0, 1)).distinct()
    docs = texts(docs, key, text).where((F.length(text) > 0) & ~held_out(key))
    start = F.greatest(F.floor((F.length(text) - most_chars) / 2), F.lit(0)).cast("int") + 1
    docs = docs.withColumn(text, F.substring(text, start, F.lit(most_chars)))
    counts = {r[0]: r[1] for r in labels.groupBy("_label").count().collect()}
    sampled = tuple(min(1.0, most_rows / counts.get(kind, 1)) for kind in (0, 1))
    own = [labels.where(F.col("_label") == kind).orderBy(F.xxhash64(key), key).limit(most_rows) for kind in (0, 1)]
    # twice most_rows keys of 8 bytes
    found = docs.join(F.broadcast(own[0].union(own[1])), key).groupBy(key, "_label").agg(F.min(text).alias("t"))
    return fit_texts([(r[0], r[1]) for r in found.orderBy(key, "_label").select("t", "_label").toLocalIterator()], sampled=sampled)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of each row.

    The score depends on the whole text alone. Narrow: nothing is shuffled. A null text is an empty one, and an empty
    one has difference 0; null keys, ties and repeated rows stay as they are; an empty table gives an empty result; other
    columns are ignored.
    """
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)  # two dictionaries of 110 KB and three numbers

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(scorer, batch.column(1)), pa.float64())], names=[key, "score"])

    out = texts(docs, key, text).mapInArrow(run, f"{key} long, score double")
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold. Narrow.

    Nulls, ties, repeated rows and empty tables are as in `score`: rows of equal texts stay or go together.
    """
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(_scored(scorer, batch.column(batch.schema.names.index(text))) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _scored(scorer: Scorer, column) -> np.ndarray:
    return np.concatenate([np.empty(0), *(scorer.scores([t or "" for t in part]) for _, part in slices(column))])
