"""Content-defined chunking with two thresholds and two divisors over a rolling checksum of 48 bytes.

A chunk ends behind the first place, at least `least` bytes in, whose checksum leaves high - 1 modulo high; failing
that within `most` bytes, behind the last place that leaves low - 1 modulo low; failing that after `most` bytes. The
checksum of a full window depends on its 48 bytes alone, so all full windows of a file come from two prefix sums;
only the first 47 places of each chunk need sums of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions.digests import entropy_of

WINDOW, PRIME = 48, 65521
#: Windows whose checksums are computed at once.
STEP = 1 << 20


@dataclass(frozen=True)
class Tttd:
    """The four numbers of the default, for chunks of 4096 bytes on average."""

    least: int = 1856
    most: int = 11299
    high: int = 2179
    low: int = 1090

    def _values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        b = b % PRIME
        b[b == 0] = PRIME  # that residue stays at the modulus
        return (b << 16) | a

    def _hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of full windows whose checksum leaves high - 1 or low - 1; some MB of the bytes in hand at once."""
        found = [], []
        for first in range(0, len(x) - WINDOW + 1, STEP):
            part = x[first : first + STEP + WINDOW - 1].astype(np.int64)
            at = np.arange(len(part), dtype=np.int64)
            sums, moments = (np.concatenate([[0], np.cumsum(v)]) for v in (part, at * part))
            s, m = sums[WINDOW:] - sums[:-WINDOW], moments[WINDOW:] - moments[:-WINDOW]
            ends = at[WINDOW - 1 :]
            full = self._values(1 + s, WINDOW + (ends + 1) * s - m)
            for own, d in zip(found, (self.high, self.low)):
                own.append(ends[full % d == d - 1] + first)
        return tuple(np.concatenate([np.empty(0, np.int64), *own]) for own in found)

    def cuts(self, data: bytes) -> Iterator[int]:
        """Ends of the chunks, in order."""
        n = len(data)
        x = np.frombuffer(data, np.uint8)
        highs, lows = self._hits(x if n >= self.least + WINDOW else x[:0])
        start = 0
        while start < n:
            end = min(n, start + self.most)
            if end - start > self.least:
                first = start + self.least
                short = x[first : min(end, first + WINDOW - 1)].astype(np.int64)
                a = np.cumsum(short)
                values = self._values(1 + a, np.arange(1, len(short) + 1) + np.cumsum(a))
                end = self._end(first, end, values, highs, lows)
            yield end
            start = end

    def _end(self, first: int, end: int, short: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> int:
        """Where the chunk ends whose checksum begins at `first` and that reaches to `end` at most."""
        hit = np.flatnonzero(short % self.high == self.high - 1)
        if len(hit):
            return first + int(hit[0]) + 1
        rest = first + WINDOW - 1
        i = np.searchsorted(highs, rest)
        if i < len(highs) and highs[i] < end:
            return int(highs[i]) + 1
        i = np.searchsorted(lows, end) - 1
        if i >= 0 and lows[i] >= rest:
            return int(lows[i]) + 1
        hit = np.flatnonzero(short % self.low == self.low - 1)
        return first + int(hit[-1]) + 1 if len(hit) else end


CHUNKERS = {"TTTD": Tttd}


def chunk_rows(df: DataFrame, content: str = "content", chunker: str = "TTTD", data: bool = True, with_entropy: bool = False, **options) -> DataFrame:
    """df without content, and for each chunk pos, offset, size, sha1 (and data, entropy). No chunk for an empty content.

    Narrow: files are independent. Chunks go out in batches of some MB, so one large file is not held twice.
    """
    cutter = CHUNKERS[chunker](**options)
    keep = [f for f in df.schema.fields if f.name != content]
    schema = StructType(list(keep)).add("pos", "long").add("offset", "long").add("size", "integer").add("sha1", "binary")
    schema = schema.add("data", "binary") if data else schema
    schema = schema.add("entropy", "double") if with_entropy else schema
    names = schema.names

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(content)
            kept = batch.select([n for n in batch.schema.names if n != content])
            for i in range(batch.num_rows):
                whole = batch.column(at)[i].as_py() or b""
                own, start, held = [], 0, 0
                for pos, end in enumerate(cutter.cuts(whole)):
                    part = whole[start:end]
                    own.append((pos, start, end - start, hashlib.sha1(part, usedforsecurity=False).digest(), *[part] * data, *[entropy_of(part)] * with_entropy))
                    start, held = end, held + len(part)
                    if held > 8 << 20:
                        yield out(kept, i, own)
                        own, held = [], 0
                if own:
                    yield out(kept, i, own)

    def out(kept, i, own):
        repeated = kept.take(pa.array([i] * len(own), pa.int64()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.binary()] * data, *[pa.float64()] * with_entropy]
        return pa.RecordBatch.from_arrays([*repeated.columns, *(pa.array(c, k) for c, k in zip(zip(*own), kinds))], names=names)

    return df.select(*(f.name for f in keep), content).mapInArrow(run, schema)


def chunk_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """The same shape with one chunk per line (its line break included), by built-in functions alone."""
    lines = F.filter(F.split(F.col(text), "(?<=\n)"), lambda x: x != "")
    return df.withColumn("_lines", lines).selectExpr(*(c for c in df.columns if c != text), "posexplode(_lines) AS (pos, data)").withColumn("size", F.octet_length("data")).withColumn("sha1", F.sha1("data"))


def chunk_fixed(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Chunks of `size` characters, the last one shorter."""
    n = F.ceil(F.char_length(text) / size).cast("int")
    rows = df.where(F.char_length(text) > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("data", F.substring(F.col(text), F.col("pos") * size + 1, F.lit(size)))
    return rows.drop(text).withColumn("size", F.octet_length("data")).withColumn("sha1", F.sha1("data"))
