"""Digests and encodings. SHA, MD5, hex and base 64 are Spark's; Adler-32, base 85 and entropy are Arrow functions."""

from __future__ import annotations

import hashlib
import quopri
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType


def sha1(b: Column) -> Column:
    return F.sha1(b)


def sha256(b: Column) -> Column:
    return F.sha2(b, 256)


@F.pandas_udf(LongType())
def adler32(data: pd.Series) -> pd.Series:
    return data.map(lambda b: zlib.adler32(bytes(b)), na_action="ignore").astype("Int64")


# RFC 1924's alphabet.
ALPHABET = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~", np.uint8)
POWERS = 85 ** np.arange(4, -1, -1, dtype=np.int64)


def _cut(values: pd.Series, step: int, fill: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """The values that aren't null, all of them filled up to whole steps in one array, and how many units each has."""
    own = [bytes(v, "ascii") if isinstance(v, str) else bytes(v) for v in values if v is not None]
    units = np.array([-(-len(v) // step) for v in own], dtype=np.int64)
    return own, np.frombuffer(b"".join(v + fill * (-len(v) % step) for v in own), np.uint8).reshape(-1, step), units


def _dealt(values: pd.Series, data: bytes, units: np.ndarray, step: int, lengths: list[int], text: bool) -> pd.Series:
    parts = ((data[step * (e - u) : step * (e - u) + n]) for e, u, n in zip(np.cumsum(units).tolist(), units.tolist(), lengths))
    return pd.Series([None if v is None else (next(parts).decode() if text else next(parts)) for v in values], dtype=object)


@F.pandas_udf(StringType())
def base85(data: pd.Series) -> pd.Series:
    """Four bytes are five digits, for a whole batch at once; the last group has as many digits less as bytes are missing."""
    own, rows, units = _cut(data, 4, b"\0")
    numbers = np.ascontiguousarray(rows).view(">u4").reshape(-1).astype(np.int64)
    digits = ALPHABET[numbers[:, None] // POWERS % 85]
    return _dealt(data, digits.tobytes(), units, 5, [len(v) + -(-len(v) // 4) for v in own], True)


@F.pandas_udf(BinaryType())
def unbase85(data: pd.Series) -> pd.Series:
    """The inverse of base85."""
    own, rows, units = _cut(data, 5, b"~")
    place = np.full(256, -1, dtype=np.int64)
    place[ALPHABET] = np.arange(85)
    digits = place[rows]
    if (digits < 0).any():
        raise ValueError("not a base 85 digit")
    numbers = digits @ POWERS if len(digits) else np.empty(0, np.int64)
    return _dealt(data, numbers.astype(">u4").tobytes(), units, 4, [len(v) - -(-len(v) // 5) for v in own], False)


def entropy_of(data: bytes) -> float:
    """Shannon entropy of the bytes over 8 bits: 0 for one repeated byte, 1 for evenly spread ones and for no data."""
    if not data:
        return 1.0
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum() / 8)


@F.pandas_udf(DoubleType())
def entropy(data: pd.Series) -> pd.Series:
    return data.map(lambda b: entropy_of(bytes(b)), na_action="ignore").astype("float64")


def derive_key(password: str, salt: bytes, length: int = 32, rounds: int = 600_000) -> bytes:
    """Key from a password, on the driver alone: keys never stand in a plan's text."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, length)


@F.pandas_udf(StringType())
def quoted_printable(text: pd.Series) -> pd.Series:
    return text.map(lambda s: quopri.encodestring(s.encode()).decode(), na_action="ignore")


@F.pandas_udf(StringType())
def from_quoted_printable(text: pd.Series) -> pd.Series:
    return text.map(lambda s: quopri.decodestring(s.encode()).decode("utf-8", "replace"), na_action="ignore")


def hex_dump(b: Column, width: int = 16) -> Column:
    """Lines of `width` bytes in hexadecimal."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.hex(b), "(..)", "$1 "), f"((?:.. ){{{width}}})", "$1\n"))


def digest_of_parts(parts: DataFrame, group: str, order: str, data: str = "data", algorithm: str = "sha1") -> DataFrame:
    """group and digest of each group's parts in order, hashed as they stream by: a group of any size is never held.

    A null part is empty. Groups run in parallel; one group is one task, as its order is what is computed.
    """
    kind = parts.schema[group].dataType

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != (name,):
                    if now:
                        done.append((now[0], state.digest()))
                    now, state = (name,), hashlib.new(algorithm, usedforsecurity=False)
                state.update(value or b"")
            if done:
                yield rows(done, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if now:
            yield rows([(now[0], state.digest())], last)

    rows = lambda done, t: pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], t), pa.array([d[1] for d in done], pa.binary())], names=[group, "digest"])
    dealt = parts.select(group, order, F.col(data).cast("binary").alias("_data")).repartition(group).sortWithinPartitions(group, order)
    return dealt.select(group, "_data").mapInArrow(run, f"{group} {kind.simpleString()}, digest binary")
