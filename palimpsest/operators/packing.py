"""Packing chunks into containers, and reading them out of one."""

from __future__ import annotations

import gzip
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ids import numbered
from palimpsest.schemas import CHUNK_HEADER

MOST = 250 * 1024


def route(entropy: Column, threshold: float = 1.0) -> Column:
    """The stream a chunk goes to: compressed, or stored as it is where its bytes look random."""
    return F.when(entropy <= threshold, F.lit("comp")).otherwise(F.lit("store"))


def filter_argument(size: int, codec: str, cipher: str | None = None) -> str:
    return ":".join([str(size), codec, *([cipher] if cipher else [])])


def container_name(digest: Column) -> Column:
    """The file name that goes with a container's digest."""
    return F.concat(F.hex(digest), F.lit(".#"))


def interned(df: DataFrame, column: str, name: str = "filter_index") -> tuple[DataFrame, DataFrame]:
    """df with a dense index (from 0, in order of value) instead of the column, and the dictionary (index, value).

    Filters are few: a size and a codec each. Whatever their number, they are numbered without a global sort in one task.
    """
    words = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], name, 0)
    return df.join(words, column, "left").drop(column), words


def max_container_size(filters: Column) -> Column:
    return F.max(F.substring_index(filters, ":", 1).cast("int"))


def next_fit(chunks: DataFrame, order: list[str], most: int = MOST, group: list[str] | None = None, size: str = "size", header: int = CHUNK_HEADER) -> DataFrame:
    """chunks with container (from 0 within its group) and offset: a chunk that doesn't fit opens the next container.

    The fold is sequential within a group, so groups are what runs in parallel: one group is the plain sequential
    result, more of them (a hash bucket in `group`) scale. A task streams its sorted rows and holds two numbers.
    A chunk larger than a container gets one of its own.
    """
    group = group or []
    names = [*chunks.columns, "container", "offset"]
    sizes, keys = names.index(size), [names.index(g) for g in group]

    def run(batches):
        now, number, used = None, 0, 0
        for batch in batches:
            numbers, offsets = [], []
            values = batch.column(sizes).to_pylist()
            own = list(zip(*(batch.column(i).to_pylist() for i in keys))) if keys else [()] * len(values)
            for n, key in zip(values, own):
                if key != now:
                    now, number, used = key, 0, 0
                if used and used + n + header > most:
                    number, used = number + 1, 0
                numbers.append(number)
                offsets.append(used)
                used += n + header
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], names=names)

    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(chunks.schema.fields)).add("container", LongType()).add("offset", LongType())
    dealt = chunks.repartition(*group) if group else chunks.coalesce(1)
    return dealt.sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def running_offset(df: DataFrame, group: str | list[str], order: str | list[str], size: str = "size", header: int = CHUNK_HEADER, name: str = "offset") -> DataFrame:
    """Bytes before each row in its group; header bytes stand before each."""
    group, order = ([x] if isinstance(x, str) else x for x in (group, order))
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.col(size).cast("bigint") + header).over(w), F.lit(0).cast("bigint")))


def moving_average(df: DataFrame, value: str, group: str | list[str], order: str | list[str], rows: int = 32, name: str = "average") -> DataFrame:
    """The mean of the last `rows` values up to each row of its group."""
    group, order = ([x] if isinstance(x, str) else x for x in (group, order))
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(1 - rows, 0)))


def encode(raw: bytes, codec: str) -> bytes:
    if codec == "none":
        return raw
    if codec == "zlib":
        return zlib.compress(raw, 9)
    if codec == "gzip":
        return gzip.compress(raw, 9, mtime=0)
    if codec == "zstd":
        import zstandard

        return zstandard.compress(raw, 9)
    raise ValueError(f"unknown codec {codec!r}")


def decode(blob: bytes, codec: str) -> bytes:
    if codec == "none":
        return blob
    if codec == "zlib":
        return zlib.decompress(blob)
    if codec == "gzip":
        return gzip.decompress(blob)
    if codec == "zstd":
        import zstandard

        return zstandard.decompress(blob)
    raise ValueError(f"unknown codec {codec!r}")


def pack_chunks(chunks: list[tuple[bytes, bytes]]) -> bytes:
    """sha1 and size before each chunk's bytes."""
    return b"".join(x for sha1, data in chunks for x in (sha1, struct.pack("<H", len(data)), data))


def unpack_chunks(raw: bytes):
    """(offset, sha1, data) of each chunk."""
    at = 0
    while at < len(raw):
        (n,) = struct.unpack_from("<H", raw, at + 20)
        yield at, raw[at : at + 20], raw[at + CHUNK_HEADER : at + CHUNK_HEADER + n]
        at += CHUNK_HEADER + n


def build_containers(placed: DataFrame, codecs: dict[str, str], most: int = MOST) -> DataFrame:
    """stream, bucket, container, filter, sha256, n_chunks, raw_size, blob from rows with stream, bucket, container, offset, sha1, data.

    Rows of a container are streamed in order of offset; a task holds one container at a time.
    """
    key = ["stream", "bucket", "container"]

    def done(now, own):
        raw = pack_chunks(own)
        codec = codecs[now[0]]
        return [(*now, filter_argument(most, codec), hashlib.sha256(raw).digest(), len(own), len(raw), encode(raw, codec))]

    def run(batches):
        now, own, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[:3] != now:
                    if own:
                        yield rows(done(now, own))
                    now, own = row[:3], []
                own.append((row[4], row[5]))
        if own:
            yield rows(done(now, own))

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    names = [*key, "filter", "sha256", "n_chunks", "raw_size", "blob"]
    rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    dealt = placed.select(*key, "offset", "sha1", "data").repartition(*key).sortWithinPartitions(*key, "offset")
    return dealt.mapInArrow(run, "stream string, bucket int, container bigint, filter string, sha256 binary, n_chunks bigint, raw_size bigint, blob binary")


def open_containers(containers: DataFrame) -> DataFrame:
    """container_id, offset, sha1, data, error of every chunk in (container_id, filter, sha256, blob); each blob is decoded once.

    error is NULL, or says what is wrong with the container; its chunks are then missing.
    """

    def run(batches):
        for batch in batches:
            for number, how, digest, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                try:
                    raw = decode(blob, how.split(":")[1])
                    if hashlib.sha256(raw).digest() != digest:
                        raise ValueError("corruption detected")
                    out = [(number, *x, None) for x in unpack_chunks(raw)]
                except Exception as e:  # reported as a row
                    out = [(number, None, None, None, str(e) or type(e).__name__)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()))], names=["container_id", "offset", "sha1", "data", "error"])

    return containers.select("container_id", "filter", "sha256", "blob").mapInArrow(run, "container_id bigint, offset bigint, sha1 binary, data binary, error string")
