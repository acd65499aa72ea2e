"""Token ids as binary files: patched frame-of-reference blocks inside Parquet segments.

A segment is one Parquet row: whole documents, in order, whose ids run through blocks of BLOCK ids. A block stores its
minimum, packs the differences from it at the width that WITHIN of them fit, and keeps the rest, with their
places, in an exception list. The segment indexes where each block starts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.byte_units import Pieces, slices
from palimpsest.llm.common import new_path, prepare, texts

BLOCK, WITHIN = 1024, 0.9
HEADER = struct.Struct("<IHHI")  # minimum, ids, exceptions, width
SEGMENT = "file int, segment int, first long, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, block_starts binary, payload binary"


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    kept = int(np.partition(rest, k := max(0, int(np.ceil(WITHIN * len(rest))) - 1))[k])
    width = kept.bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    head = HEADER.pack(low, len(ids), len(odd), width)
    body = b""
    if width:
        bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        body = np.packbits(bits, bitorder="little").tobytes()
    return head + body + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, n, n_odd, width = HEADER.unpack_from(data, at)
    at += HEADER.size
    rest = np.zeros(n, dtype=np.uint32)
    if width:
        size = (n * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        wide = np.zeros((n, 32), dtype=np.uint8)
        wide[:, :width] = bits
        rest = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)
        at += size
    if n_odd:
        where = np.frombuffer(data, "<u2", n_odd, at)
        rest[where] = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    return rest + np.uint32(low)


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Block starts (unsigned 32-bit offsets) and payload."""
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.empty(0)
    return np.asarray(starts, dtype="<u4").tobytes(), b"".join(blocks)


def unpack(block_starts: bytes, payload: bytes) -> np.ndarray:
    starts = np.frombuffer(block_starts, "<u4")
    return np.concatenate([unpack_block(payload, int(s)) for s in starts]) if len(starts) else np.empty(0, np.uint32)


def unpack_range(block_starts: bytes, payload: bytes, first: int, count: int) -> np.ndarray:
    """Ids first to first + count - 1, reading only the blocks that hold them."""
    starts = np.frombuffer(block_starts, "<u4")
    a, b = first // BLOCK, min(len(starts), -(-(first + count) // BLOCK))
    if count <= 0 or a >= b:
        return np.empty(0, np.uint32)
    return np.concatenate([unpack_block(payload, int(starts[i])) for i in range(a, b)])[first - a * BLOCK :][:count]


_encoders: dict[str, Pieces] = {}


def _encoder(vocabulary: str) -> Pieces:
    """One for each worker process: a module's function is found by name there, while a closure would bring a copy."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Pieces(vocabulary)
    return _encoders[vocabulary]


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, segment_ids: int = 1 << 16, key: str = "doc_id", text: str = "text") -> str:
    """Encodes the texts in ascending key order, end_id after each, into Parquet segments under path.

    The one shuffle range-partitions the texts by key; each task then sorts and streams its range. Null text: only
    the end id. A null key comes first; rows with equal keys are ordered by text. An empty table gives no segments.
    A document longer than a segment makes its own.
    """
    prepare(docs.sparkSession)

    def run(batches):
        encode, file = _encoder(vocabulary).encode, TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        keys, lens, parts, held, first, segment = [], [], [], 0, 0, 0

        def close():
            nonlocal keys, lens, parts, held, first, segment
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.uint32)
            starts, payload = pack(ids)
            row = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([starts], pa.binary()), pa.array([payload], pa.binary())], names=["file", "segment", "first", "n_ids", "doc_ids", "doc_lens", "block_starts", "payload"])
            keys, lens, parts, held, first, segment = [], [], [], 0, first + len(ids), segment + 1
            return row

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, part in slices(batch.column(1)):
                for name, values in zip(names[i : i + len(part)], encode(part)):
                    data = values + end
                    n = len(data) // 4
                    if held and held + n > segment_ids:
                        yield close()
                    keys.append(name)
                    lens.append(n)
                    parts.append(data)
                    held += n
        if keys:
            yield close()

    rows = texts(docs, key, text).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), text)
    rows.mapInArrow(run, SEGMENT).write.option("compression", "uncompressed").parquet(path)
    return path


def read_tokens(segments: DataFrame, ids: bool = False, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the segments."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                all_ids = unpack(row["block_starts"], row["payload"]).astype("<u4")
                ends = np.cumsum(row["doc_lens"])
                starts = ends - np.asarray(row["doc_lens"])
                own = [all_ids[a:b] for a, b in zip(starts, ends)]
                columns = [pa.array([row["file"]] * len(own), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["doc_lens"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                if ids:
                    columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["file", key, "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    docs = segments.mapInArrow(run, f"file int, {key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * ids)
    # one row for each file the writer made, so as many as it had partitions, whatever the input's size
    files = segments.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return docs.join(F.broadcast(before), "file").select(key, (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def token_output(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files into the shared folder and returns what is read back from them."""
    spark = prepare(docs.sparkSession)
    path = write_tokens(docs, new_path(spark, "tokens"), vocabulary, end_id, key=key, text=text)
    return read_tokens(spark.read.schema(SEGMENT).parquet(path), key=key)
