"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.byte_units import Pieces, slices
from palimpsest.llm.common import prepare, texts

_counters: dict[str, Pieces] = {}


def _counter(vocabulary: str) -> Pieces:
    if vocabulary not in _counters:
        _counters[vocabulary] = Pieces(vocabulary)
    return _counters[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row.

    Texts are cut at safe boundaries and the distinct pieces encoded in batches balanced by bytes, so one very long
    text costs no more memory than its own pieces. Nothing is shuffled. Null text: empty, 0 tokens. Null keys,
    repeated rows and ties stay as they are; an empty table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        count = _counter(vocabulary)
        for batch in batches:
            n: list[int] = []
            for _, part in slices(batch.column(1)):
                n += count.lengths(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    rows = texts(docs, key, text)
    rows = rows.withColumn("n_bytes", F.octet_length(text).cast("long"))
    return rows.mapInArrow(run, f"{key} long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
