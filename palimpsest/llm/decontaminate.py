"""Benchmark decontamination: SimHash of item-sized windows, Hamming index, exact verification.

For each benchmark item there is a fingerprint of its word shingles. Each window of a document that is as many words
long as an item gets a fingerprint from running sums of shingle bits. 128 bits are cut into 8 blocks of 16: of two
fingerprints within a radius of 31, some block differs in 3 bits at most, so a table of all values within 3 bits of an
item's finds all such pairs; of random fingerprints it lets pass 8 in 100. They are verified by the weighted Jaccard
similarity of their shingles, a shingle weighing as often as it occurs.

Windows that hold no shingle of any item have similarity 0 to all of them and are not fingerprinted.
"""

from __future__ import annotations

import string
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.byte_units import slices
from palimpsest.llm.common import MIX, WordHashes, prepare, shingles, texts, written

BITS, BLOCKS, WIDTH = 128, 8, 16
#: Punctuation at the ends of a word doesn't count.
ENDS = string.punctuation + "“”‘’«»…–—¿¡"

_words = WordHashes(lambda token: token.strip(ENDS).lower())


def signs(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits made of each shingle hash."""
    more = (values ^ (values >> np.uint64(32))) * MIX
    both = np.stack([values, more ^ (more >> np.uint64(29))], axis=1)
    bits = np.unpackbits(both.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of BLOCKS numbers: a bit is set where the sum is positive."""
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1, bitorder="little")).view("<u2")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def weighted_similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


class Items:
    """Index of a bounded number of items. Items without words are in none."""

    def __init__(self, ids: list, item_texts: list[str], threshold: float, radius: int, size: int):
        self.threshold, self.radius, self.size = threshold, radius, size
        self.groups: dict[int, dict] = {}  # by shingle size: size, or the words of a shorter item
        for i, x in zip(ids, item_texts):
            words = _words.of(x)
            if len(words):
                k = min(size, len(words))
                own = shingles(words, k)
                g = self.groups.setdefault(k, {"items": [], "known": {}})
                at = len(g["items"])
                g["items"].append((i, len(own), Counter(own.tolist())))
                for v in set(own.tolist()):
                    g["known"].setdefault(v, set()).add(len(own))
        within = radius // BLOCKS  # if all blocks differed in more bits than this, the distance would be over the radius
        every = np.arange(1 << WIDTH, dtype=np.uint16)
        masks = every[np.bitwise_count(every) <= within]
        at, places = 0, []
        for k, g in self.groups.items():
            g["values"] = np.array(sorted(g["known"]), dtype=np.uint64)
            g["table"] = np.zeros(1 << 20, dtype=bool)
            g["table"][(g["values"] >> np.uint64(44)).astype(np.int64)] = True
            g["lengths"] = {}
            for n in sorted({n for _, n, _ in g["items"]}):  # items of a length stand in bytes of their own
                rows = [j for j, (_, m, _) in enumerate(g["items"]) if m == n]
                prints = np.concatenate([packed(signs(np.fromiter(g["items"][j][2].elements(), np.uint64)).sum(axis=0, keepdims=True)) for j in rows])
                wide = -(-len(rows) // 8)
                g["lengths"][n] = rows, prints, slice(at, at + wide)
                places.append((prints, at))
                at += wide
        self.near = np.zeros((BLOCKS, 1 << WIDTH, at), dtype=np.uint8)  # for each block and its value, a bit for each item
        for prints, first in places:
            for j, own in enumerate(prints):
                for b, value in enumerate(own):
                    self.near[b, masks ^ value, first + j // 8] |= np.uint8(1 << j % 8)

    def candidates(self, prints: np.ndarray, entry) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in entry, distance) of all fingerprints within the radius."""
        _, own, columns = entry
        maybe = self.near[0, prints[:, 0], columns]
        for b in range(1, BLOCKS):
            maybe |= self.near[b, prints[:, b], columns]
        at, which = np.nonzero(np.unpackbits(maybe, axis=1, bitorder="little", count=len(own)))
        distance = distances(prints[at], own[which])
        near = distance <= self.radius
        return at[near], which[near], distance[near]

    def search(self, text: str):
        """(item id, first word, words, distance, similarity) of the best window for each item that the text holds."""
        words = _words.of(text)
        for k, g in self.groups.items():
            if len(words) < k:
                continue
            own = shingles(words, k)
            hits = np.flatnonzero(g["table"][(own >> np.uint64(44)).astype(np.int64)])
            if not len(hits):
                continue
            values = g["values"]
            at = np.minimum(np.searchsorted(values, own[hits]), len(values) - 1)
            hits = hits[values[at] == own[hits]]
            if not len(hits):
                continue
            spots: dict[int, list[int]] = {}
            for p in hits.tolist():
                for n in g["known"][int(own[p])]:
                    spots.setdefault(n, []).append(p)
            best: dict[int, tuple] = {}
            for n, where in spots.items():
                span = min(n, len(own))
                if span < self.threshold * n - 1e-9:
                    continue
                for a, b in self._ranges(where, span, len(own)):
                    sums = np.zeros((b - a + span, BITS), dtype=np.int32)
                    np.cumsum(signs(own[a : b + span - 1]), axis=0, out=sums[1:])
                    prints = packed(sums[span:] - sums[:-span])
                    rows = g["lengths"][n][0]
                    found = self.candidates(prints, g["lengths"][n])
                    for w, j, far in zip(*(x.tolist() for x in found)):
                        item, _, weights = g["items"][rows[j]]
                        score = weighted_similarity(Counter(own[a + w : a + w + span].tolist()), weights)
                        if score >= self.threshold - 1e-9 and (rows[j] not in best or (score, -far, -a - w) > best[rows[j]][0]):
                            best[rows[j]] = (score, -far, -a - w), item, a + w, span + k - 1
            for (score, far, _), item, first, count in best.values():
                yield item, first, count, -far, score

    @staticmethod
    def _ranges(where: list[int], span: int, total: int, most: int = 4096):
        """Runs [a, b) of window starts that cover a hit, none longer than `most`."""
        runs: list[list[int]] = []
        for p in where:
            a, b = max(0, p - span + 1), min(p, total - span) + 1
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            elif a < b:
                runs.append([a, b])
        for a, b in runs:
            for x in range(a, b, most):
                yield x, min(b, x + most)


_indexes: dict[str, Items] = {}


def _index(held, threshold: float, radius: int, size: int) -> Items:
    """One for each worker process and block of items; the one before goes."""
    name, ids, item_texts = held.value
    if (at := (name, threshold, radius, size)) not in _indexes:
        _indexes.clear()
        _indexes[at] = Items(ids, item_texts, threshold, radius, size)
    return _indexes[at]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 31, size: int = 5, block_bytes: int = 16 << 20, block_items: int = 1024, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id, first_word, n_words, distance, similarity: the best window of each document for each item in it.

    The benchmark is the query set: its size is measured, and it is searched in as many blocks of about block_bytes of text
    and block_items items as that takes (an index has up to half a megabyte for each item whose length no other has), each
    against all documents, one after the other. Documents are neither shuffled nor gathered. A window at similarity 0.8
    differs in about 19 of 128 bits; the default radius is 2.9 standard deviations above that.

    Null texts are empty and hold nothing; null keys stay; repeated rows give their pairs again; items without words
    match nothing; ties go to the earliest window. An empty table on either side gives no rows. Other columns are
    ignored.
    """
    docs = texts(docs, key, text)
    schema = f"{key} long, {item} long, first_word long, n_words long, distance long, similarity double"

    def search(held):
        def run(batches):
            index = _index(held, threshold, radius, size)
            for batch in batches:
                found = []
                for i, part in slices(batch.column(1)):
                    names = batch.column(0).slice(i, len(part)).to_pylist()
                    for name, x in zip(names, part):
                        found += [(name, *f) for f in index.search(x)]
                if found:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*found))[:5]), pa.array([f[5] for f in found], pa.float64())], names=[key, item, "first_word", "n_words", "distance", "similarity"])

        return docs.mapInArrow(run, schema)

    out = None
    for held, only in _blocks(docs.sparkSession, benchmark, block_bytes, block_items, item, item_text):
        part = search(held) if only else _done(search(held), held)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 31, size: int = 5, block_bytes: int = 16 << 20, block_items: int = 1024, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item as find_leaks finds them. Narrow.

    A null text is empty and stays; null keys and repeated rows are judged by their text like all others; items without
    words match nothing. An empty benchmark takes nothing away; an empty table stays empty.
    """

    def clean(held):
        def run(batches):
            index = _index(held, threshold, radius, size)
            for batch in batches:
                stays = [next(index.search(x or ""), None) is None for _, part in slices(batch.column(batch.schema.names.index(text))) for x in part]
                yield batch.filter(pa.array(stays, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    for held, only in _blocks(docs.sparkSession, benchmark, block_bytes, block_items, item, item_text):
        docs = clean(held) if only else _done(clean(held), held)
    return docs


def _done(found: DataFrame, held) -> DataFrame:
    """Written, so that its block of items can go."""
    out = written(found, "block")
    held.destroy()
    return out


def _blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int, block_items: int, item: str, item_text: str):
    """Broadcasts of as many blocks as the measured benchmark takes, made one at a time, and whether it is the only one."""
    prepare(spark)
    items = texts(benchmark, item, item_text)
    size, count = items.agg(F.sum(F.octet_length(item_text)), F.count("*")).first()
    n = 1 + max((size or 0) // block_bytes, max(0, count - 1) // block_items)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64(item, item_text), F.lit(n)) == b).collect()
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, [r[0] for r in rows], [r[1] for r in rows])), n == 1
