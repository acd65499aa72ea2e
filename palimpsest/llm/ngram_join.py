"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. One pass makes of each text its set of word-shingle hashes, the set's digest and MinHash bands.
2. Texts with one digest are one class of copies; only classes go on.
3. Classes that share a band are tied to the least class of that band, and these ties' components hold all candidates.
4. A component is cut into blocks of bounded size; each pair of blocks is one small piece of work. There MinHash
   values are compared a few at a time, a pair is dropped once the posterior probability that it reaches the threshold
   is below a tolerance, and the rest are verified on their exact sets. A piece returns counts and one tie per class,
   never its pairs.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.byte_units import slices
from palimpsest.llm.common import MIX, WordHashes, prepare, shingles, texts, written
from palimpsest.llm.graph import components, hot_join

ROWS, BANDS, STEP = 5, 32, 16
HASHES = ROWS * BANDS
#: Copies of a text that make its class a large one.
HOT = 1000
_rng = np.random.Generator(np.random.PCG64(20))
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

_words = WordHashes(str.lower)


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` lower-cased white-space-separated words."""
    return np.unique(shingles(_words.of(text), size))


def minhash(values: np.ndarray) -> np.ndarray:
    """HASHES minima; all ones for an empty set."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 512):  # stays in the processor's cache
        part = low[i : i + 512] ^ _XOR[:, None]
        part *= _ODD[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        keys = (keys ^ column.astype(np.uint64)) * MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def digest(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes(), usedforsecurity=False).digest()


def needed(threshold: float, tolerance: float) -> list[int]:
    """For n compared values, the fewest matches that keep a pair.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), and its mass above t equals the
    chance of at most m successes in n + 1 trials of t.
    """
    out = []
    for n in range(HASHES + 1):
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def similar_pairs(sets: list[np.ndarray], signatures: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float):
    """Of the index pairs (left, right) those of Jaccard similarity >= threshold, exactly, but for pruning errors."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    keep = (small >= threshold * large - 1e-9) & (small > 0)
    left, right = left[keep], right[keep]
    matches, least = np.zeros(len(left), np.int64), needed(threshold, tolerance)
    for n in range(0, HASHES, STEP):
        if not len(left):
            break
        matches += (signatures[left, n : n + STEP] == signatures[right, n : n + STEP]).sum(axis=1)
        keep = matches >= least[n + STEP]
        left, right, matches = left[keep], right[keep], matches[keep]
    found = np.zeros(len(left), dtype=bool)
    order = np.argsort(left, kind="stable")
    cuts = np.flatnonzero(np.diff(left[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        own = sets[left[rows[0]]]
        others = [sets[j] for j in right[rows]]
        both = np.concatenate(others)
        at = np.searchsorted(own, both)
        at[at == len(own)] = 0
        starts = np.cumsum([0, *map(len, others)])[:-1]
        common = np.add.reduceat(own[at] == both, starts, dtype=np.int64)
        union = len(own) + sizes[right[rows]] - common
        found[rows] = common >= threshold * union - 1e-9
    return left[found], right[found]


def _signed(size: int, key: str):
    def run(batches):
        for batch in batches:
            digests, counts, bands = [], [], []
            for _, part in slices(batch.column(1)):
                for x in part:
                    values = shingle_set(x, size)
                    digests.append(digest(values))
                    counts.append(len(values))
                    bands.append(band_keys(minhash(values)) if len(values) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), batch.column(2)], names=[key, "digest", "n_shingles", "bands", "text_hash"])

    return run


def _with_sets(size: int):
    """text, digest, ... -> the same rows with the set and the signature instead of the text."""

    def run(batches):
        for batch in batches:
            want = batch.column(1).to_pylist()
            kept, sets, signatures = [], [], []
            for i, part in slices(batch.column(0)):
                for j, x in enumerate(part, i):
                    values = shingle_set(x, size)
                    if digest(values) == want[j]:  # another row may have the same key
                        kept.append(j)
                        sets.append(values.tobytes())
                        signatures.append(minhash(values).tobytes())
            rows = batch.select(batch.schema.names[1:]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())], names=[*rows.schema.names, "values", "signature"])

    return run


LINKED = "copy_of long, digest binary, n_texts long, n_docs long, peer_of long, peer binary"


def _compared(threshold: float, tolerance: float):
    """Sorted rows of (piece, block) -> for each class with links in a piece: counts and the piece's least linked class."""

    def piece(rows: list[dict]):
        rows = list({r["digest"]: r for r in rows}.values())
        blocks = np.array([r["block"] for r in rows])
        low, high = rows[0]["low"], rows[0]["high"]
        if low == high:
            left, right = np.triu_indices(len(rows), 1)
        else:
            left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(blocks == low), np.flatnonzero(blocks == high), indexing="ij"))
        sets = [np.frombuffer(r["values"], np.uint64) for r in rows]
        signatures = np.stack([np.frombuffer(r["signature"], np.uint32) for r in rows])
        left, right = similar_pairs(sets, signatures, left, right, threshold, tolerance)
        if not len(left):
            return []
        copies = np.array([r["copies"] for r in rows])
        n_texts, n_docs = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for a, b in ((left, right), (right, left)):
            np.add.at(n_texts, a, 1)
            np.add.at(n_docs, a, copies[b])
        names = [(r["copy_of"], r["digest"]) for r in rows]
        by_rank = sorted(range(len(rows)), key=lambda i: (names[i][0] is None, *names[i]))
        rank = np.argsort(by_rank)
        label = rank.copy()
        while True:  # least rank over links
            new = label.copy()
            np.minimum.at(new, left, label[right])
            np.minimum.at(new, right, label[left])
            new = np.minimum(new, new[by_rank][new])
            if (new == label).all():
                break
            label = new
        return [(*names[i], int(n_texts[i]), int(n_docs[i]), *names[by_rank[label[i]]]) for i in np.flatnonzero(n_texts)]

    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in LINKED.split(", ")]

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in ("root", "low", "high")):
                    out += piece(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if held and (out := piece(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def ngram_join(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6, block_texts: int = 128, block_shingles: int = 400_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id, copy_of, n_copies, n_links, n_text_links.

    Two documents are linked if the Jaccard similarity of their sets of `size`-word shingles is at least threshold.
    class_id is the least key of all documents that links join, copy_of the least key of those with an equal set,
    n_copies their number, n_links the number of other documents this one is linked to, n_text_links the number of
    other sets. A pair at the threshold is missed with a chance under 1e-5 (bands: (1 - 0.8^5)^32; pruning: tolerance
    at each step); nothing is capped.

    Nulls: a null text is empty; a null key is kept, and never chosen as an id while another exists. Empty texts are
    copies of each other. Repeated rows are documents of their own. An empty table gives an empty result. Other
    columns are ignored.
    """
    return _joined(docs, threshold, size, tolerance, block_texts, block_shingles, key, text).drop("text_hash")


def _joined(docs: DataFrame, threshold: float, size: int, tolerance: float = 1e-6, block_texts: int = 128, block_shingles: int = 400_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ngram_join with a hash of each row's text, which tells rows of one key apart."""
    prepare(docs.sparkSession)
    docs = texts(docs, key, text)
    signed = docs.withColumn("text_hash", F.xxhash64(text)).mapInArrow(_signed(size, key), f"{key} long, digest binary, n_shingles long, bands array<bigint>, text_hash long")
    signed = written(signed, "signed")
    classes = signed.groupBy("digest").agg(F.min(key).alias("copy_of"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")

    banded = classes.select("digest", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = banded.join(least, "band").where("digest <> least").select(F.col("digest").alias("a"), F.col("least").alias("b")).distinct()
    near = components(ties)

    members = near.join(classes.drop("bands"), near["node"] == classes["digest"]).select("digest", "root", "copy_of", F.col("n_copies").alias("copies"), "n_shingles")
    totals = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("total") / block_shingles)).cast("int")
    large = totals.select("root", blocks.alias("blocks")).where("blocks > 1")  # the few components that are more than one block
    members = hot_join(members, large, "root", "digest").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))

    wanted = members.select("copy_of", "digest", "root", "blocks", "block", "copies")
    found = docs.join(wanted, docs[key].eqNullSafe(wanted["copy_of"])).select(text, "digest", "copy_of", "root", "blocks", "block", "copies")
    sets = found.mapInArrow(_with_sets(size), "digest binary, copy_of long, root binary, blocks int, block int, copies long, values binary, signature binary")
    pieces = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pieces = pieces.select("digest", "copy_of", "root", "block", "copies", "values", "signature", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    pieces = pieces.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    linked = written(pieces.mapInArrow(_compared(threshold, tolerance), LINKED), "linked")

    # nodes in the order of their keys, null ones last, so that a component's root has the class id
    node = lambda of, digest: F.struct(F.col(of).isNull().alias("none"), F.coalesce(of, F.lit(0)).alias("of"), F.col(digest).alias("digest"))
    groups = components(linked.select(node("copy_of", "digest").alias("a"), node("peer_of", "peer").alias("b")))
    groups = groups.select("node.digest", F.when(~F.col("root.none"), F.col("root.of")).alias("class_id"))
    counts = linked.groupBy("digest").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    about = classes.select("digest", "copy_of", "n_copies").join(groups, "digest", "left").join(counts, "digest", "left")
    about = about.select("digest", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", "n_copies", (F.col("n_copies") - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"), F.coalesce("n_texts", F.lit(0).cast("long")).alias("n_text_links"))
    about = written(about, "about")
    names = ["class_id", "copy_of", "n_copies", "n_links", "n_text_links"]
    # one class may hold a third of all rows: large ones are few, and are sent to many places
    both = hot_join(signed.select(key, "text_hash", "digest"), about.where(F.col("n_copies") > HOT), "digest", key, F.spark_partition_id())
    rest = both.where("n_copies IS NULL").select(key, "text_hash", "digest").join(about.where(F.col("n_copies") <= HOT), "digest")
    return both.where("n_copies IS NOT NULL").select(key, "text_hash", *names).union(rest.select(key, "text_hash", *names))


def one_of_each(docs: DataFrame, threshold: float = 0.8, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class: those with the class's least key.

    Rows that share that key and text are one; of a class's rows of its least key with different texts, each text stays.
    Documents of a null key stay only where their class has no other key. An empty table gives an empty result.
    """
    kept = _joined(docs, threshold, size, key=key, text=text).where(F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("_kept"), F.col("text_hash").alias("_hash")).distinct()
    own = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.join(kept, F.col(key).eqNullSafe(F.col("_kept")) & (own == F.col("_hash")), "left_semi").dropDuplicates([key, text])
