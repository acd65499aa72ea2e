"""Canonical exact digests, by DataFrame functions alone.

A text is put into Unicode compatibility composition, case-folded, its white space folded, and hashed to 128 bits.
Texts of one bucket are compared byte by byte; should two different ones ever share a bucket, the bucket's digests
get a SHA-256 suffix. So two fingerprints are equal exactly if the canonical texts are, and likeness is 1 or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import texts, written

NORMALIZER, CASES = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def canonical(text: Column) -> Column:
    """Composed (NFKC), case-folded, with each run of white space as one space and none at the ends."""
    nfkc = lambda c: F.reflect(F.lit(NORMALIZER), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.reflect(F.lit(CASES), F.lit("foldCase"), nfkc(text), F.lit(True)))
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), SPACES, " "))


def wide_hash(text: Column) -> Column:
    """128 bits as 32 hexadecimal digits: two runs of xxhash64 with seeds of their own."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), text)), 16, "0") for seed in (1, 2))))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, fingerprint and canonical text of each row, without the comparison inside buckets."""
    rows = texts(docs, key, text).withColumn("canonical", canonical(F.col(text)))
    return rows.select(key, F.char_length(text).cast("long").alias("n_chars"), wide_hash(F.col("canonical")).alias("fingerprint"), "canonical")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with k0, k1, k2: the id, and hashes that tell rows of one id apart by text (and a null id from any other)."""
    rows = texts(docs, key, text)
    return rows.select(key, F.col(text).alias("text"), F.coalesce(key, F.lit(-(2**63))).alias("k0"), *(F.xxhash64(F.lit(s), F.col(key).isNull(), F.col(text)).alias(f"k{s}") for s in (1, 2)))


K = ["k0", "k1", "k2"]


def _ring(rows: DataFrame) -> DataFrame:
    """Each distinct (k0, k1, k2) of (k0, k1, k2, n_chars) in order, with the row before it (p0, p1, p2, p_chars).

    The first one's predecessor is the last. The order comes from range partitions; only each partition's last row
    is brought together, so as many rows as there are partitions.
    """
    ranged = rows.groupBy(*K).agg(F.first("n_chars").alias("n_chars")).repartitionByRange(*K)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    me = F.struct(*K, "n_chars")
    lasts = ranged.groupBy("part").agg(F.max(me).alias("last"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.last("last").over(every)).alias("carried"))
    inside = F.lag(me).over(Window.partitionBy("part").orderBy(*K))
    before = ranged.select(*K, "part", inside.alias("inside")).join(F.broadcast(lasts), "part")  # a row per partition
    before = before.select(*K, F.coalesce("inside", "carried").alias("p"))
    return before.select(*K, *(F.col(f"p.k{i}").alias(f"p{i}") for i in range(3)), F.col("p.n_chars").alias("p_chars"))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text is the text whose last floor(n_chars / 4) code points are replaced by the first as many (or all)
    of the next one in ascending key order; the last is followed by the first.

    Each text is shuffled once, and a quarter of the next one goes to it. Texts are streamed past hash tables of what is
    joined to them (a place, and that quarter, for each of a partition's texts), so whole texts are never sorted.

    A null text is empty; a null key comes first; rows of one key are ordered by a hash of their text and repeated
    rows share their place and result. A single row follows itself; an empty table gives an empty result. Other columns
    are ignored.
    """
    rows = _keyed(docs, key, text)
    base = written(rows.select(*K, key, F.char_length("text").cast("long").alias("n_chars"), wide_hash(canonical(F.col("text"))).alias("fingerprint")), "base")
    shared = base.groupBy("fingerprint").agg((F.count("*") > 1).alias("shared")).where("shared")
    own = base.groupBy(*K).agg(F.first(key).alias(key), F.first("fingerprint").alias("fingerprint")).join(shared, "fingerprint", "left")
    places = written(_ring(base.select(*K, "n_chars")).join(own, K), "places")

    placed = rows.drop(key).join(places.hint("shuffle_hash"), K)  # all uses below read the same columns of rows, and so share one shuffle of the texts
    heads = placed.select(*(F.col(f"p{i}").alias(f"k{i}") for i in range(3)), F.substring("text", F.lit(1), F.floor(F.col("p_chars") / 4).cast("int")).alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    heads = heads.repartition(*K).dropDuplicates(K)  # one sort, behind the shuffle
    n, q = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    both = placed.join(heads.hint("shuffle_hash"), K).select(key, "text", "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), n - q), "head").alias("edited"))
    both = both.withColumns({"canonical": canonical(F.col("text")), "edited_canonical": canonical(F.col("edited"))})
    out = both.select(
        key, F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", wide_hash(F.col("edited_canonical")).alias("edited_fingerprint"),
        F.when(F.col("canonical") == F.col("edited_canonical"), 1.0).otherwise(0.0).alias("near_edited"), "next_fingerprint", F.sha2(F.col("canonical").cast("binary"), 256).alias("exact"), F.sha2(F.col("edited_canonical").cast("binary"), 256).alias("edited_exact"),
    )

    # Bytes are compared where a bucket has several rows: its least and greatest canonical text differ on a collision.
    bucket = placed.where("shared").select("fingerprint", canonical(F.col("text")).alias("canonical"))
    mixed = bucket.groupBy("fingerprint").agg(F.min("canonical").alias("a"), F.max("canonical").alias("b")).where("a <> b").select(F.col("fingerprint").alias("mixed"))
    out = out.join(mixed, out["fingerprint"] == mixed["mixed"], "left").withColumnRenamed("mixed", "own_mixed")
    mixed = mixed.select(F.col("mixed").alias("other"))
    out = out.join(mixed, out["edited_fingerprint"] == mixed["other"], "left")
    suffixed = lambda c, flag, exact: F.when(F.col(flag).isNull(), F.col(c)).otherwise(F.concat_ws("-", c, exact)).alias(c)
    near_next = F.when((F.col("fingerprint") == F.col("next_fingerprint")) & F.col("own_mixed").isNull(), 1.0).otherwise(0.0).alias("near_next")
    return out.select(key, "n_chars", "edited_sha256", suffixed("fingerprint", "own_mixed", "exact"), suffixed("edited_fingerprint", "other", "edited_exact"), "near_edited", near_next)
