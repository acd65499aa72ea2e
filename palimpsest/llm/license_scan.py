"""License scans by diagonal voting, by DataFrame functions alone.

All rolling word pairs and quadruples of the texts are joined to the places of the same words in license templates. A
match votes for the diagonal (place in the text minus place in the template). A phrase stands where all of its
template's votes fall on one diagonal; a longer template may have words put in or left out, so neighbouring diagonals
are merged and the span is verified by the share of the template's places that it covers. Of sentences that claim the
same words, as sibling licences do, the best covered one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import prepare, texts, written

# The base phrases with their labels, and opening sentences of public licences, in lower case.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
PAIR, QUAD = 2, 4
#: Share of a sentence's quadruples that a span must hold; words a span may gain or lose between neighbouring diagonals.
COVERED, SLACK = 0.6, 3

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def templates(spark: SparkSession, base: dict[str, str], sentences: dict[str, str]) -> DataFrame:
    """template, label, is_base, grams (how many), place, w0..w3 and their hash; a few hundred rows of constants."""
    rows = []
    for number, (phrase, label) in enumerate([*base.items(), *sentences.items()]):
        own, k = phrase.split(), PAIR if number < len(base) else QUAD
        if len(own) < k:
            raise ValueError(f"a template has {k} words at least: {phrase}")
        for place in range(len(own) - k + 1):
            gram = [*own[place : place + k], *[None] * (QUAD - k)]
            quoted = ", ".join("CAST(NULL AS STRING)" if w is None else f"'{w}'" for w in gram)
            rows.append(f"({number}, '{label}', {str(number < len(base)).lower()}, {len(own) - k + 1}, {place}, {quoted})")
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, is_base, grams, place, t0, t1, t2, t3)")
    return table.withColumn("gram", F.when(F.col("t2").isNull(), F.xxhash64("t0", "t1")).otherwise(F.xxhash64("t0", "t1", "t2", "t3")))


def _without_siblings(runs: DataFrame) -> DataFrame:
    """row, label, covered of the spans that don't share most of the shorter one with a better span that stays.

    Best first within each chain of overlapping spans; spans that are equally covered all stay.
    """
    by_start = Window.partitionBy("row").orderBy("start", "stop", "template")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    chains = runs.withColumn("opens", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    chains = chains.withColumn("chain", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chains.groupBy("row", "chain").agg(F.array_sort(F.collect_list(F.struct((-F.col("covered")).alias("order"), "start", "stop", "label", "covered"))).alias("spans"))
    kept = F.expr("""aggregate(spans, slice(spans, 1, 0), (kept, x) -> IF(exists(kept, k -> k.covered > x.covered
        AND 2 * (least(k.stop, x.stop) - greatest(k.start, x.start)) > least(k.stop - k.start, x.stop - x.start)), kept, concat(kept, array(x))))""")
    return chains.select("row", F.explode(kept).alias("span")).select("row", "span.label", "span.covered")


def scan(docs: DataFrame, base: dict[str, str] = BASE, sentences: dict[str, str] = SENTENCES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    n_base counts the places of base phrases, first_word and last_word are their least and greatest start; labels has
    also those of sentences found; score is the greatest share of a found template that stands in the text, 0 if none.
    Templates are constants, so broadcasting them is bounded; they may be of any length. The texts are read once and not
    shuffled: what goes on is a row for each text and one for each vote. A row is known by its key and 128 bits of hash of
    its text, so that nothing depends on how the table is split or read again.

    Null and empty texts have no words; null keys stay; repeated rows are scanned and returned each; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    row = F.struct(F.col(key).alias("key"), *(F.xxhash64(F.lit(s), F.col(text)).alias(f"h{s}") for s in (1, 2))).alias("row")
    rows = texts(docs, key, text).select(row, words(F.col(text)).alias("words"))
    shifted = [F.col("words"), *(F.slice("words", F.lit(i + 1), F.size("words")) for i in range(1, QUAD))]
    head = F.array(F.struct(*(F.lit(None).cast("string").alias(f"w{i}") for i in range(QUAD))))  # at place 0, for the text itself
    grams = rows.select("row", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(head, F.arrays_zip(*(c.alias(f"w{i}") for i, c in enumerate(shifted))))).alias("at", "w"))
    grams = grams.select("row", "n_words", (F.col("at") - 1).alias("at"), "w.*").toDF("row", "n_words", "at", *(f"w{i}" for i in range(QUAD)))
    pair, quad = F.xxhash64("w0", "w1"), F.xxhash64("w0", "w1", "w2", "w3")
    both = F.when(F.col("w3").isNotNull(), F.array(pair, quad)).when(F.col("w1").isNotNull(), F.array(pair)).when(F.col("at") < 0, F.array(F.lit(None).cast("long")))
    hashed = grams.select("*", F.explode(both).alias("_gram"))
    same = (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("t2").isNull() | (F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3")))
    hits = hashed.join(F.broadcast(templates(spark, base, sentences)), (F.col("_gram") == F.col("gram")) & same, "left").where("at < 0 OR template IS NOT NULL")
    hits = written(hits.select("row", "n_words", "at", "template", "label", "is_base", "grams", "place"), "votes")

    votes = hits.where("at >= 0").groupBy("row", "template", "label", "is_base", "grams", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = votes.agg(F.collect_set("place").alias("places"), F.min("at").alias("start"), (F.max("at") + QUAD).alias("stop"))  # no more places than the template has
    exact = votes.where("is_base AND size(places) = grams").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_found"))
    one = Window.partitionBy("row", "template").orderBy("diagonal")
    runs = votes.where("NOT is_base").withColumn("opens", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one), F.lit(SLACK + 1)) > SLACK).cast("int"))
    runs = runs.withColumn("run", F.sum("opens").over(one)).withColumn("place", F.explode("places"))
    runs = runs.groupBy("row", "template", "label", "grams", "run").agg(F.collect_set("place").alias("places"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = runs.withColumn("covered", F.size("places") / F.col("grams")).where(F.col("covered") >= COVERED)
    near = _without_siblings(runs).groupBy("row").agg(F.collect_set("label").alias("near_found"), F.max("covered").alias("covered"))

    none = F.array().cast("array<string>")
    found = hits.where("at < 0").select("row", F.col("row.key").alias(key), "n_words").join(exact, "row", "left").join(near, "row", "left")
    base_found = F.coalesce("base_found", none)
    return found.select(
        key, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.array_join(base_found, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_found, F.coalesce("near_found", none))), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("covered", F.lit(0.0))).alias("score"),
    )
