"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by how often the whole corpus has them, rarest first.  A block that
has the wanted share of a template's tokens must have one of its first few, so only
texts with such a token are looked at (prefix filter); blocks with too few tokens
(length filter) and pairs whose common token comes too late in both orders (positional
filter) are dropped before the sets are compared.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordering import positions
from fleetlens.llm.text import fixed, small_side, text_key, with_facts

# fixed values: phrases that are looked up as they stand, and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: sentences of common licenses and their labels
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
THRESHOLD = 0.85  # share of a template's distinct tokens that a block must have
STEP = 64  # blocks are 128 words, one every 64, for templates of up to 64 words; twice that for up to 128, and so on
LISTED = 2_000  # template tokens that are held as a list in expressions; beyond that they are joined
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Words of the lower-cased text: digits, letters and all beyond ASCII; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def template_sets(templates: DataFrame) -> DataFrame:
    """``template``, ``label``, ``words`` (distinct tokens) and ``step`` (half the block length, the least
    power of two from ``STEP`` on that its words fit in) of a table of ``label``, ``text``.

    Templates without a token or a label say nothing; the same one twice is one."""
    own = templates.select("label", tokens(F.col("text")).alias("w")).where("label IS NOT NULL AND size(w) > 0").distinct()
    step = F.greatest(F.lit(STEP), F.pow(F.lit(2), F.ceil(F.log2(F.size("w")))).cast("int"))
    # of two templates with equal tokens and label the shorter block finds whatever the longer one does not
    sets = own.groupBy("label", F.array_sort(F.array_distinct("w")).alias("words")).agg(F.collect_set(step).alias("steps"))
    return sets.select(F.xxhash64("label", "words").alias("template"), "label", "words", F.explode("steps").alias("step"))


def token_ranks(worded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``w``, ``rank`` of the template tokens ``w``: from the rarest to the most common one in all rows of ``worded``."""
    words = worded.select(F.explode("_words").alias("w")).join(small_side(vocabulary), "w", "left_semi")
    counts = vocabulary.join(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w", "left")
    placed = positions(counts.select("w", F.coalesce("n", F.lit(0)).alias("n")), [], [F.col("n"), F.col("w")], "rank")
    return placed.select("w", (F.col("rank") - 1).cast("int").alias("rank"))


def _places(phrase: str) -> Column:
    """Where the words of a phrase stand one after the other in ``_words``."""
    parts = phrase.split()
    last = F.size("_words") - len(parts)
    here = lambda i: reduce(and_, [F.get("_words", i + k) == p for k, p in enumerate(parts)])
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame, keep: list[str], text: str = "text", threshold: float = THRESHOLD, templates: DataFrame | None = None, listed: int = LISTED
) -> DataFrame:
    """The columns ``keep`` of every row with its counts, phrase places, labels and score.

    ``templates`` (label, text; the built-in sentences by default) may be a table of any size.  ``score`` is
    1 with a phrase, else the best containment of a template at or above the threshold, else 0.
    Labels are a matter of the text alone: equal texts share them.
    """
    spark = docs.sparkSession
    sets = fixed(template_sets(spark.createDataFrame(TEMPLATES, "label string, text string") if templates is None else templates))
    vocabulary = fixed(sets.select(F.explode("words").alias("w")).distinct())
    worded = docs.select(*keep, *text_key(text), tokens(F.col(text)).alias("_words"))
    ranks = fixed(token_ranks(worded, vocabulary))
    ordered = sets.select("template", "label", "step", F.explode("words").alias("w")).join(ranks, "w")
    ordered = ordered.groupBy("template", "label", "step").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    need = F.ceil(F.size("ranks") * threshold - 1e-9).cast("int")
    first = F.slice("ranks", F.lit(1), F.size("ranks") - F.col("need") + 1)
    prefix = fixed(ordered.withColumn("need", need).select("template", "label", "step", "ranks", "need", F.posexplode(first).alias("i", "rank")))
    steps = sorted(r["step"] for r in sets.select("step").distinct().collect()) or [STEP]  # a few powers of two
    order = [r["w"] for r in ranks.orderBy("rank").collect()] if ranks.count() <= listed else None
    anchors = prefix.select("rank").distinct().join(ranks, "rank").select("w")
    phrases = ["cc", "general", "rights"]

    near = worded.withColumn("_n", F.size("_words").cast("long"))
    if order is not None:
        held = sorted({r["w"] for r in anchors.collect()} | set(phrases))
        near = near.withColumn("_words", F.when(F.exists("_words", lambda w: w.isin(held)), F.col("_words")))
    else:
        some = small_side(fixed(anchors.union(spark.createDataFrame([(w,) for w in phrases], "w string")).distinct()))
        hits = worded.select("_ka", "_kb", F.explode(F.array_distinct("_words")).alias("w")).join(some, "w", "left_semi")
        hits = fixed(hits.select("_ka", "_kb").distinct().withColumn("_hit", F.lit(True)))
        near = near.join(small_side(hits), ["_ka", "_kb"], "left").withColumn("_words", F.when(F.col("_hit"), F.col("_words"))).drop("_hit")
    found = near.withColumns({f"_p{k}": F.coalesce(_places(p), F.array().cast("array<int>")) for k, p in enumerate(PHRASES)})
    # narrow rows, with the words of the few texts that have an anchor
    found = fixed(found)
    every = F.concat(*[F.col(f"_p{k}") for k in range(len(PHRASES))])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(v)) for k, v in enumerate(PHRASES.values())])))

    blocks = found.where(F.col("_words").isNotNull()).select("_ka", "_kb", "_words").dropDuplicates(["_ka", "_kb"])
    if order is not None:
        span = lambda step: F.transform(
            F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / step).cast("int")), lambda i: F.struct(F.lit(step).alias("step"), i.alias("block"))
        )
        blocks = blocks.withColumn("at", F.explode(F.flatten(F.array(*[span(s) for s in steps])))).select("_ka", "_kb", "_words", "at.step", "at.block")
        own = F.filter(F.array_distinct(F.slice("_words", F.col("block") * F.col("step") + 1, 2 * F.col("step"))), lambda w: w.isin(order))
        placed = F.transform(own, lambda w: (F.array_position(F.lit(order), w) - 1).cast("int"))
        blocks = blocks.select("_ka", "_kb", "step", "block", F.sort_array(placed).alias("b"))
    else:
        # a word stands in the block that begins at or before it and in the one before that
        spread = blocks.select("_ka", "_kb", F.posexplode("_words").alias("pos", "w")).join(small_side(ranks), "w")
        spread = spread.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
        spread = spread.withColumn("block", F.explode(F.array(*[F.floor(F.col("pos") / F.col("step")).cast("int") - k for k in (0, 1)]))).where("block >= 0")
        blocks = spread.groupBy("_ka", "_kb", "step", "block").agg(F.array_sort(F.collect_set("rank")).alias("b"))
    met = blocks.select("_ka", "_kb", "step", "block", "b", F.posexplode("b").alias("j", "rank")).join(small_side(prefix), ["rank", "step"])
    met = met.where(F.size("b") >= F.col("need")).where(1 + F.least(F.size("ranks") - F.col("i"), F.size("b") - F.col("j")) - 1 >= F.col("need"))
    shared = F.size(F.array_intersect("b", "ranks"))
    verified = met.where(shared >= F.col("need")).select("_ka", "_kb", "label", (shared / F.size("ranks")).alias("share"))
    labelled = verified.groupBy("_ka", "_kb").agg(F.collect_set("label").alias("_more"), F.max("share").alias("_share"))
    out = with_facts(found.drop("_words"), fixed(labelled), ["_ka", "_kb"], keep)
    n_base = F.size(every).cast("long")
    return out.select(
        *keep,
        F.col("_n").alias("n_words"),
        n_base.alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        base.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, F.coalesce("_more", F.array().cast("array<string>"))))).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, ["doc_id"]).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
