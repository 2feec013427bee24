"""Benchmark decontamination: which documents contain which test items.

Containment search by MinHash.  An item's sketch is the least hashes of its shingles, as
many as are needed so that a text with the wanted share of the shingles cannot miss them
all; so no item is lost.  Items are partitioned by size: each class has its own ceiling
of sketch values and its least number of shingles, which are held against the document's
before any lookup.  Candidates are verified by the shingles themselves.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import fixed, native_words, small_side, text_key, whole_row

SHINGLE = 5
THRESHOLD = 0.8


def _width(words: Column, most: int) -> Column:
    return F.least(F.size(words), F.lit(most))


def _runs(words: str, width: int, value) -> Column:
    """``value`` of every run of ``width`` words of the array column ``words``."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(words) - width), lambda i: value(*[F.get(words, i + k) for k in range(width)])
    )
    return F.when(F.size(words) >= width, each)


def _hashes(words: Column) -> Column:
    """A hash of each word; hashes of shingles are made from these, so that words are hashed once."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def item_shingles(items: DataFrame, shingle: int = SHINGLE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``width``, ``shingle``: the distinct shingles of every item.  An item of
    fewer words is one shingle of its width; an item without words has none."""
    worded = items.select(F.col(item_id).alias("item"), native_words(F.lower(text)).alias("w"))
    parts = [
        worded.where(_width(F.col("w"), shingle) == k).select("item", F.lit(k).alias("width"), F.explode(_runs("w", k, _joined)).alias("shingle"))
        for k in range(1, shingle + 1)
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """``item``, ``width``, ``need``, ``size_class`` and the sketch values ``h`` of items."""
    sized = shingles.groupBy("item", "width").agg(
        F.array_sort(F.collect_set(F.xxhash64(_hashes(F.split("shingle", " "))))).alias("hs"), F.count(F.lit(1)).alias("n")
    )
    need = F.ceil(F.col("n") * threshold - 1e-9)
    return sized.select(
        "item", "width", need.alias("need"), F.floor(F.log2("n")).cast("int").alias("size_class"),
        F.explode(F.slice("hs", 1, (F.col("n") - need + 1).cast("int"))).alias("h"),
    )


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, item_id: str = "item_id") -> DataFrame:
    """``_ka``, ``_kb`` (the key of a text), ``item``, ``n_shared``, ``n_shingles`` of all
    pairs of a text of ``docs`` and an item of which it has ``threshold`` of the shingles.

    Words are lower-cased, shingles are counted once.  Null and empty texts and items have
    none and match nothing; equal texts are one, repeated items stay apart by their id.
    """
    shingles = fixed(item_shingles(items, shingle, item_id))
    keys = fixed(sketches(shingles, threshold))
    classes = keys.groupBy("width", "size_class").agg(F.max("h").alias("top"), F.min("need").alias("least")).collect()
    worded = docs.select(*text_key(), _hashes(native_words(F.lower("text"))).alias("_w"))
    out = None
    for width in sorted({c["width"] for c in classes}):
        own = [c for c in classes if c["width"] == width]
        # a size class can only be met below its ceiling and by a text with enough shingles
        open_ = lambda h: reduce(or_, [(h <= c["top"]) & (F.size("_w") - (width - 1) >= c["least"]) for c in own])  # noqa: B023, E731
        hashes = F.filter(_runs("_w", width, F.xxhash64), open_)
        hashed = worded.select("_ka", "_kb", F.size("_w").alias("_n"), F.explode(hashes).alias("h"))
        side = small_side(keys.where(F.col("width") == width).select("h", "item", "need"))
        met = hashed.join(side, "h").where(F.col("_n") - (width - 1) >= F.col("need"))
        met = met.select("_ka", "_kb", "item")
        out = met if out is None else out.unionByName(met)
    if out is None:
        return worded.where(F.lit(False)).select(
            "_ka", "_kb", F.lit(None).cast(items.schema[item_id].dataType).alias("item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_shingles")
        )
    candidates = fixed(out.distinct())
    texts = small_side(fixed(candidates.select("_ka", "_kb").distinct()))
    chosen = docs.select(*text_key(), "text").join(texts, ["_ka", "_kb"], "left_semi").dropDuplicates(["_ka", "_kb"])
    chosen = fixed(chosen.select("_ka", "_kb", native_words(F.lower("text")).alias("_w")))
    # each pair asks for its own item's shingles: a shingle that many items share makes no further pairs
    asked = candidates.join(small_side(shingles), "item")
    runs = [chosen.select("_ka", "_kb", F.lit(k).alias("width"), F.explode(F.array_distinct(_runs("_w", k, _joined))).alias("shingle")) for k in sorted({c["width"] for c in classes})]
    # of a text's shingles only those of some item are shuffled
    some = small_side(shingles.select("width", "shingle").distinct())
    have = reduce(DataFrame.unionByName, runs).join(some, ["width", "shingle"], "left_semi").withColumn("_has", F.lit(1))
    counted = asked.join(have, ["_ka", "_kb", "width", "shingle"], "left").groupBy("_ka", "_kb", "item").agg(
        F.count("_has").alias("n_shared"), F.count(F.lit(1)).alias("n_shingles")
    )
    return counted.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text) that contain no item.

    Null and empty texts contain none; without items all rows stay.  Columns keep their names
    and values; any names are allowed."""
    found = small_side(fixed(find_items(docs, items).select("_ka", "_kb").distinct()))
    keyed = docs.select(whole_row(docs), *text_key())
    return keyed.join(found, ["_ka", "_kb"], "left_anti").select("row.*")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = fixed(find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    named = docs.select("doc_id", *text_key()).join(small_side(found), ["_ka", "_kb"])
    return named.select(
        "doc_id", F.col("item").alias("item_id"), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


ORACLE_SQL = """
WITH items AS (
  SELECT item_id, list_distinct([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') for i in range(1, len(w) - least(len(w), 5) + 2)]) AS s
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[^ \\x09-\\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
docs AS (
  SELECT doc_id, [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] AS s
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\x09-\\x0D]+') AS w FROM documents) WHERE len(w) >= 5),
pieces AS (SELECT item_id, len(s) AS n_shingles, unnest(s) AS piece FROM items),
parts AS (SELECT doc_id, unnest(s) AS piece FROM docs)
SELECT doc_id, item_id, count(DISTINCT piece) AS n_shared, n_shingles, count(DISTINCT piece) / n_shingles AS containment
FROM parts JOIN pieces USING (piece) GROUP BY doc_id, item_id, n_shingles
HAVING count(DISTINCT piece) >= ceil(n_shingles * 0.8 - 1e-9)
"""
