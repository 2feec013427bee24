"""Near duplicates by SimHash: fingerprints of word shingles, linked by a self-join of
their binary trie.

The trie join starts as a distributed one: a fingerprint goes to every pair of nodes
at some depth whose paths differ in no more bits than the budget, and pairs that hold
too many fingerprints are expanded further, so no task gets more than ``block`` of
them.  Within a task the two subtrees are walked together, level by level, adding up
differing bits and dropping pairs of nodes above the budget.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.components import components
from fleetlens.llm.text import fixed, raw, small_side, text_key, whole_row

SEED = 42
CHUNK = 1 << 17  # shingles whose bits are unpacked at once


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words of a lower-cased text, repeats included; a
    shorter text is one shingle, a text without words has none."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    pieces = map(joined.__getitem__, map(slice, starts, (ends[words - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # eight one-byte counters to a word; they hold 255
        sums = np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit number; zero without words."""
    hashes = shingle_hashes(text, words)
    most = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(most, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row and its ``fingerprint``.

    Null and empty texts have fingerprint zero; repeated rows stay as they are.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    shape = T.StructType([*[docs.schema[c] for c in kept], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t, words) for t in raw(batch.column("_text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], prints], names=[*kept, "fingerprint"])

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, shape)


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let ``labels`` (least member per class) join the classes of a[i] and b[i]."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def walk_tries(prints: np.ndarray, depth: int, low: int, high: int, budget: int, leaf: int = 16) -> np.ndarray:
    """Join the subtrees ``low`` and ``high`` (paths of ``depth`` bits) of the trie of
    sorted distinct ``prints``; the classes that their links make, as least positions."""
    n, labels = len(prints), np.arange(len(prints))
    cut = lambda path: np.searchsorted(prints, np.uint64(path << (64 - depth))) if path < 1 << depth else n
    own = low == high
    # node pairs: first and end of both ranges, differing bits so far
    start = [0, n, 0, n] if depth == 0 else [cut(low), cut(low + 1), cut(high), cut(high + 1)]
    pairs = np.array([[*start, (low ^ high).bit_count()]], np.int64)
    for level in range(depth, 65):
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= (leaf if level < 64 else 1 << 62)
        for at in range(0, int(small.sum()), 1 << 16):
            some = pairs[small][at : at + (1 << 16)]
            left, right = some[:, 1] - some[:, 0], some[:, 3] - some[:, 2]
            each = np.repeat(np.arange(len(some)), left * right)
            k = np.arange(len(each)) - np.repeat(np.cumsum(left * right) - left * right, left * right)
            a, b = some[each, 0] + k // right[each], some[each, 2] + k % right[each]
            near = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= budget)
            _joined(labels, a[near], b[near])
        pairs = pairs[~small]
        if not len(pairs) or level == 64:
            return labels
        bit = np.uint64(1 << (63 - level))
        mask = np.uint64(((1 << (level + 1)) - 1) << (63 - level))
        # where each range goes over to paths with the next bit set
        mid_a = np.searchsorted(prints, (prints[pairs[:, 0]] | bit) & mask)
        mid_b = np.searchsorted(prints, (prints[pairs[:, 2]] | bit) & mask)
        a0, a1, b0, b1, d = pairs.T
        same = own & (a0 == b0) & (a1 == b1)
        nexts = [
            np.stack([a0, mid_a, b0, mid_b, d], 1),
            np.stack([mid_a, a1, mid_b, b1, d], 1),
            np.stack([a0, mid_a, mid_b, b1, d + 1], 1),
            np.stack([mid_a, a1, b0, mid_b, d + 1], 1)[~same],
        ]
        pairs = np.concatenate(nexts)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]
    return labels


def _expanded(frontier: DataFrame, bits: int, budget: int) -> DataFrame:
    """Node pairs ``bits`` levels further down: columns fp, mask (differing bits), depth."""
    masks = [m for m in range(1 << bits) if m.bit_count() <= budget]
    return (
        frontier.withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        .withColumn("mask", F.shiftleft("mask", bits).bitwiseOR(F.col("m")))
        .where(F.bit_count("mask") <= budget)
        .select("fp", "mask", (F.col("depth") + bits).alias("depth"))
    )


def _placed(frontier: DataFrame) -> DataFrame:
    # a shift by 64 would be one by 0, so the path of the root is written out
    own = F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftrightunsigned(fp, 64 - depth) END")
    other = own.bitwiseXOR(F.col("mask"))
    return frontier.withColumns({"low": F.least(own, other), "high": F.greatest(own, other)})


def trie_links(prints: DataFrame, budget: int = 2, block: int = 16384) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct fingerprints ``fp`` just as all pairs
    within ``budget`` bits do; each task passes on a spanning forest of its pairs.

    Paths stay below 60 bits, so that they are positive numbers; a node pair that deep
    holds at most 32 fingerprints.
    """
    n = prints.count()
    depth = min(40, max(0, math.ceil(math.log2(max(n, 1) / (block / 4)))))
    frontier = prints.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).alias("depth"))
    frontier = _placed(_expanded(frontier, depth, budget)) if depth <= 8 else None
    if frontier is None:  # many levels: a few bits at a time keep the lists of masks short
        frontier = prints.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).alias("depth"))
        for at in range(0, depth, 8):
            frontier = _expanded(frontier, min(8, depth - at), budget)
        frontier = _placed(frontier)
    key, ready = ["low", "high", "depth"], None
    while True:
        large = fixed(frontier.groupBy(*key).count().where(F.col("count") > block).drop("count"))
        fits = frontier if large.isEmpty() or depth >= 56 else frontier.join(large, key, "left_anti")
        ready = fits if ready is None else ready.unionByName(fits)
        if fits is frontier:
            break
        depth += 4
        frontier = _placed(_expanded(frontier.join(large, key, "left_semi"), 4, budget))

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(group["fp"].to_numpy().view(np.uint64))
        labels = walk_tries(values, int(key[2]), int(key[0]), int(key[1]), budget)
        linked = labels != np.arange(len(values))
        return pd.DataFrame({"a": values[linked].view(np.int64), "b": values[labels[linked]].view(np.int64)})

    return ready.groupBy(*key).applyInPandas(join, "a long, b long")


def near_duplicates(printed: DataFrame, id_col: str = "doc_id", budget: int = 2) -> DataFrame:
    """Rows of ``printed`` (with ``fingerprint``) and their ``component_id``: the least id
    that a chain of links reaches, itself included.

    Rows of equal fingerprints are linked; a row without an id takes part, and its
    component has the least id there is, or null.  No rows give none.
    """
    same = fixed(printed.groupBy("fingerprint").agg(F.min(id_col).alias("_first")))
    return _named(printed, same, "fingerprint", trie_links(same.select(F.col("fingerprint").alias("fp")), budget))


def _named(rows: DataFrame, same: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """``rows`` with the ``component_id`` that ``links`` between their keys make; ``same`` has
    the least id (``_first``) of each key."""
    stars = components(links).withColumnRenamed("node", "_node")
    classes = same.join(stars, F.col(key) == F.col("_node"), "left").select(
        key, "_first", F.coalesce("root", key).alias("_root")
    )
    least = classes.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return rows.join(classes.join(least, "_root").select(key, "component_id"), key)


def keep_one(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """``docs`` (doc_id, text) with one row of each component of linked fingerprints: that with
    the least id, null ids last, then the least hash of its text.  Of repeated rows one stays.

    Null, empty and blank texts have fingerprint zero and are linked like others.  Columns keep
    their names and values; any names are allowed."""
    named = docs.select("doc_id", "text", *text_key())
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_ka", "_kb")
    key = ["doc_id", "_ka", "_kb"]
    printed = fixed(fingerprints(named, words=words, keep=key).withColumn("rank", rank))
    found = near_duplicates(printed, "rank", budget)
    other = [F.col(c).alias(f"_{i}") for i, c in enumerate(key)]
    gone = small_side(fixed(found.where("rank <> component_id").select(*other).distinct()))
    twice = fixed(printed.groupBy(*key).count().where("count > 1").select(*other))
    keyed = docs.select(whole_row(docs), F.col("doc_id").alias("_kd"), *text_key())
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(("_kd", "_ka", "_kb"))]
    left = keyed.join(gone, same, "left_anti")
    if not twice.isEmpty():
        twice = small_side(twice)
        again = left.join(twice, same, "left_semi").dropDuplicates(["_kd", "_ka", "_kb"])
        left = left.join(twice, same, "left_anti").unionByName(again)
    return left.select("row.*")


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    printed = fixed(fingerprints(docs, keep=["doc_id"]))
    return near_duplicates(printed).select("doc_id", as_hex("fingerprint").alias("fingerprint"), "component_id")
