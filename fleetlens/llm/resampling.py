"""Importance resampling towards a target distribution over hashed features.

Features are runs of words; a feature's bucket is its CRC-32 modulo the number of
buckets.  The CRCs are computed for many features at once: distinct features of equal
length make up a matrix of bytes, whose columns update all CRCs together, and the
buckets are scattered back to where the features stand.  A bucket's gain compares how
often target and corpus use it; a document's weight is the mean gain of its features,
and with Gumbel noise from a hash of its id the highest scores are a draw without
replacement in proportion to exp(weight).

Counts are sums of one array a task, so the shuffle carries at most buckets x tasks
rows.  Ranks come from range-partitioned positions over the drawn rows only.

Defined cases: a null or empty text has no features and weight 0; an empty target or
corpus leaves counts of zero; a null id is hashed like the empty string and comes last
in a tie; repeated rows each count, and have ranks of their own.  Other columns, whatever
their names, are neither read nor changed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.ordering import positions
from fleetlens.llm.text import fixed, raw, spare

BUCKETS = 10_000
SLICE = 1 << 20  # bytes of text that are cut into words at once
DISTINCT = 200_000  # distinct features held before their buckets are counted

# fixed value: bytes of words after A-Z have become a-z; all others separate
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


TABLE = _table()


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature: a byte matrix for each length, one column after the other."""
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order, out = np.argsort(sizes, kind="stable"), np.zeros(len(features), np.uint32)
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        size = int(sizes[places[0]])
        matrix = np.frombuffer(b"".join([features[i] for i in places.tolist()]), np.uint8).reshape(len(places), size)
        state = np.full(len(places), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            state = TABLE[(state ^ column) & 0xFF] ^ (state >> 8)
        out[places] = ~state
    return out


def features(text: bytes | None, most: int = 1) -> Iterator[tuple[int, list[bytes]]]:
    """Words and features of a text, piece by piece: the number of words of a slice, and all
    runs of 1 to ``most`` words that end in it."""
    if not text:
        return
    before: list[bytes] = []
    at = 0
    while at < len(text):
        # a slice ends with the word that its last byte is in
        end = min(at + SLICE, len(text))
        part, step = text[at:end].translate(_WORD), 4096
        while end < len(text) and part[-1:] != b" ":
            more = text[end : end + step].translate(_WORD)
            upto = more.find(b" ") + 1 or len(more)
            part, end, step = part + more[:upto], end + upto, step * 2
        at = end
        words = part.split()
        found, run = list(words), before + words
        for size in range(2, most + 1):
            first = max(0, len(before) - size + 1)
            found += [b" ".join(run[i : i + size]) for i in range(first, len(run) - size + 1)]
        before = run[-(most - 1) :] if most > 1 else []
        yield len(words), found


def bucket_counts(texts: DataFrame, text: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n``: occurrences of features by bucket over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros(buckets, np.int64), Counter()

        def settle():
            if seen:
                np.add.at(totals, crcs(list(seen)) % np.uint32(buckets), np.fromiter(seen.values(), np.int64, len(seen)))
                seen.clear()

        for batch in batches:
            for value in raw(batch.column(0)):
                for _, found in features(value, most):
                    seen.update(found)
                    if len(seen) > DISTINCT:
                        settle()
        settle()
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["bucket", "n"])

    chosen = texts.select(F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths, rounded down; only ``buckets`` counts reach the driver."""
    counts = []
    for table in (corpus, target):
        n = np.zeros(buckets)
        for r in bucket_counts(table, text, most, buckets).collect():
            n[r["bucket"]] = r["n"]
        counts.append(n)
    s, t = counts
    upper, lower = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(x)) for x in (upper / lower).tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, keep: list[str], names: tuple[str, str, str], text: str = "text", most: int = 1) -> DataFrame:
    """The columns ``keep`` and, under ``names``, each row's words, features and weight."""
    source = spare(keep, "text")[0]
    shape = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, T.LongType()) for n in names]])

    def measured(texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), 3), np.int64)  # words, features, sum of gains
        held: list[bytes] = []
        owners: list[tuple[int, int]] = []

        def settle():
            distinct = dict.fromkeys(held)
            value = dict(zip(distinct, gain[crcs(list(distinct)) % np.uint32(len(gain))].tolist()))
            at = 0
            for i, n in owners:
                out[i, 2] += sum(map(value.__getitem__, held[at : at + n]))
                at += n
            held.clear()
            owners.clear()

        for i, value in enumerate(texts):
            for words, found in features(value, most):
                out[i, :2] += (words, len(found))
                owners.append((i, len(found)))
                held.extend(found)
                if len(held) > DISTINCT:
                    settle()
        settle()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, number, total = measured(raw(batch.column(batch.num_columns - 1))).T
            weight = np.where(number > 0, total // np.maximum(number, 1), 0)
            cols = [*[batch.column(i) for i in range(len(keep))], *[pa.array(c) for c in (words, number, weight)]]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([*[batch.schema.field(i) for i in range(len(keep))], *[(n, pa.int64()) for n in names]]))

    return docs.select(*keep, F.col(text).cast("string").alias(source)).mapInArrow(run, shape)


def noisy(weight: Column, id_: Column, seed: int = 2024) -> Column:
    """Weight and Gumbel noise drawn by a hash of the id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def cut(scores: DataFrame, share: int) -> tuple[int, int | None]:
    """How many rows of ``score`` are ``share`` percent, and the least score among the highest so many.

    Scores are whole thousandths of logarithms; their histogram (some ten thousand rows at most) is collected."""
    counts = sorted(((r["score"], r["count"]) for r in scores.groupBy("score").count().collect()), reverse=True)
    wanted = sum(n for _, n in counts) * share // 100
    total = 0
    for score, n in counts:
        total += n
        if wanted and total >= wanted:
            return wanted, score
    return 0, None


def ranked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", share: int = 10, least: int = 20, seed: int = 2024, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``id_col``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` of every row of ``docs``; the
    rank is null for rows that are not drawn.

    Of the rows with at least ``least`` words ``share`` percent are drawn."""
    own = docs.select(F.col(id_col).alias("id"), "text")
    rows = weighted(own, gains(docs, target, "text", most, buckets), ["id"], ("n_words", "n_features", "weight"), "text", most)
    rows = fixed(rows.withColumn("score", noisy(F.col("weight"), F.col("id"), seed)))
    number, lowest = cut(rows.where(F.col("n_words") >= least), share)
    if lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).withColumnRenamed("id", id_col)
    high = (F.col("n_words") >= least) & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "weight", "n_features", F.col("n_words")]
    placed = positions(rows.where(high), [], [F.col(c) if isinstance(c, str) else c for c in order], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= number, F.col("rank").cast("long")))
    rest = rows.where(~high).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(rest.columns).unionByName(rest).withColumnRenamed("id", id_col)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", share: int = 10, least: int = 20, seed: int = 2024, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that :func:`ranked` draws, with all their columns and no others.

    A row is drawn if its score and id come before a cut, so nothing is joined or
    shuffled; rows with score and id of the last one drawn all come along."""
    gain = gains(docs, target, "text", most, buckets)
    names = tuple(spare(docs.columns, "n_words", "n_features", "weight"))
    score = spare([*docs.columns, *names], "score")[0]
    rows = weighted(docs, gain, docs.columns, names, "text", most).withColumn(score, noisy(F.col(names[2]), F.col(id_col), seed))
    able = rows.where(F.col(names[0]) >= least)
    narrow = fixed(able.select(F.col(id_col).alias("id"), F.col(score).alias("score")))
    number, lowest = cut(narrow, share)
    if lowest is None:
        return docs.limit(0)
    above = narrow.where(F.col("score") > lowest).count()
    last = positions(narrow.where(F.col("score") == lowest), [], [F.col("id").asc_nulls_last()], "place").where(F.col("place") == number - above).first()["id"]
    until = F.lit(True) if last is None else F.coalesce(F.col(id_col) <= F.lit(last), F.lit(False))
    return able.where((F.col(score) > lowest) | ((F.col(score) == lowest) & until)).select(docs.columns)


def op12_resample(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = ranked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
), word AS (
  SELECT doc_id, row, is_target, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT doc_id, row_number() OVER () AS row, text, false AS is_target FROM documents
        UNION ALL SELECT NULL, NULL, text, true FROM benchmark)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM word)) CROSS JOIN crc_table
), tally AS (
  SELECT bucket, count(*) FILTER (WHERE NOT is_target) AS s, count(*) FILTER (WHERE is_target) AS t
  FROM word JOIN hashed USING (w) GROUP BY bucket
), total AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM tally
), gain AS (
  SELECT bucket, floor(1000 * ln(((tally.t + 1) * (total.s + 10000)) / ((tally.s + 1) * (total.t + 10000)))) AS gain FROM tally CROSS JOIN total
), weighed AS (
  SELECT row, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM word JOIN hashed USING (w) JOIN gain USING (bucket) WHERE NOT is_target GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN weighed USING (row)
), placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS number
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= number THEN place END AS rank FROM placed
"""
