"""Hard negatives by shared candidate lists: anchors are clustered, and for each cluster
the candidates are sorted once by an upper bound of their inner products.

For a cluster with axis c and radius r (the largest angle between a member and c), a
candidate v at angle t from c has at most ``|a| |v| cos(max(0, t - r))`` with any member
a.  A member walks the list of its cluster from the largest bound on and stops as soon as
the next bound is below what it still needs: every later candidate is certified to be
worse.  Equal scores go to the smaller id, so it walks on while the bound is equal.

Candidates are read in blocks inside tasks and never shuffled; the list of a cluster is
that of a block, and a member carries what it has found from block to block.  Anchors
are sent to the tasks in groups of at most ``most`` (a parameter), a group after the
other.  Of equal vectors with equal labels in a block only the smallest ids can be among
the first k of anybody; the others are left out before the walk.

Defined cases: rows with a null id, label or vector, or a vector with a null or
non-finite component take no part.  Of rows with the same id the one with the least label,
then the least vector takes part.  Vectors of different lengths: what one of them lacks
counts as zero.  Scores are exact while sums of products stay below 2^53.  Empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.text import fixed

BLOCK = 8192  # candidates whose list is sorted at once
STEP = 256  # candidates of a list between two tests for the end
MOST = 65_536  # anchors that are sent to the tasks at once
SAMPLE = 4_096  # anchors that the axes are fitted on
SLACK = 1e-9  # of angles and bounds, for rounding


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x); null unless all are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def one_each(rows: DataFrame) -> DataFrame:
    """Rows ``id``, ``label``, ``vector`` that take part, one of each id.

    Only ids are counted by a shuffle; the rows of ids that repeat are the only ones that move."""
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    repeated = fixed(rows.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        return rows
    least = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return rows.join(repeated, "id", "left_anti").unionByName(least.select("id", "r.label", "r.vector"))


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, longer ones are cut at ``width``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == sizes[0]).all():
        out = values.reshape(len(sizes), -1)[:, :width]
        return np.pad(out, ((0, 0), (0, width - out.shape[1]))) if out.shape[1] < width else out
    out, ends = np.zeros((len(sizes), width)), np.cumsum(sizes)
    for row, end, size in zip(out, ends.tolist(), sizes.tolist()):
        row[: min(size, width)] = values[end - size : end][:width]
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def fit_axes(rows: np.ndarray, clusters: int, rounds: int = 6) -> np.ndarray:
    """Unit axes by spherical k-means over at most ``SAMPLE`` of the rows."""
    rng = np.random.default_rng(7)
    some = _unit(rows if len(rows) <= SAMPLE else rows[np.sort(rng.choice(len(rows), SAMPLE, replace=False))])
    axes = some[rng.choice(len(some), min(clusters, len(some)), replace=False)]
    for _ in range(rounds):
        own = (some @ axes.T).argmax(axis=1)
        sums = np.zeros_like(axes)
        np.add.at(sums, own, some)
        axes = np.where(np.bincount(own, minlength=len(axes))[:, None] > 0, _unit(sums), axes)
    return axes


class Anchors:
    """Anchors of one group in clusters; rows are ordered by cluster."""

    def __init__(self, ids: np.ndarray, labels: list, vectors: np.ndarray, members: int = 64, clusters: int = 64):
        axes = fit_axes(vectors, max(1, min(clusters, len(ids) // members)))
        own = (_unit(vectors) @ axes.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        self.ids, self.vectors, own = ids[order], vectors[order], own[order]
        self.codes = {label: i for i, label in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.codes[labels[i]] for i in order.tolist()], np.int64)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.clusters = []
        for k in range(len(axes)):
            a, b = np.searchsorted(own, [k, k + 1])
            if a < b:
                # a zero vector has the score zero with everything: any angle will do
                angles = np.arccos(np.clip(_unit(self.vectors[a:b]) @ axes[k], -1, 1))[self.norms[a:b] > 0]
                self.clusters.append((int(a), int(b), axes[k], float(angles.max(initial=0.0))))

    def lists(self, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each cluster: its range of members, the candidates by falling bound, and the bounds."""
        norms, units = np.linalg.norm(vectors, axis=1), _unit(vectors)
        for a, b, axis, radius in self.clusters:
            apart = np.arccos(np.clip(units @ axis, -1, 1)) - radius - SLACK
            bounds = norms * (np.cos(np.maximum(apart, 0)) + SLACK)
            order = np.argsort(-bounds, kind="stable")
            yield a, b, order, bounds[order]


class Best:
    """The first ``k`` candidates of each row, by falling score and rising id."""

    def __init__(self, rows: int, k: int):
        self.k, self.scores, self.ids = k, np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (rows, candidates): -inf does not count; ``ids`` are sorted and new."""
        better = scores.max(axis=1, initial=-np.inf) >= np.maximum(self.scores[rows, -1], -1e300)
        if not better.any():
            return
        rows, scores = rows[better], scores[better]
        first = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        all_scores = np.concatenate([self.scores[rows], np.take_along_axis(scores, first, 1)], axis=1)
        all_ids = np.concatenate([self.ids[rows], ids[first]], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


def distinct_first(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest ids of each (label, vector)."""
    named = np.ascontiguousarray(np.column_stack([labels.astype(np.float64), vectors]))
    _, group = np.unique(named.view(np.dtype((np.void, named.itemsize * named.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    sorted_group = group[order]
    begins = np.searchsorted(sorted_group, sorted_group)
    return np.sort(order[np.arange(len(order)) - begins < k])


def walk(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, needs: Callable, take: Callable) -> int:
    """Let every member walk the list of its cluster in one block; the number of scores computed.

    ``needs(rows)`` is what a candidate must reach for each row at least, ``take(rows, scores,
    places)`` adds candidates (places in ids order)."""
    computed = 0
    for a, b, order, bounds in anchors.lists(vectors):
        rows = np.arange(a, b)
        for at in range(0, len(order), STEP):
            rows = rows[anchors.norms[rows] * bounds[at] + SLACK >= needs(rows)]
            if not len(rows):
                break
            part = np.sort(order[at : at + STEP])  # the block is in order of ids
            take(rows, anchors.vectors[rows] @ vectors[part].T, part)
            computed += len(rows) * len(part)
    return computed


def _blocks(batches: Iterator[pa.RecordBatch], anchors: Anchors, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, label codes (-1: no anchor has it) and vectors of blocks of candidates, in order of ids."""
    held, rows = [], 0

    def block():
        table = pa.Table.from_batches(held)
        ids = table.column("id").to_numpy()
        codes = [anchors.codes.get(x, -1) for x in table.column("label").to_pylist()]
        # labels that no anchor has need not be told apart
        labels, vectors = np.array(codes, np.int64), _matrix(table.column("vector"), anchors.vectors.shape[1])
        place = distinct_first(ids, labels, vectors, keep)
        place = place[np.argsort(ids[place], kind="stable")]
        return ids[place], labels[place], vectors[place]

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            rows += held[-1].num_rows
            if rows >= BLOCK:
                yield block()
                held, rows = [], 0
    if held:
        yield block()


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_same(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """``anchor``, ``rank``, ``id``, ``score``: the first ``k`` other rows with an anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.ids), k)
        for ids, labels, vectors in _blocks(batches, anchors, k + 1):

            def take(rows, scores, part):
                out = (labels[part][None] != anchors.labels[rows][:, None]) | (ids[part][None] == anchors.ids[rows][:, None])
                scores[out] = -np.inf
                best.add(rows, scores, ids[part])

            walk(anchors, ids, labels, vectors, lambda rows: best.scores[rows, -1], take)
        row, slot = np.nonzero(best.scores > -np.inf)
        cols = [pa.array(anchors.ids[row]), pa.array(best.ids[row, slot]), pa.array(best.scores[row, slot].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["anchor", "id", "score"])

    return _first(rows.mapInArrow(run, "anchor long, id long, score long"), ["anchor"], k)


def _between(rows: DataFrame, anchors: Anchors, positive: np.ndarray, k: int, low: int, high: int) -> DataFrame:
    """``anchor``, ``slot``, ``rank``, ``id``, ``score``: the first ``k`` rows of another label with low % to
    high % of a positive's score.  ``positive``: (anchors, slots) scores, NaN where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = positive.shape[1]
        best = [Best(len(anchors.ids), k) for _ in range(slots)]
        # NaN and empty ranges (a negative score) need more than any bound
        least = np.where(low * positive <= high * positive, low * positive / 100, np.inf)

        def needs(rows):
            return np.min([np.maximum(best[j].scores[rows, -1], least[rows, j]) for j in range(slots)], axis=0)

        for ids, labels, vectors in _blocks(batches, anchors, k):

            def take(rows, scores, part):
                scores[labels[part][None] == anchors.labels[rows][:, None]] = -np.inf
                for j in range(slots):
                    own = positive[rows, j][:, None]
                    inside = (low * own <= 100 * scores) & (100 * scores <= high * own)
                    if inside.any():
                        best[j].add(rows, np.where(inside, scores, -np.inf), ids[part])

            walk(anchors, ids, labels, vectors, needs, take)
        for j in range(slots):
            row, place = np.nonzero(best[j].scores > -np.inf)
            cols = [anchors.ids[row], np.full(len(row), j, np.int32), best[j].ids[row, place], best[j].scores[row, place].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "slot", "id", "score"])

    return _first(rows.mapInArrow(run, "anchor long, slot int, id long, score long"), ["anchor", "slot"], k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, most: int = MOST
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for the
    anchors among ``rows`` (``id`` long, ``label``, ``vector`` array<long>).

    An anchor's positives are its best other rows of the same label; to each belong the best rows of
    other labels whose score is ``low`` to ``high`` percent of the positive's."""
    rows = fixed(one_each(rows.select("id", F.col("label").cast("string").alias("label"), "vector")))
    chosen = fixed(rows.where(is_anchor))
    groups, out = max(1, -(-chosen.count() // most)), None
    for g in range(groups):
        table = chosen.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).orderBy("id").toArrow()
        if table.num_rows == 0:
            continue
        own = Anchors(table.column("id").to_numpy(), table.column("label").to_pylist(), _matrix(table.column("vector")))
        near = fixed(nearest_same(rows, own, positives))
        place = {a: i for i, a in enumerate(own.ids.tolist())}
        scores = np.full((len(own.ids), positives), np.nan)
        for r in near.select("anchor", "rank", "score").toLocalIterator():  # at most ``most`` * ``positives``
            scores[place[r["anchor"]], r["rank"] - 1] = r["score"]
        found = _between(rows, own, scores, negatives, low, high)
        pairs = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = found.join(pairs, ["anchor", "slot"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        part = fixed(part) if groups > 1 else part
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], kinds)
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    rows = table.select(
        F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        whole_numbers(F.col("embedding")).alias("vector"),
    )
    return hard_negatives(rows, F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), negative AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
  FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
"""
