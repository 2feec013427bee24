"""Language-model scores by a hierarchical Pitman-Yor model.

Every word of the training texts has a context restaurant for what follows it (the start of a text is
one too), and all context restaurants share one parent over all words and the end of a text, whose base is
uniform over them and one unknown word.  The model grows with the corpus: every pair of neighbouring words
is a dish, none is merged or left out.

Seatings are sampled by Gibbs sweeps.  In a sweep all customers of a dish get up and are seated again by the
Chinese restaurant process, given the tables of the other dishes and the parent's probability; a Metropolis
test makes up for the changing normaliser.  Dishes of a restaurant are seated side by side against the tables
before the sweep; after the 16th customer of a dish a sixteenth of those seated sit down in one binomial draw.
Tables of contexts are means over the sweeps after the first ones; predictive probabilities are linear in
them, so these are averaged probabilities.  Contexts are seated against word frequencies (rare words against their
mean); the parent then seats the tables that they sent, in 6 sweeps, averaged over dishes of equal customers.

Where it lives: a word is a small number if it is one of the ``known`` most frequent, else 63 bits of its hash.
Pairs are combined in the tasks, packed, and sent to buckets by context, whose number grows with the corpus;
contexts that would fill a good part of a bucket are split over all buckets by the next word.  Scoring sends the pairs
of the texts to the same buckets: the log probability of a pair is a part of the context, a part of the word,
and what a seen pair adds, so only the last needs the buckets, and the other two for words that are not known; those
are compared as a whole, not by hash.  A bucket answers with packed sums to ``HOMES`` places, so its rows
grow with the buckets only; sums travel as whole numbers of 2^-36 and do not depend on their order.  A lost
executor repeats with the same seeds, which belong to the buckets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.text import above_count, small_side
from fleetlens.session import scratch

KNOWN = 131_072  # words that every worker holds; the others are joined
BUCKET = 1_500_000  # training tokens a bucket
FLUSH = 2_000_000  # tokens that a task holds before it packs their pairs
SLICE = 2_000_000  # bytes of text that are cut into words at once
HELD = 400_000  # different words that a task holds before it passes them on
HOMES, BLOCK = 64, 4096  # places where sums of texts meet; texts that go there together
STRETCH = 1 << 16  # pairs that get their buckets at once
ONE = float(1 << 36)  # sums of logarithms travel as whole numbers of this part
SWEEPS, BURN_IN = 4, 2
DISCOUNT, STRENGTH = 0.75, 1.0  # of the context restaurants
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 1.0
END, HIGH = 0, 1 << 63
TABLE, OUTCOMES, CONTEXTS, REQUEST, CHANCE, WORDS = range(6)  # kinds of rows


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a compressed table to the shared folder."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _squeezed(data: bytes) -> tuple[int, bytes]:
    return len(data), pa.compress(data, codec="zstd", asbytes=True)


def _whole(squeezed: tuple[int, bytes]) -> bytes:
    return pa.decompress(squeezed[1], squeezed[0], codec="zstd", asbytes=True)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of equal length, compressed byte by byte place; places above the largest number are left out."""
    made = []
    for c in columns:
        c = c.astype(np.uint64)
        places = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        made.append([_squeezed(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :places].T).tobytes())])
    return pickle.dumps([len(columns[0]), *made])


def unpack(data: bytes) -> list[np.ndarray]:
    n, *columns = pickle.loads(data)
    out = []
    for (c,) in columns:
        whole = np.zeros((n, 8), np.uint8)
        if c[0]:
            whole[:, : c[0] // n] = np.frombuffer(_whole(c), np.uint8).reshape(-1, n).T
        out.append(whole.view(np.uint64).ravel())
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    """Whole numbers, small ones of both signs as small ones without; ``_unsigned`` undoes it."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def _slices(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """Stretches of texts of about ``size`` bytes."""
    at = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    start = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(column)]
    for a, b in zip(start, start[1:]):
        if b > a:
            yield column.slice(a, b - a)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words: the ASCII functions touch A-Z and ``[\\x20\\x09-\\x0D]`` only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)  # blanks at the ends of a text leave empty strings
    seen = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    end = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return np.diff(seen[np.r_[0, end]]), words.filter(real)


def count_words(train: DataFrame, text: str) -> DataFrame:
    """``word`` (binary) and ``n`` over all rows; a task passes its counts on whenever it holds many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for part in _slices(batch.column(0), 4 * SLICE):
                counted = pc.value_counts(_words(part)[1])
                for w, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield from out()
        yield from out()

    return train.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _spread(_spread(u) + w)


def seated(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes after their ``c`` customers sat down again, and the log of the product of the
    normalisers that they met.  ``a`` is strength plus discount times the tables of the other dishes,
    ``p`` the parent's probability of the dish: at t tables a new one has the weight (a + d t) p."""
    tables, sat, norm = np.ones(len(c)), np.ones(len(c)), np.zeros(len(c))
    live = np.flatnonzero(c > 1)
    while len(live):
        t, i = tables[live], sat[live]
        step = np.minimum(np.maximum(np.floor(i / 16), 1), c[live] - i)
        new, old = (a[live] + d * t) * p[live], i + (step - 1) / 2 - d * t
        tables[live] += rng.binomial(step.astype(np.int64), new / (new + old))
        norm[live] += step * np.log(new + old)
        sat[live] += step
        live = live[sat[live] < c[live]]
    return tables, norm


def sweep(c, tables, norm, totals, p, d: float, strength: float, rng: np.random.Generator):
    """One Gibbs sweep over dishes; ``totals`` are the tables of the restaurant of each dish."""
    new, new_norm = seated(c, strength + d * (totals - tables), p, d, rng)
    if norm is None:
        return new, new_norm
    keep = np.log(rng.random(len(c))) > new_norm - norm
    return np.where(keep, tables, new), np.where(keep, norm, new_norm)


def parent_tables(customers: np.ndarray, dishes: np.ndarray, base: float, seed: int, copies: int = 16) -> tuple[np.ndarray, float]:
    """Mean tables of a dish with each number of ``customers`` (``dishes`` of them have it), and all tables."""
    rng = np.random.default_rng(seed)
    c, weight = np.repeat(customers.astype(np.float64), copies), np.repeat(dishes / copies, copies)
    p, tables, norm, mean = np.full(len(c), base), np.ones(len(c)), None, np.zeros(len(c))
    for k in range(6):
        tables, norm = sweep(c, tables, norm, (weight * tables).sum(), p, PARENT_DISCOUNT, PARENT_STRENGTH, rng)
        mean += tables / 4 if k >= 2 else 0
    return mean.reshape(-1, copies).mean(axis=1), float((weight * mean).sum())


@dataclass
class Codes:
    """What every worker needs to number words and to find the bucket of a pair."""

    words: dict[bytes, int]  # known words, from 1
    split: np.ndarray  # by known code: is the context dealt over all buckets
    buckets: int

    def of(self, found: list[bytes]) -> np.ndarray:
        get, rest = self.words.get, xxhash.xxh64_intdigest
        return np.array([END, *[get(w) or rest(w, 42) | HIGH for w in found], END], np.uint64)

    def known(self, words: pa.Array) -> np.ndarray:
        """Numbers of known words, 0 for the others."""
        if not hasattr(self, "_names"):
            self._names = pa.array(list(self.words), pa.binary())
        return pc.index_in(words, value_set=self._names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def is_split(self, u: np.ndarray) -> np.ndarray:
        return self.split[np.minimum(u, np.uint64(len(self.split) - 1)).astype(np.int64)]

    def bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        x, split = _spread(u), self.is_split(u)
        x[split] = _spread(x[split] + w[split])  # as ``_pair``
        return ((x >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def home(self, u: np.ndarray) -> np.ndarray:
        """Buckets of contexts that are not split."""
        return ((_spread(u) >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def dealt(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets and the places of their items, in the order that these have."""
        whole = bucket.astype(np.uint64)
        whole <<= np.uint64(32)
        whole |= np.arange(len(whole), dtype=np.uint32)
        whole.sort()
        order = whole.astype(np.uint32)  # the lower half
        whole >>= np.uint64(32)
        start = np.flatnonzero(np.r_[len(whole) > 0, whole[1:] != whole[:-1]])
        names = whole[start].tolist()
        del whole
        yield from zip(names, np.split(order, start[1:]))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) | HIGH for w in words), np.uint64, len(words))


@dataclass
class Model:
    codes: Codes
    base_logs: np.ndarray  # by known code (0 is the end), then 0 for the others
    word_logs: np.ndarray  # parts of the word as context and as outcome together, likewise
    chance: np.ndarray  # the parent's probability by known code
    tables: np.ndarray  # mean tables of the context by known code
    end_known: int
    total: int
    nothing: float  # log10 of a word that training has not
    base_nothing: float


@dataclass
class Stored:
    """Tables that grow with the corpus."""

    words: DataFrame  # word, n: of words that the model does not hold
    pairs: DataFrame  # bucket, kind, data
    chances: DataFrame  # bucket, code, p: the parent's probability of words that the model does not hold, where they are outcomes or contexts


class Chunk(NamedTuple):
    """Neighbouring words of some texts: places in ``codes`` (ascending numbers), and the texts, counted from ``low``."""

    codes: np.ndarray
    low: int
    u: np.ndarray
    w: np.ndarray
    rows: np.ndarray
    names: list[bytes]  # words that are not known, the name of each such token, and its text
    named: np.ndarray
    named_rows: np.ndarray

    def order(self) -> np.ndarray:
        """Pairs in order, equal ones by text."""
        code, place = len(self.codes).bit_length(), len(self.u).bit_length()
        if 2 * code + place > 64:
            return np.argsort(self.pairs(32), kind="stable")
        whole = self.pairs(code)
        whole <<= np.uint64(place)
        whole |= np.arange(len(whole), dtype=np.uint64)
        whole.sort()
        whole &= np.uint64((1 << place) - 1)
        return whole.view(np.int64)

    def pairs(self, bits: int) -> np.ndarray:
        out = self.u.astype(np.uint64)
        out <<= np.uint64(bits)
        out |= self.w
        return out

    def dealt(self, codes: Codes) -> Iterator[tuple[int, Chunk]]:
        """Buckets and their pairs; only those of one bucket are held a second time."""
        bucket = np.empty(len(self.u), np.uint32)
        for at in range(0, len(bucket), STRETCH):
            part = slice(at, at + STRETCH)
            bucket[part] = codes.bucket(self.codes[self.u[part]], self.codes[self.w[part]])
        for name, part in codes.dealt(bucket):
            yield name, self._replace(u=self.u[part], w=self.w[part], rows=self.rows[part])


def _chunks(batches: Iterator[pa.RecordBatch], codes: Codes, packed) -> Iterator[pa.RecordBatch]:
    """Rows of ``packed``, which makes pairs of bucket and data from a chunk."""
    held, words, size, at = [], [], 0, TaskContext.get().partitionId() << 33

    def made():
        lengths, code = np.concatenate([n for n, _ in held]), np.concatenate([c for _, c in held])
        rest = pa.concat_arrays(words).dictionary_encode()
        held.clear()
        words.clear()
        names, named = rest.dictionary.to_pylist(), rest.indices.to_numpy(zero_copy_only=False)
        high, place = np.unique(hashes(names), return_inverse=True)
        known, row = len(codes.words) + 1, np.arange(len(lengths), dtype=np.uint32)
        unknown = code == 0
        named_rows = np.repeat(row, lengths)[unknown]
        code[unknown] = known + place[named]
        ends = np.cumsum(lengths + 1)
        u, w = np.zeros(ends[-1], np.uint32), np.zeros(ends[-1], np.uint32)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        w[inner] = code
        u[1:] = w[:-1]  # the end of a text is the start of the next
        all_codes = np.concatenate([np.arange(known, dtype=np.uint64), high])
        return Chunk(all_codes, at - len(lengths), u, w, np.repeat(row, lengths + 1), names, named, named_rows)

    def out():
        # held while it is packed: nothing but the chunk
        chunk = made()
        for bucket, data in packed(chunk):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])

    for batch in batches:
        for part in _slices(batch.column(0), SLICE):
            lengths, found = _words(part)
            code = codes.known(found).astype(np.uint32)
            held.append((lengths, code))
            words.append(found.filter(pa.array(code == 0)))
            at, size = at + len(part), size + len(code) + len(part)
            if size > FLUSH:
                yield from out()
                size = 0
    if held:
        yield from out()


def _pieces(data) -> list[np.ndarray]:
    """Columns of packed chunks, joined; contexts are no longer differences."""
    parts, out = [unpack(bytes(d)) for d in data], []
    for x in parts:
        np.cumsum(x[0], out=x[0])
    while parts[0]:
        out.append(np.concatenate([x.pop(0) for x in parts]))  # a column is not held twice for longer
    return out


def _seat(train: DataFrame, text: str, shared, first_chance: np.ndarray, rare_chance: float, seed: int) -> DataFrame:
    """``bucket``, ``kind``, ``data``: pairs with counts and tables, tables by word, tables by context."""

    def count(batches):
        def packed(k):
            for bucket, part in k.dealt(shared.value):
                pairs, n = np.unique(part.pairs(32), return_counts=True)
                yield bucket, pack(np.diff(k.codes[pairs >> np.uint64(32)], prepend=np.uint64(0)), k.codes[pairs.astype(np.uint32)], n)

        return _chunks(batches, shared.value, packed)

    chances = train.sparkSession.sparkContext.broadcast(first_chance)

    def seat(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        codes, rng = shared.value, np.random.default_rng([seed, int(key[0])])
        u, w, n = _pieces(group["data"])
        contexts, pairs = np.unique(u, return_inverse=True)
        del u  # columns go as soon as they are used: a bucket's are what a worker holds most of
        words, at = np.unique(w, return_inverse=True)
        del w
        pairs <<= 32
        pairs |= at
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        del at, order
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        n, pairs = np.add.reduceat(n, first), pairs[first]
        place, at = pairs >> 32, pairs & ((1 << 32) - 1)
        del first, pairs
        held = np.append(chances.value, rare_chance)
        held = held[np.minimum(words, np.uint64(len(held) - 1)).astype(np.int64)]
        # a split context has its other tables in the other buckets, as many in each
        times = np.where(codes.is_split(contexts), codes.buckets, 1)
        c, tables, norm, mean = n.astype(np.float64), np.ones(len(n)), None, np.zeros(len(n), np.int64)
        many = np.flatnonzero(c > 1)
        c, p = c[many], held[at[many]]
        for k in range(SWEEPS):
            totals = (np.bincount(place, tables, len(contexts)) * times)[place[many]]
            now, norm = sweep(c, tables[many], norm, totals, p, DISCOUNT, STRENGTH, rng)
            tables[many] = now
            if k >= BURN_IN:
                mean += tables.astype(np.int64)
        data = [
            pack(np.diff(contexts[place], prepend=np.uint64(0)), words[at], n, mean),
            pack(words, np.bincount(at, tables, len(words))),
            pack(contexts, np.bincount(place, mean, len(contexts))),
        ]
        return pd.DataFrame({"bucket": np.int32(key[0]), "kind": [TABLE, OUTCOMES, CONTEXTS], "data": data})

    packed = train.select(text).mapInArrow(count, "bucket int, data binary")
    return stored(packed.groupBy("bucket").applyInPandas(seat, "bucket int, kind int, data binary"), "pairs")


def _facts(pairs: DataFrame) -> DataFrame:
    """``code``, ``tw`` and ``tu`` (tables of the word as outcome, and of its context times the draws), ``buckets`` of a hash."""

    def rows(batches):
        for batch in batches:
            for bucket, kind, data in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                code, t = unpack(data)
                none = np.zeros(len(code), np.int64)
                tw, tu = (t.astype(np.int64), none) if kind == OUTCOMES else (none, t.astype(np.int64))
                for at in range(0, len(code), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    arrays = [pa.array(code[part].view(np.int64)), pa.array(tw[part]), pa.array(tu[part]), pa.array(np.full(len(code[part]), bucket, np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["code", "tw", "tu", "bucket"])

    loose = pairs.where(F.col("kind").isin(OUTCOMES, CONTEXTS)).mapInArrow(rows, "code long, tw long, tu long, bucket int")
    rare = F.col("code") < 0  # the high bit of a hash
    return stored(loose.groupBy("code").agg(F.sum("tw").alias("tw"), F.sum("tu").alias("tu"), F.collect_list(F.when(rare, F.col("bucket"))).alias("buckets")), "facts")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def fit(train: DataFrame, text: str = "text", known: int = KNOWN, seed: int = 3, bucket: int = BUCKET) -> tuple[Model, Stored]:
    """The model and the tables that grow with the corpus.

    Null and empty texts are only an end; without rows every word is unknown."""
    spark, draws = train.sparkSession, SWEEPS - BURN_IN
    counts = stored(count_words(train, text), "counts")
    ends = train.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = words + ends, kinds + (1 if ends else 0)
    least = above_count(counts, known)
    # at most ``known`` rows
    often = sorted(((r["n"], bytes(r["word"])) for r in counts.where(F.col("n") >= least).collect()), key=lambda x: (-x[0], x[1]))
    n = np.array([ends, *[c for c, _ in often]], np.float64)
    buckets = total // bucket + 1
    split = np.append(n * 4 > bucket, False)
    codes = Codes({w: i for i, (_, w) in enumerate(often, 1)}, split, buckets)
    shared = spark.sparkContext.broadcast(codes)
    rare_mass = (total - n.sum() + 1) / max(kinds - len(often), 1)  # training tokens of a rare word, in the mean
    pairs = _seat(train, text, shared, (n + 1) / (total + distinct + 1), rare_mass / (total + distinct + 1), seed)
    facts = _facts(pairs)
    # one row for each number of tables that a word has
    sizes = sorted((r["tw"], r["dishes"]) for r in facts.where("tw > 0").groupBy("tw").agg(F.count(F.lit(1)).alias("dishes")).collect())
    customers, dishes = np.array([t for t, _ in sizes], np.float64), np.array([d for _, d in sizes], np.float64)
    means, tables = parent_tables(customers, dishes, 1 / (distinct + 1), seed)
    full = PARENT_STRENGTH + (customers * dishes).sum()
    left = (PARENT_STRENGTH + PARENT_DISCOUNT * tables) / (distinct + 1)
    chance = {0.0: left / full} | dict(zip(customers.tolist(), ((customers - PARENT_DISCOUNT * means + left) / full).tolist()))
    tw, tu = np.zeros(len(n)), np.zeros(len(n))
    for r in facts.where((F.col("code") >= 0)).select("code", "tw", "tu").collect():  # known words and the end
        tw[r["code"]], tu[r["code"]] = r["tw"], r["tu"] / draws
    own = np.array([chance[t] for t in tw.tolist()])
    back = np.log10((STRENGTH + DISCOUNT * tu) / (STRENGTH + n))
    base = lambda c: np.log10((c + 1) / (total + distinct + 1))
    model = Model(
        codes, np.append(base(n), 0.0), np.append(back + np.log10(own), 0.0), own, tu,
        int(ends > 0), int(total), float(np.log10(left / full)), float(base(0)),
    )
    # from columns: rows would start Python workers of another kind, which stay beside those of the tasks
    by_size = small_side(spark.createDataFrame(pa.table({"tw": pa.array([int(t) for t in chance], pa.int64()), "p": pa.array([float(p) for p in chance.values()], pa.float64())})))
    rare = facts.where("code < 0").join(by_size, "tw").select(F.explode("buckets").alias("bucket"), "code", "p")
    return model, Stored(counts.where(F.col("n") < least).select("word", "n"), pairs.where(F.col("kind") == TABLE), rare)


def _by_bucket(rows: DataFrame, codes, kind: int, size: int, packed) -> DataFrame:
    """``bucket``, ``kind``, ``data``: ``packed`` gives pairs of bucket and data for some of the rows."""

    def run(batches):
        held = []

        def out():
            for bucket, data in packed(codes.value.codes, pa.Table.from_batches(held).combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "kind", "data"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > size:
                yield from out()
        if held:
            yield from out()

    return rows.mapInArrow(run, "bucket int, kind int, data binary")


def _packed_chances(codes: Codes, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
    bucket, code, p = (rows.column(c).to_numpy() for c in ("bucket", "code", "p"))
    code = code.view(np.uint64)
    order = np.argsort(code)
    for b, part in codes.dealt(bucket[order]):
        yield b, pack(np.diff(code[order[part]], prepend=np.uint64(0)), p[order[part]].view(np.uint64))


def _packed_words(codes: Codes, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    for b, part in codes.dealt(codes.home(hashes(words))):
        yield b, pickle.dumps([_squeezed(b" ".join([words[i] for i in part])), pack(n[part])])


def _added(docs: DataFrame, shared, found: Stored, text: str) -> DataFrame:
    """``_row``, ``n_known``, ``base_score``, ``score``: what the words that the model does not hold and
    the seen pairs add to a text; buckets answer to the places where the sums of some blocks of texts meet."""

    def ask(batches):
        codes = shared.value.codes

        def packed(k):
            home = codes.home(hashes(k.names))
            by_name = np.argsort(k.named, kind="stable")
            times = np.bincount(k.named, minlength=len(k.names))
            start = np.r_[0, np.cumsum(times)]
            words = dict(codes.dealt(home)) if len(home) else {}
            none = np.zeros(0, np.int64)
            # a word that is not known is a context in its bucket, so every bucket with words has pairs
            for bucket, part in k.dealt(codes):
                order, own = part.order(), words.get(bucket, none)
                ends = np.cumsum(times[own])
                tokens = by_name[np.repeat(start[own] + times[own] - ends, times[own]) + np.arange(ends[-1] if len(own) else 0)]
                yield bucket, pickle.dumps([
                    pack(np.diff(k.codes[part.u[order]], prepend=np.uint64(0)), k.codes[part.w[order]], part.rows[order]), k.low,
                    _squeezed(b" ".join([k.names[i] for i in own])), pack(times[own]), pack(k.named_rows[tokens]),
                ])

        return _chunks(batches, codes, packed)

    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        kind, data = group["kind"].to_numpy(), group["data"]
        requests = [pickle.loads(d) for d in data[kind == REQUEST]]
        if not requests:
            return pd.DataFrame({"home": np.zeros(0, np.int32), "data": []})
        empty = np.zeros(0, np.uint64)
        u, w, n, mean = _pieces(data[kind == TABLE]) if (kind == TABLE).any() else [empty] * 4
        code, p = _pieces(data[kind == CHANCE]) if (kind == CHANCE).any() else [empty] * 2
        order = np.argsort(code)
        code, p = code[order], np.append(p.view(np.float64)[order], 1.0)
        tables = mean / (SWEEPS - BURN_IN)
        contexts, place = np.unique(u, return_inverse=True)
        pairs = _pair(u, w)
        del u, mean
        all_tables = np.bincount(place, tables, len(contexts))
        split = m.codes.is_split(contexts)
        all_tables[split] = m.tables[contexts[split].astype(np.int64)]
        held = w < np.uint64(HIGH)
        chance = np.where(held, m.chance[np.where(held, w, 0).astype(np.int64)], p[np.searchsorted(code, w)])
        gain = np.log10(1 + (n - DISCOUNT * tables) / ((STRENGTH + DISCOUNT * all_tables[place]) * chance))
        del w, n, tables, place, held, chance
        order = np.argsort(pairs)
        pairs, gain = np.append(pairs[order], np.uint64(0)), np.append(gain[order], 0.0)
        del order

        words, times = [], [empty]
        for d in data[kind == WORDS]:
            names, packed = pickle.loads(d)
            words += _whole(names).split()
            times += unpack(packed)
        times = np.concatenate(times).astype(np.int64)
        of_words = hashes(words)
        tables = np.append(all_tables, 0.0)[np.searchsorted(contexts, of_words)]
        logs = np.log10((STRENGTH + DISCOUNT * tables) / (STRENGTH + times)) + np.log10(p[np.searchsorted(code, of_words)])
        base = np.append(np.log10(times + 1.0) + m.base_nothing, m.base_nothing)
        logs = np.append(logs, m.nothing)
        names = [pa.array(_whole(r[2]).split(), pa.binary()) for r in requests]
        met = pc.index_in(pa.concat_arrays(names), value_set=pa.array(words, pa.binary())).fill_null(len(words)).to_numpy(zero_copy_only=False)

        out, at = [], 0
        for (packed, low, _, repeats, named_rows), part in zip(requests, names):
            ru, rw, rows = _pieces([packed])
            new = np.flatnonzero(np.r_[True, (ru[1:] != ru[:-1]) | (rw[1:] != rw[:-1])])
            asked = _pair(ru[new], rw[new])
            there = np.searchsorted(pairs[:-1], asked)
            gains = np.where(pairs[there] == asked, gain[there], 0.0)
            rows, own = rows.astype(np.int64), unpack(named_rows)[0].astype(np.int64)
            word = np.repeat(met[at : at + len(part)], unpack(repeats)[0].astype(np.int64))
            at += len(part)
            size = int(rows.max()) + 1
            sums = [
                np.bincount(own, word < len(words), size),
                np.bincount(own, base[word], size) * ONE,
                (np.bincount(rows, np.repeat(gains, np.diff(np.r_[new, len(ru)])), size) + np.bincount(own, logs[word], size)) * ONE,
            ]
            sums = np.rint(np.stack(sums)).astype(np.int64)
            some = np.flatnonzero(sums.any(axis=0))
            out.append(np.vstack([some + low, sums[:, some]]))
        rows, *sums = np.concatenate(out, axis=1)
        home = (_spread((rows // BLOCK).view(np.uint64)) >> np.uint64(33)) % np.uint64(HOMES)
        order = np.lexsort((rows, home))
        names, start = np.unique(home[order], return_index=True)
        parts = [o for o in np.split(order, start[1:]) if len(o)]
        made = [pack(np.diff(rows[o], prepend=0), sums[0][o], _signed(sums[1][o]), _signed(sums[2][o])) for o in parts]
        return pd.DataFrame({"home": names.astype(np.int32), "data": made})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, known, base, score = unpack(data)
                rows = np.cumsum(rows).astype(np.int64)
                sums = np.stack([known.view(np.int64), _unsigned(base), _unsigned(score)], axis=1)
                names, start = np.unique(rows // BLOCK, return_index=True)
                for name, r, x in zip(names.tolist(), np.split(rows, start[1:]), np.split(sums, start[1:])):
                    if name not in blocks:
                        blocks[name] = np.zeros((BLOCK, 3), np.int64)
                    blocks[name][r - name * BLOCK] += x
        for name, sums in blocks.items():
            some = np.flatnonzero(sums.any(axis=1))
            columns = [some + name * BLOCK, sums[some, 0], sums[some, 1] / ONE, sums[some, 2] / ONE]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_row", "n_known", "base_score", "score"])

    asked = docs.select(text).mapInArrow(ask, "bucket int, data binary")
    whole = (
        asked.select("bucket", F.lit(REQUEST).alias("kind"), "data")
        .unionByName(found.pairs.select("bucket", "kind", "data"))
        .unionByName(_by_bucket(found.chances, shared, CHANCE, FLUSH, _packed_chances))
        .unionByName(_by_bucket(found.words, shared, WORDS, HELD, _packed_words))
    )
    answers = whole.groupBy("bucket").applyInPandas(answer, "home int, data binary")
    return answers.repartition("home").select("data").mapInArrow(met, "_row long, n_known long, base_score double, score double")


def scored(docs: DataFrame, model: Model, found: Stored, keep: list[str], text: str = "text", repeatable: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with ``n_tokens``, ``n_known``, ``base_score``, ``score``.

    One pass gives a row for each text, with the sums over the words that the model holds; another sends the other
    words and the pairs to the buckets.  Both are summed by
    the place of the text in its task's input.  Both passes must number the texts alike: ``repeatable`` says that
    ``docs`` come in the same order whenever they are read, as a scan of files does; else they are written first.
    """
    if not repeatable:
        docs, text = stored(docs.select(*keep, F.col(text).alias("_text")), "texts"), "_text"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["_row", *keep, "n_tokens", "n_known", "base_score", "score"]
    more = "n_tokens long, n_known long, base_score double, score double"
    shape = T.StructType([T.StructField("_row", T.LongType()), *[T.StructField(c, docs.schema[c].dataType) for c in keep], *T.StructType.fromDDL(more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = shared.value, TaskContext.get().partitionId() << 33
        none = len(m.base_logs) - 1
        for batch in batches:
            done = 0
            for part in _slices(batch.column("_text"), SLICE):
                lengths, words = _words(part)
                own, row = m.codes.known(words), np.repeat(np.arange(len(part)), lengths)
                own[own == 0] = none
                columns = [pa.array(np.arange(at, at + len(part))), *[batch.column(c).slice(done, len(part)) for c in keep]]
                columns += [pa.array(lengths + 1), pa.array(np.bincount(row, own < none, len(part)).astype(np.int64) + m.end_known)]
                columns += [pa.array(np.bincount(row, logs[own], len(part)) + logs[END]) for logs in (m.base_logs, m.word_logs)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at, done = at + len(part), done + len(part)

    parts = docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, shape)
    return (
        parts.unionByName(_added(docs, shared, found, text), allowMissingColumns=True)
        .groupBy("_row")
        .agg(*[F.max(c).alias(c) for c in keep], *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        .drop("_row")
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    model, found = fit(marked.where(~F.col("held_out")))
    out = scored(marked, model, found, ["doc_id", "held_out"], repeatable=True)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
