"""Byte-level BPE by a lexicon of frequent words, and back.

Words are counted over the whole corpus.  The most frequent ones, as the pieces that
byte-level BPE encodes one by one, are compiled with their token ids as outputs into a minimal acyclic
transducer: words share prefixes and suffixes, and an output stands on the first arc on
which it is certain.  The transducer is one file of numbers, which every worker maps into
its memory.  All pieces of some texts are walked through it together, a byte a step;
pieces that it does not accept are merged exactly, by rank.  What the lexicon holds
decides about speed only, never about ids.

Decoding joins the bytes of the ids and reads them as UTF-8, with replacement characters
for what is none.

Defined cases: null and empty texts have no ids and decode to the empty string; long texts
are encoded in slices that end before a blank between two other characters, where a piece
always begins; special strings in a text become their ids, as the tokenizer does by default.
Other columns, whatever their names, are passed on if they are asked for.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import token_counts
from fleetlens.llm.text import above_count, count_words, fixed, spare
from fleetlens.session import scratch

TOKENIZER = "byte_bpe_50k.json"
WORDS = 262_144  # words of the lexicon at most
LONGEST = 32  # bytes of a word of the lexicon at most
PART = 1 << 18  # characters worked on at once
COUNTED = 400_000  # words counted before the counts are passed on
_NEVER = 1 << 62
# letters of ASCII and all other bytes beyond it make words
_RUNS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANK = re.compile(r"\S \S")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is
    printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = dict(zip(own, own)) | {b: 256 + i for i, b in enumerate(rest)}
    return [chr(letters[b]) for b in range(256)]


class Merges:
    """Vocabulary and exact merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        marks = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if model["type"] != "BPE" or not plain or odd or marks or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        spelled = lambda s: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: spelled(s) for s, i in [*vocab.items(), *self.special.items()]}
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # rank and merged id in one number: the least is the merge to make next
        self.pairs = {vocab[a] << 24 | vocab[b]: rank << 24 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.worth = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.spelling = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        if len(ids) and ids.max() >= len(self.spelling):
            ids = ids[ids < len(self.spelling)]
        return b"".join(map(self.spelling.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def _values(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What the merges of id pairs are worth; pairs that do not merge, or with a -1, never."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.worth[at], _NEVER)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids of all in a row.

        Again and again the pair of least rank is merged, the leftmost first, in all pieces of
        about the same size together; very long ones go one by one."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, parts = np.zeros(len(pieces), np.int64), []
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64)):
            places = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(places):
                continue
            ids = np.full((len(places), high + 1), -1, np.int64)
            letters = np.frombuffer(b"".join([pieces[i] for i in places.tolist()]), np.uint8)
            ids[np.arange(high + 1) < sizes[places, None]] = self.first[letters]
            ids = self._merge_rows(ids)
            counts[places] = (ids >= 0).sum(axis=1)
            parts.append((places, ids[ids >= 0]))
        for i in np.flatnonzero(sizes > 64).tolist():
            ids = self._merge_long(self.first[np.frombuffer(pieces[i], np.uint8)].tolist())
            counts[i] = len(ids)
            parts.append((np.array([i]), np.array(ids)))
        out, first = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for places, ids in parts:
            out[spans(first[places], counts[places])] = ids
        return counts, out

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids that end in at least one -1, merged."""
        done, rows = ids.copy(), np.arange(len(ids))
        values, columns = self._values(ids[:, :-1], ids[:, 1:]), np.arange(ids.shape[1])
        while True:
            at = values.argmin(axis=1)
            least = values[np.arange(len(at)), at]
            more = least < _NEVER
            if not more.all():
                done[rows[~more]] = ids[~more]
                rows, ids, values, at, least = rows[more], ids[more], values[more], at[more], least[more]
            if not len(rows):
                return done
            every = np.arange(len(rows))
            # what follows the pair moves to the left; the last column stays a -1
            pick = np.minimum(columns + (columns > at[:, None]), columns[-1])
            ids, values = np.take_along_axis(ids, pick, 1), np.take_along_axis(values, np.minimum(pick[:, :-1], columns[-2]), 1)
            ids[every, at] = least & 0xFFFFFF
            values[every, at] = self._values(ids[every, at], ids[every, at + 1])
            left = np.flatnonzero(at > 0)
            values[left, at[left] - 1] = self._values(ids[left, at[left] - 1], ids[left, at[left]])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(v, i) for i in range(n - 1) if (v := get(ids[i] << 24 | ids[i + 1], _NEVER)) < _NEVER]
        heapq.heapify(heap)
        while heap:
            value, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 24 | ids[j]) != value:
                continue
            ids[i], ids[j], after[i] = value & 0xFFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (v := get(ids[k] << 24 | ids[after[k]], _NEVER)) < _NEVER:
                    heapq.heappush(heap, (v, k))
        return [x for x in ids if x >= 0]


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first`` and have ``size`` places, in a row."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _State:
    """A state that words still pass through: arcs by byte with [target, output]."""

    __slots__ = ("arcs", "final", "last")

    def __init__(self):
        self.arcs: dict[int, list] = {}
        self.final = False
        self.last: tuple = ()  # output at the end of a word


def minimal_transducer(words: list[tuple[bytes, tuple[int, ...]]]) -> list[tuple]:
    """States of the minimal transducer of sorted distinct words; the last one is its root.

    A state is (whether a word ends, the output there, its arcs (byte, target, output)).  Only
    the states of the word before are open; what a new word leaves behind is closed, and
    equal closed states are one."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []

    def closed(s: _State) -> int:
        key = (s.final, s.last, tuple((b, t, o) for b, (t, o) in s.arcs.items()))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path, previous = [_State()], b""
    for word, ids in words:
        shared = 0
        while shared < len(previous) and previous[shared] == word[shared]:
            shared += 1
        for i in range(len(previous), shared, -1):
            path[i - 1].arcs[previous[i - 1]][0] = closed(path.pop())
        left = tuple(ids)
        for i in range(shared):
            arc, follower = path[i].arcs[word[i]], path[i + 1]
            have = arc[1]
            n = 0
            while n < len(have) and n < len(left) and have[n] == left[n]:
                n += 1
            if n < len(have):  # what is no longer certain moves one state on
                moved, arc[1] = have[n:], have[:n]
                for other in follower.arcs.values():
                    other[1] = moved + other[1]
                if follower.final:
                    follower.last = moved + follower.last
            left = left[n:]
        for i in range(shared, len(word)):
            path[i].arcs[word[i]] = [-1, left]
            left = ()
            path.append(_State())
        path[-1].final, path[-1].last = True, left
        previous = word
    for i in range(len(previous), 0, -1):
        path[i - 1].arcs[previous[i - 1]][0] = closed(path.pop())
    closed(path[0])
    return states


def packed(states: list[tuple]) -> bytes:
    """The file of a transducer: a head, then arrays of 32-bit numbers.

    Arcs lie in one table: that of byte b of state s at ``base[s] + b``, where ``owner`` says s.
    States with many arcs are placed first; single arcs fill the gaps."""
    pool: dict[tuple, int] = {(): 0}
    numbers: list[int] = []

    def output(ids: tuple) -> int:
        if ids not in pool:
            pool[ids] = len(numbers)
            numbers.extend(ids)
        return pool[ids]

    base, size = [0] * len(states), 512 + 2 * sum(len(s[2]) for s in states)
    free = bytearray(b"\1") * (size + 256)
    low = top = 256
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][2])):
        letters = [a[0] for a in states[s][2]]
        if not letters:
            continue
        low = free.index(1, low)
        at, tries = low, 0
        while not all(free[at - letters[0] + b] for b in letters):
            at, tries = free.index(1, at + 1), tries + 1
            if tries > 48 and at < top:  # dense region: go on behind all arcs
                at = top
                if at - letters[0] < 0:
                    at = letters[0]
        if tries > 48:
            low = max(low, at - 4096)
        base[s] = at - letters[0]
        for b in letters:
            free[base[s] + b] = 0
        top = max(top, base[s] + letters[-1] + 1)
        if top + 512 > len(free):
            free += bytearray(b"\1") * len(free)
    slots = top + 256
    arcs = np.zeros((4, slots), np.int32)
    arcs[0] = -1
    for s, (_, _, own) in enumerate(states):
        for b, target, ids in own:
            arcs[:, base[s] + b] = (s, target, output(ids), len(ids))
    ends = np.array([[output(last) if final else -1, len(last)] for final, last, _ in states], np.int32).T
    head = np.array([slots, len(states), len(numbers), 0], np.int32)
    parts = [head, np.array(base, np.int32), ends, arcs, np.array(numbers, np.int32)]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class Lexicon:
    """A transducer file, mapped into memory."""

    def __init__(self, path: str):
        whole = np.asarray(np.memmap(path, np.int32, "r"))  # still the mapped file
        slots, states, _, _ = whole[:4].tolist()
        cuts = np.cumsum([4, states, states, states, slots, slots, slots, slots])
        _, self.base, self.end_at, self.end_size, self.owner, self.target, self.out_at, self.out_size, self.pool = np.split(whole, cuts)
        self.root = states - 1

    def encode(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pieces of a byte array: whether each is a word, how many ids it has, and the ids
        of all words in a row.  All pieces take a step together."""
        n = len(starts)
        state, known = np.full(n, self.root, np.int32), sizes <= LONGEST
        on, found = np.flatnonzero(known), []
        for k in range(LONGEST):
            on = on[sizes[on] > k]
            if not len(on):
                break
            now = state[on]
            slot = self.base[now] + text[starts[on] + k]
            ok = self.owner[slot] == now
            known[on[~ok]] = False
            on, slot = on[ok], slot[ok]
            state[on] = self.target[slot]
            says = np.flatnonzero(self.out_size[slot])
            found.append((on[says], self.out_at[slot[says]], self.out_size[slot[says]]))
        known &= self.end_at[state] >= 0
        last = np.flatnonzero(known & (self.end_size[state] > 0))
        found.append((last, self.end_at[state[last]], self.end_size[state[last]]))
        piece, at, size = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(piece, kind="stable")
        order = order[known[piece[order]]]
        piece, at, size = piece[order], at[order], size[order].astype(np.int64)
        return known, np.bincount(piece, weights=size, minlength=n).astype(np.int64), self.pool[spans(at, size)]


def slices(text: str) -> Iterator[str]:
    """A text in slices of about ``PART`` characters that end where a piece ends."""
    at = 0
    while len(text) - at > PART and (found := _BLANK.search(text, at + PART)):
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def pieces(splitter: token_counts.Counter, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts with a mark after each; where pieces start and end in it; the same marks'
    places; all characters' code points."""
    joined = "\0".join(texts) + "\0"
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = splitter.starts(splitter.symbols(points, stops))
    ends = np.append(starts[1:], len(joined))
    own = ~np.isin(starts, stops)
    return joined, starts[own], ends[own], stops, points


class Encoder:
    """Ids of texts by a lexicon, by exact merges beyond it."""

    def __init__(self, tokenizer: str, lexicon: str):
        self.merges, self.lexicon = Merges(tokenizer), Lexicon(lexicon)
        self.splitter = token_counts.Counter(tokenizer)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts in which no special string counts."""
        joined, starts, ends, stops, points = pieces(self.splitter, texts)
        wide = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
        whole = joined.encode()
        first, size = byte_at[starts], byte_at[ends] - byte_at[starts]
        known, counts, ids = self.lexicon.encode(np.frombuffer(whole, np.uint8), first, size)
        rest = np.flatnonzero(~known)
        unseen = [whole[a : a + n] for a, n in zip(first[rest].tolist(), size[rest].tolist())]
        place = {piece: i for i, piece in enumerate(dict.fromkeys(unseen))}
        own, merged = self.merges.merge(list(place))
        which = np.fromiter(map(place.__getitem__, unseen), np.int64, len(unseen))
        counts[rest] = own[which]
        upto = np.cumsum(counts)
        out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint32)
        out[np.repeat(known, counts)] = ids
        out[spans(upto[rest] - counts[rest], counts[rest])] = merged[spans((np.cumsum(own) - own)[which], own[which])]
        cuts = np.concatenate([[0], upto])[np.searchsorted(starts, stops)]
        return np.split(out, cuts[:-1])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text, in order; works on about ``PART`` characters at once."""
        held: list[tuple[str, int]] = []  # slices and the special id after them
        counts: list[int] = []
        size = 0

        def flush():
            plain = iter(self._plain([s for s, _ in held]))
            after = iter([i for _, i in held])
            for n in counts:
                got = []
                for _ in range(n):
                    got.append(next(plain))
                    if (i := next(after)) >= 0:
                        got.append(np.array([i], np.uint32))
                yield got[0] if len(got) == 1 else np.concatenate(got)

        for text in texts:
            parts, at = [], 0
            for m in self.merges.specials.finditer(text) if self.merges.specials else ():
                parts += [(s, -1) for s in slices(text[at : m.start()])]
                parts[-1] = (parts[-1][0], self.merges.special[m[0]])
                at = m.end()
            parts += [(s, -1) for s in slices(text[at:])]
            if held and size + len(text) > PART:
                yield from flush()
                held, counts, size = [], [], 0
            if len(text) > 4 * PART:  # a slice at a time
                yield np.concatenate([x for s, i in parts for x in (self._plain([s])[0], np.array([i] if i >= 0 else [], np.uint32))])
                continue
            held += parts
            counts.append(len(parts))
            size += len(text)
        if held:
            yield from flush()


def _path(tokenizer: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(tokenizer))


def letter_runs(text: bytes) -> list[bytes]:
    """Runs of letters, as far as single bytes tell: most pieces are such a run after a blank."""
    return text.translate(_RUNS).split()


def lexicon(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, words: int = WORDS) -> str:
    """Name of the transducer file of the most frequent words of ``docs``, at most ``words`` of them, and of
    single bytes.

    Words are counted over all texts, and stand in the lexicon with a blank in front; the most frequent
    eighth also without.  They are merged in tasks; only they reach the driver, which compiles them.  The
    file lies in the shared folder and Spark hands it to every executor, late ones too."""
    counts = count_words(docs, text, {}, letter_runs, COUNTED).where(F.octet_length("word") < LONGEST)
    counts = fixed(counts.where("n > 1"))
    often, bare = above_count(counts, words - words // 8), above_count(counts, words // 8)
    chosen = counts.where(F.col("n") >= often).select("word", (F.col("n") >= bare).alias("bare"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(tokenizer)
        for batch in batches:
            found = batch.column(0).to_pylist()
            plain = [w for w, b in zip(found, batch.column(1).to_pylist()) if b]
            own = [*[b" " + w for w in found], *plain]
            sizes, ids = merges.merge(own)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), lists], names=["word", "ids"])

    table = chosen.mapInArrow(run, "word binary, ids array<int>").toArrow()
    merges = _merges(tokenizer)
    known = {bytes([b]): (int(i),) for b, i in enumerate(merges.first)}
    known.update(zip(table.column("word").to_pylist(), map(tuple, table.column("ids").to_pylist())))
    return publish(docs.sparkSession, packed(minimal_transducer(sorted(known.items()))))


def publish(spark: SparkSession, data: bytes) -> str:
    """Write a file to the shared folder and have Spark bring it to every executor; its name there."""
    where = scratch(spark, "lexicon") + ".fst"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(where)
    return where.rsplit("/", 1)[-1]


@functools.cache
def _merges(tokenizer: str) -> Merges:
    return Merges(_path(tokenizer))


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer: str, name: str) -> Encoder:
    return Encoder(_path(tokenizer), SparkFiles.get(name))


def _served(batches: Iterator[pa.RecordBatch], values: Callable[[list[bytes]], list], field: pa.Field) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is replaced by ``values`` of it (null: empty), some 4 MB at a time."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        schema = pa.schema([*[batch.schema.field(i) for i in range(batch.num_columns - 1)], field])
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 22))) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            out = pa.array(values([v or b"" for v in column.slice(a, b - a).to_pylist()]), field.type)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)], out], schema=schema)


def encoded(docs: DataFrame, name: str, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of every row and ``ids`` as training files hold them: little-endian unsigned
    32-bit numbers in a row (binary); ``name`` is that of a :func:`lexicon`."""
    source = spare(keep, "text")[0]
    shape = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, name)
        return _served(batches, lambda own: [ids.astype("<u4").tobytes() for ids in encoder.encode([t.decode() for t in own])], pa.field("ids", pa.binary()))

    return docs.select(*keep, F.col(text).cast("string").alias(source)).mapInArrow(run, shape)


def decoded(rows: DataFrame, keep: list[str], ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of every row and ``decoded``: the text of its ``ids`` (null: empty).  Ids that
    the tokenizer does not have are left out, as it does."""
    source = spare(keep, "ids")[0]
    shape = T.StructType([*[rows.schema[c] for c in keep], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(tokenizer)
        return _served(batches, lambda own: [merges.decode(np.frombuffer(x, "<u4")) for x in own], pa.field("decoded", pa.string()))

    return rows.select(*keep, F.col(ids).alias(source)).mapInArrow(run, shape)


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = encoded(docs, lexicon(docs), ["doc_id"])
    numbers = own.select("doc_id", "ids", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    read = decoded(numbers, ["doc_id", "n_tokens", "ids_sha256"])
    return read.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
