"""Token counts by a compiled finite-state tokenizer.

Byte-level BPE first cuts a text into pieces.  That rule is compiled into a
deterministic transducer over character classes whose transitions say whether a piece
begins; the pieces are the words of a second automaton whose last transition carries the
number of tokens, compiled from the tokenizer as pieces turn up.  A text is cut into
chunks; each chunk gives a map from every state to the state after it, and a parallel
prefix scan of these maps gives the state in which each chunk really starts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 256  # characters whose state map is one step of the scan
PART = 1 << 20  # characters worked on at once
MOST_PIECES = 600_000  # compiled pieces that a worker keeps

# symbols: letter, number, other, apostrophe before a one or two letter ending, white
# space before white space or the end, blank before text, other space before text, end
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, BLANK, SPACE, STOP = range(9)
# states: between pieces, in letters, numbers, others, white space, after a blank that
# belongs to what follows, one and two letters before the end of a contraction
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
UNKNOWN = 255


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by state and symbol."""
    to, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), np.uint8)
    for state in range(8):
        for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            to[state, symbol], begins[state, symbol] = run, state not in (run, AFTER_BLANK)
        for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            joins = state in (IN_OTHERS, AFTER_BLANK)
            to[state, symbol], begins[state, symbol] = (IN_OTHERS, 0) if joins else (left, 1)
        to[state, INNER], begins[state, INNER] = IN_SPACE, state != IN_SPACE
        to[state, BLANK], to[state, SPACE], to[state, STOP] = AFTER_BLANK, FREE, FREE
    to[ONE_LEFT, LETTER], begins[ONE_LEFT, LETTER] = FREE, 0
    to[TWO_LEFT, LETTER], begins[TWO_LEFT, LETTER] = ONE_LEFT, 0
    return to, begins


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (n, states): doubling steps of a scan."""
    out, step = maps.copy(), 1
    while step < len(out):
        # first the chunks before, then the own ones
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


class Counter:
    """Counts the tokens of texts as the tokenizer file does, special strings included."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.to, self.begins = transducer()
        self.pieces: dict[str, int] = {}

    def _kind(self, c: str) -> int:
        """The class of a character, as the tokenizer's own splitting shows it."""
        cut = lambda s: len(self.whole.pre_tokenizer.pre_tokenize_str(s)) == 1
        return LETTER if cut(f"a{c}a") else NUMBER if cut(f"1{c}1") else OTHER if cut(f"!{c}!") else SPACE

    def symbols(self, points: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Symbols of the characters; ``stops`` are the places of marks between texts."""
        for p in np.unique(points[self.kinds[points] == UNKNOWN]):
            self.kinds[p] = self._kind(chr(p))
        out = self.kinds[points]
        out[stops] = STOP
        after, then = np.append(points[1:], 0), np.append(points[2:], [0, 0])
        quote = points == 39
        is_ = lambda x, s: np.isin(x, [ord(c) for c in s])
        pair = lambda a, b: (after == ord(a)) & (then == ord(b))
        if quote.any():
            # a text ends in a mark, which is no letter, so an ending is never looked for beyond it
            out[quote & is_(after, "stmd")] = SHORT
            out[quote & (pair("r", "e") | pair("v", "e") | pair("l", "l"))] = LONG
        space = out == SPACE
        inner = space & np.append(space[1:] | (out[1:] == STOP), True)
        out[inner] = INNER
        out[space & ~inner & (points == 32)] = BLANK
        return out

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where pieces and marks begin."""
        n = len(symbols)
        grid = np.full(-(-n // CHUNK) * CHUNK, STOP, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
        flat_to, flat_begins = self.to.ravel(), self.begins.ravel()
        maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (grid.shape[1], 8))
        for row in grid:
            maps = flat_to[maps * np.uint8(9) + row[:, None]]
        state = np.concatenate([np.zeros(1, np.uint8), composed(maps)[:-1, FREE]])
        begins = np.empty_like(grid)
        for k, row in enumerate(grid):
            at = state * np.uint8(9) + row
            begins[k] = flat_begins[at]
            state = flat_to[at]
        return np.flatnonzero(begins.T.ravel()[:n])

    def _tokens(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.pieces.get, pieces))
        if None in found:
            new = list({p for p, n in zip(pieces, found) if n is None})
            if len(self.pieces) + len(new) > MOST_PIECES:
                self.pieces.clear()
            known = dict(zip(new, (len(e.ids) for e in self.whole.encode_batch(new, add_special_tokens=False))))
            self.pieces.update(known)
            found = [known[p] if n is None else n for p, n in zip(pieces, found)]
        return np.array(found, np.int64)

    def _plain(self, texts: list[str]) -> np.ndarray:
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = self.starts(self.symbols(points, ends))
        pieces = list(map(joined.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(joined)])))
        stop = np.isin(starts, ends)
        counts = np.zeros(len(starts), np.int64)
        own = np.flatnonzero(~stop)
        counts[own] = self._tokens([pieces[i] for i in own.tolist()])
        total = np.concatenate([[0], np.cumsum(counts)])
        upto = total[np.searchsorted(starts, ends)]
        return np.diff(upto, prepend=0)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of every text; a text with a special string goes to the tokenizer itself."""
        out, some, size = [0] * len(texts), [], 0

        def flush():
            for i, n in zip(some, self._plain([texts[i] for i in some]) if some else ()):
                out[i] = int(n)

        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = len(self.whole.encode(t, add_special_tokens=False).ids)
                continue
            if some and size + len(t) > PART:
                flush()
                some, size = [], 0
            some.append(i)
            size += len(t)
        flush()
        return out


_COUNTERS: dict[str, Counter] = {}


def counted(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of every row with ``n_tokens`` (null and empty texts: none).

    ``tokenizer`` is the name of a file of the public tokenizers, which every worker has."""
    shape = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = Counter(str(public_tokenizers.path(tokenizer)))
        for batch in batches:
            n = _COUNTERS[tokenizer].count([t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, shape)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return counted(sized, ["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
