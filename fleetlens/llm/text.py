"""Helpers shared by the operators: checkpoints, Arrow columns, word counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import checkpoint_root

# fixed value: what separates words, as a character class for Java and Python patterns
SPACE = r"\x20\x09-\x0D"


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later steps start from those files."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def native_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes; ``bytes.lower`` and ``bytes.split`` then touch
    A-Z and ``[\\x20\\x09-\\x0D]`` only, as the contracts want."""
    return column.cast(pa.binary()).to_pylist()


def count_words(
    docs: DataFrame, text: str, keys: dict[str, Column], split: Callable[[bytes], Iterable[bytes]], most: int = 400_000
) -> DataFrame:
    """``keys``, ``word`` (binary), ``n``: occurrences over all rows of ``docs``.

    A task counts in a dictionary that is passed on whenever it holds ``most``
    words, so its memory is bounded; the sums are made by the shuffle.
    """
    names = list(keys)
    chosen = docs.select(*[c.cast("string").alias(k) for k, c in keys.items()], F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, Counter] = {}

        def out():
            for key, words in groups.items():
                cols = [pa.array([k] * len(words), pa.string()) for k in key]
                cols += [pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "word", "n"])
            groups.clear()

        for batch in batches:
            marks = zip(*[batch.column(i).to_pylist() for i in range(len(names))]) if names else iter(lambda: (), None)
            for key, value in zip(marks, raw(batch.column(len(names)))):
                if value:
                    groups.setdefault(key, Counter()).update(split(value))
                    if len(groups[key]) > most:
                        yield from out()
            if sum(map(len, groups.values())) > most:
                yield from out()
        yield from out()

    schema = ", ".join([*[f"{k} string" for k in names], "word binary", "n long"])
    return chosen.mapInArrow(count, schema).groupBy(*names, "word").agg(F.sum("n").alias("n"))


def above_count(counts: DataFrame, most: int, n: str = "n") -> float:
    """The least count for which at most ``most`` rows have it or more, found from a
    histogram of a few hundred logarithmic steps (the only thing that is collected)."""
    step = F.floor(F.log2(F.col(n)) * 8)
    hist = sorted(((r["step"], r["rows"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    total, least = 0, float("inf")
    for s, rows in hist:
        if total + rows > most:
            break
        total, least = total + rows, 2 ** (s / 8)
    return least


def text_key(text: str = "text") -> list[Column]:
    """Two hashes that name a text (null like empty); together 128 bits."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("_ka"), F.xxhash64(whole, F.lit(1)).alias("_kb")]


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``row``: whatever they are called, they cannot
    clash with what stands beside it, and ``row.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def small_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` (narrow rows, already fixed), marked for broadcast if it has at most ``most``
    rows; beyond that the join is left to shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def with_facts(rows: DataFrame, facts: DataFrame, key: list[str], spread: list[str], most: int = 200_000, parts: int = 16) -> DataFrame:
    """Left join of ``rows`` and ``facts`` (narrow, already fixed, one row a key).

    At most ``most`` facts are broadcast.  Beyond that every fact goes to ``parts`` places
    and a row to one of them by the hash of ``spread``, so the rows of a hot key are dealt
    over as many tasks."""
    if facts.count() <= most:
        return rows.join(F.broadcast(facts), key, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(parts)])))
    return salted.join(copies, [*key, "_salt"], "left").drop("_salt")


def spare(columns: Iterable[str], *names: str) -> list[str]:
    """Names for own columns beside ``columns``: the given ones, with as many underscores in
    front as it takes to differ from all of them (case does not matter to Spark)."""
    used, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
