"""Language identification, words first: a known word counts with its log frequency in
each language, an unseen one with those of its longest known character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.text import count_words

SAMPLE_DOCS = 4000  # labelled documents that the tables are fitted on, at most (about)
MIN_COUNT = 2  # a word seen less often is left to its n-grams
LONGEST = 4  # characters of the longest n-gram
MOST_UNSEEN = 200_000  # unseen words whose scores a worker keeps
FLOOR = 0.5  # added to every count
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language: of words, and of n-grams of each length."""

    def __init__(self, langs: list[str], counts: dict[str, Counter]):
        self.langs = langs
        seen: Counter = Counter()
        for c in counts.values():
            seen.update(c)
        self.words = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= MIN_COUNT))}
        self.word_logs = self._logs(self.words, counts)
        self.grams, self.gram_logs = {}, {}
        for n in range(1, LONGEST + 1):
            by = {k: Counter() for k in langs}
            for k in langs:
                for w, c in counts[k].items():
                    for g in grams(w, n):
                        by[k][g] += c
            self.grams[n] = {g: i for i, g in enumerate(sorted(set().union(*by.values())))}
            self.gram_logs[n] = self._logs(self.grams[n], by)

    def _logs(self, index: dict[str, int], counts: dict[str, Counter]) -> np.ndarray:
        out = np.full((len(index), len(self.langs)), FLOOR)
        for j, k in enumerate(self.langs):
            for w, n in counts[k].items():
                if w in index:
                    out[index[w], j] += n
        total = [sum(counts[k].values()) + FLOOR * (len(index) + 1) for k in self.langs]
        return np.log(out / np.array(total)).astype(np.float32)

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest n-grams of which any is known."""
        for n in range(LONGEST, 0, -1):
            own = [i for i in map(self.grams[n].get, grams(word, n)) if i is not None]
            if own:
                return self.gram_logs[n][own].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """A model with a bounded store of the scores of unseen words."""

    def __init__(self, model: Model):
        self.model, self.base = model, len(model.words)
        self.logs = np.vstack([model.word_logs, np.zeros((MOST_UNSEEN, len(model.langs)), np.float32)])
        self.more: dict[str, int] = {}

    def _place(self, word: str) -> int:
        if word not in self.more:
            self.more[word] = self.base + len(self.more)
            self.logs[self.more[word]] = self.model.unseen(word)
        return self.more[word]

    def total(self, words: list[str]) -> np.ndarray:
        """Sum of the log scores of a text's words, by language."""
        out = np.zeros(len(self.model.langs))
        for at in range(0, len(words), MOST_UNSEEN // 2):
            part = words[at : at + MOST_UNSEEN // 2]
            if len(self.more) + len(part) > MOST_UNSEEN:
                self.more.clear()
            found = list(map(self.model.words.get, part))
            found = [self._place(w) if i is None else i for w, i in zip(part, found)]
            out += self.logs[found].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the probability; ``und``, 0 without a letter or languages."""
        if not text or not self.model.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        total = self.total(words_of(text))
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = SAMPLE_DOCS) -> Model:
    """A model from about ``most`` rows of ``docs`` at most, the same share of the languages
    each, drawn by a hash of the text; rows without language or text are not used.

    A language with fewer rows gives all of them.  Equal texts of a language are drawn as
    one, so a text with many copies cannot fill the sample."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = most / max(len(sizes), 1)
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("lang") == k, min(1.0, each / n)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(text, F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    drawn = drawn.dropDuplicates([text, "lang"])
    counted = count_words(drawn, text, {"lang": F.col("lang")}, lambda b: map(str.encode, words_of(b.decode("utf-8", "replace"))))
    counts: dict[str, Counter] = {k: Counter() for k in sorted(sizes)}
    for r in counted.toLocalIterator():
        counts[r["lang"]][bytes(r["word"]).decode()] = r["n"]
    return Model(sorted(sizes), counts)


def predicted(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shape = T.StructType([*[docs.schema[c] for c in keep], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = [scorer.predict(t) for t in batch.column("_text").to_pylist()]
            cols = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, shape)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    model = fit(marked.where(~F.col("held_out")))
    return predicted(marked.drop("lang"), model, ["doc_id", "held_out"])
