"""Resampling towards a target: CRCs, counts, ranks and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

from fleetlens.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def grams(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, most=1, buckets=10_000, least=20, share=10):
    """(id, features, weight, score, rank) of (id, text) rows."""
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(crc(f) for _, t in rows for f in grams(t, most)[1])
    t = collections.Counter(crc(f) for x in target for f in grams(x, most)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in rows:
        words, found = grams(text, most)
        weight = sum(gain(crc(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * share // 100]
    placed = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    rest = list(out)
    for r in drawn:
        rest.remove(r)
    return sorted([*placed, *[(*r[:4], None) for r in rest]], key=repr)


def rows_of(df):
    return sorted(((r[0], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_crcs_of_all_lengths():
    rng = random.Random(1)
    some = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 9, 300]))) for _ in range(500)]
    assert resampling.crcs(some).tolist() == [zlib.crc32(f) for f in some]
    assert resampling.crcs([]).tolist() == []


def test_features_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(2)
    for size in (1, 3, 10, 1 << 20):
        monkeypatch.setattr(resampling, "SLICE", size)
        for _ in range(150):
            text = "".join(rng.choice(["a", "B", " ", "é", "9", "_", "\n", "x" * 9]) for _ in range(rng.randint(0, 40)))
            for most in (1, 2, 4):
                slices = list(resampling.features(text.encode(), most))
                words, found = grams(text, most)
                assert sum(n for n, _ in slices) == len(words)
                assert sorted(f.decode() for _, some in slices for f in some) == sorted(found)


def test_ranks_of_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(resampling, "DISTINCT", 30)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = [rows[9][1], None, "", "the tion the"]
    items = spark.createDataFrame(list(enumerate(target)), ITEMS)
    for most, share in ((1, 50), (2, 100), (3, 34)):
        got = resampling.ranked(odd, items, share=share, most=most)
        assert rows_of(got) == brute(rows, target, most, share=share)
    assert rows_of(resampling.ranked(odd, items.limit(0), share=50)) == brute(rows, [], share=50)
    assert resampling.ranked(empty, items).count() == 0 and resampling.drawn(empty, items).columns == empty.columns


def test_drawn_rows_keep_their_columns(odd, empty, spark, small_docs, small_dir):
    target = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    clash = odd.selectExpr("*", "'s' as score", "'w' as weight", "'r' as rank", "'f' as n_features", "'w' as _n_words")
    ranks = {r["doc_id"] for r in resampling.ranked(odd, target, share=60).where("rank is not null").collect()}
    got = resampling.drawn(clash, target, share=60)
    assert got.columns == clash.columns and {r["doc_id"] for r in got.collect()} == ranks
    assert all((r["score"], r["weight"], r["rank"], r["_n_words"], r["n_words"]) == ("s", "w", "r", "w", "n_words") for r in got.collect())
    whole = resampling.drawn(small_docs, target).select("doc_id").collect()
    ranks = resampling.ranked(small_docs, target).where("rank is not null").orderBy("rank").collect()
    assert sorted(r[0] for r in whole) == sorted(r["doc_id"] for r in ranks) and [r["rank"] for r in ranks] == list(range(1, len(ranks) + 1))


def test_weights_lean_to_the_target(small_docs, small_dir, spark):
    """Drawn documents are nearer to the target than the corpus is."""
    target = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    rows = resampling.ranked(small_docs, target).where("n_words >= 20").collect()
    mean = lambda own: sum(r["weight"] for r in own) / len(own)
    assert mean([r for r in rows if r["rank"]]) > mean(rows)
