"""The whole model against a plain recomputation from its stored tables."""

import collections
import math
import random
import tracemalloc
import types

import numpy as np
import pytest

from fleetlens.llm import pitman_yor as py


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    made = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(30))) for _ in range(n)]
    return [*made, made[0], "", None, "W1 w1\tw1"]


def tokens(text):
    return (text or "").lower().split()


def plain(model, found, train):
    """log10 probability of a text, from the tables and chances that were stored."""
    names = {w: c for w, c in model.codes.words.items()}
    counts = collections.Counter(w for t in train for w in tokens(t))
    code = lambda w: int(model.codes.of([w.encode()])[1])
    by_code = {code(w): n for w, n in counts.items()}
    n, t, tu, chance = {}, {}, collections.Counter(), {c: p for c, p in enumerate(model.chance.tolist())}
    for r in found.pairs.collect():
        for u, w, c, mean in zip(*[x.tolist() for x in py._pieces([r["data"]])]):
            assert (u, w) not in n
            n[u, w], t[u, w] = c, mean / (py.SWEEPS - py.BURN_IN)
            tu[u] += t[u, w]
    chance |= {r["code"] + (1 << 64): r["p"] for r in found.chances.collect()}
    assert len(names) + 1 == len(model.chance)
    by_code[0] = len(train)

    def one(u, w):
        back = (py.STRENGTH + py.DISCOUNT * tu[u]) / (py.STRENGTH + (by_code.get(u, 0)))
        p0 = chance.get(w, 10**model.nothing)
        return back * p0 + ((n[u, w] - py.DISCOUNT * t[u, w]) / (py.STRENGTH + by_code[u]) if (u, w) in n else 0)

    def score(text):
        own = [0, *[code(w) for w in tokens(text)], 0]
        return sum(math.log10(one(u, w)) for u, w in zip(own, own[1:]))

    return score, one, chance, by_code, n


@pytest.mark.parametrize("known,bucket", [(1000, 10**6), (7, 150)])
def test_scores_equal_a_plain_recomputation(spark, known, bucket):
    train = texts_of(1)
    others = [*train, "w1 never seen w2", "w39 w38 w39", *texts_of(2, 10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "i long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(others)], "i long, text string")
    model, found = py.fit(df, known=known, bucket=bucket)
    assert (model.codes.buckets > 1) == (bucket == 150) and model.codes.split.any() == (bucket == 150)
    score, one, chance, by_code, n = plain(model, found, train)
    got = {r["i"]: r["score"] for r in py.scored(docs, model, found, ["i"]).collect()}
    assert len(got) == len(others)
    for i, t in enumerate(others):
        assert got[i] == pytest.approx(score(t), abs=1e-9)
    # every pair is there with its count
    pairs = collections.Counter()
    for t in train:
        own = model.codes.of([w.encode() for w in tokens(t)]).tolist()
        pairs.update(zip(own, own[1:]))
    assert n == dict(pairs)
    # what follows a context has probability one in all, the unknown word's share included
    for u in list(by_code)[:12]:
        whole = sum(one(u, w) for w in by_code) + one(u, -1)
        assert whole == pytest.approx(1, abs=1e-9)
    again = py.fit(df, known=known, bucket=bucket)
    assert {r["i"]: r["score"] for r in py.scored(docs, *again, ["i"]).collect()} == pytest.approx(got, abs=1e-9)


def test_tables_follow_the_restaurant_process():
    """Mean tables after c customers, beside a plain simulation of one dish."""
    c, a, p, d = 40, 5.0, 0.3, 0.6
    rng = random.Random(4)

    def simulated():
        tables = 1
        for i in range(1, c):
            new = (a + d * tables) * p
            tables += rng.random() < new / (new + i - d * tables)
        return tables

    want = sum(simulated() for _ in range(4000)) / 4000
    got, _ = py.seated(np.full(4000, float(c)), np.full(4000, a), np.full(4000, p), d, np.random.default_rng(4))
    assert got.mean() == pytest.approx(want, rel=0.02)
    one, _ = py.seated(np.ones(3), np.full(3, a), np.full(3, p), d, np.random.default_rng(1))
    assert one.tolist() == [1, 1, 1]


def test_context_grows_with_the_corpus(spark):
    """Four times the different texts, four times the pairs."""
    sizes = []
    for n in (40, 160):
        train = [f"a{i} b{i} c{i} a{i}" for i in range(n)]
        _, found = py.fit(spark.createDataFrame([(t,) for t in train], "text string"))
        sizes.append(sum(len(py._pieces([r["data"]])[0]) for r in found.pairs.collect()))
    assert sizes == [40 * 5, 160 * 5]


def test_packed_columns_come_back():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 9, 1000)
    x, y = py.unpack(py.pack(a, b))
    assert (x == a).all() and (y == b.astype(np.uint64)).all()


def test_sums_of_a_text_meet_before_they_are_joined(spark):
    """One row a text at most, however many buckets its pairs are dealt over."""
    train = texts_of(3, 120)
    docs = spark.createDataFrame([(t,) for t in train], "text string")
    model, found = py.fit(docs, known=7, bucket=50)
    assert model.codes.buckets > 20
    added = py._added(docs, spark.sparkContext.broadcast(model), found, "text")
    assert added.count() <= len(train)
    assert added.select("_row").distinct().count() == added.count()


def test_counts_of_words_that_are_not_held(spark):
    """Texts of several blocks in one task; base and known words against plain counts."""
    rng = random.Random(5)
    texts = [" ".join(f"v{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.randrange(6))) for _ in range(py.BLOCK + 400)]
    train = texts[::2]
    model, found = py.fit(spark.createDataFrame([(t,) for t in train], "text string"), known=5, bucket=1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    counts = collections.Counter(w for t in train for w in tokens(t))
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    got = {r["i"]: r for r in py.scored(docs, model, found, ["i"]).collect()}
    assert len(got) == len(texts) and len(model.codes.words) <= 5 and model.codes.buckets > 1
    for i, t in enumerate(texts):
        own = [*[counts[w] for w in tokens(t)], len(train)]
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(own), sum(c > 0 for c in own))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c + 1) / (total + distinct + 1)) for c in own), abs=1e-8)


def test_words_are_cut_like_bytes():
    odd = [None, "", " ", " A\x0bb  c\x1cd\r\n", "É x\x85Y z ", "\x00 Kİ \t", "a", "\x1f\x20\x0c"]
    lengths, words = py._words(py.pa.array(odd, py.pa.string()))
    want = [(t or "").encode().lower().split() for t in odd]
    assert lengths.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]
    parts = list(py._slices(py.pa.array(odd * 9, py.pa.string()), 20))
    assert len(parts) > 3 and [x for p in parts for x in p.to_pylist()] == odd * 9
    assert not list(py._slices(py.pa.array([], py.pa.string()), 20))


def test_packed_zeros_and_signed_numbers_come_back():
    for column in ([], [0, 0], [0, 255, 256], [(1 << 64) - 1, 0]):
        assert py.unpack(py.pack(np.array(column, np.uint64)))[0].tolist() == column
    x = np.array([0, -1, 1, -(1 << 60), 1 << 60])
    assert py._unsigned(py._signed(x)).tolist() == x.tolist()


def test_pairs_in_order_whether_or_not_places_fit():
    rng = np.random.default_rng(6)
    for codes in (np.arange(50, dtype=np.uint64), np.broadcast_to(np.uint64(0), 1 << 28)):
        u, w = rng.integers(0, 50, 5000).astype(np.uint64), rng.integers(0, 50, 5000).astype(np.uint64)
        got = py.Chunk(codes, 0, u, w, None, None, None, None).order()
        assert (got == np.lexsort((w, u))).all()


def test_a_worker_holds_pairs_of_one_bucket_beside_its_chunk(monkeypatch):
    """Bytes a token that numpy and Python hold at once while a chunk is made and packed, and while a bucket is unpacked."""

    class Made(Exception):
        pass

    class Frame:
        sparkSession = types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda x: None))

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            raise Made(f)

    def peak(run):
        tracemalloc.start()
        try:
            out = run()
            return tracemalloc.get_traced_memory()[1], out
        finally:
            tracemalloc.stop()

    rng = np.random.default_rng(7)
    names = [f"w{i}" for i in range(3000)]
    texts = [" ".join(names[i] for i in rng.integers(0, 3000, 1000)) for _ in range(1000)]
    batch = py.pa.RecordBatch.from_arrays([py.pa.array(texts)], names=["text"])
    codes = py.Codes({w.encode(): i for i, w in enumerate(names[:-9], 1)}, np.zeros(len(names) + 1, bool), 16)
    value = types.SimpleNamespace
    calls = [
        lambda: py._added(Frame(), value(value=value(codes=codes)), None, "text"),
        lambda: py._seat(Frame(), "text", value(value=codes), None, 0.0, 1),
    ]
    monkeypatch.setattr(py, "TaskContext", value(get=lambda: value(partitionId=lambda: 0)))
    for call in calls:
        with pytest.raises(Made) as made:
            call()
        codes.known(batch.column(0).slice(0, 0).cast("binary"))
        used, rows = peak(lambda: sum(1 for _ in made.value.args[0](iter([batch]))))
        assert rows == 16 and used < 50 * 1_001_000

    data = [py.pack(*(rng.integers(0, 1 << 30, 40_000) for _ in range(3))) for _ in range(10)]
    used, columns = peak(lambda: py._pieces(data))
    assert used < 1.6 * sum(c.nbytes for c in columns)
