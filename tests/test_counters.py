"""Counter differences over slices: hot counters, restarts, gaps, equal times."""

import datetime
import random

import pytest

from fleetlens.functions.ordering import previous_values
from fleetlens.operators import counters

START = datetime.datetime(2024, 1, 1)
SCHEMA = "server_name string, counter_name string, sample_time timestamp_ntz, sample_id long, value long, started timestamp_ntz"


def made(seed, n=600):
    rng, rows = random.Random(seed), []
    for i in range(n):
        name = rng.choice(["hot", "hot", "hot", "a", "b", None])
        value = None if rng.random() < 0.1 else rng.randrange(1000)
        rows.append((rng.choice(["s1", "s2"]), name, START + datetime.timedelta(seconds=rng.randrange(200)), i, value, START + datetime.timedelta(days=rng.randrange(3))))
    return rows


@pytest.mark.parametrize("slices", [1, 3, 17])
def test_previous_values_cross_slices(spark, slices):
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["sample_id"]: r["previous_value"] for r in previous_values(df, ["server_name", "counter_name"], ["sample_time", "sample_id"], ["value"], slices=slices).collect()}
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        want[r[3]] = last.get(r[:2])
        last[r[:2]] = r[4]
    assert got == want


@pytest.mark.parametrize("started", [None, "started"])
def test_deltas(spark, started):
    rows = made(2)
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as _slice_", "'d' as before")
    got = {r["sample_id"]: (r["previous_time"], r["elapsed_us"], r["delta"], r["was_reset"]) for r in counters.counter_deltas(extra, started=started).collect()}
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        if r[4] is None:
            want[r[3]] = (None, None, None, False)
            continue
        old = last.get(r[:2])
        anew = old is not None and (r[4] < old[4] or bool(started) and r[5] > old[5])
        want[r[3]] = (None, None, None, False) if old is None else (old[2], (r[2] - old[2]) // datetime.timedelta(microseconds=1), r[4] if anew else r[4] - old[4], anew)
        last[r[:2]] = r
    assert got == want
    rates = counters.counter_rates(counters.counter_deltas(extra, started=started), bucket="minute").collect()
    assert sum(r["total"] for r in rates) == sum(w[2] for w in want.values() if w[2] is not None)
    assert sum(r["resets"] for r in rates) == sum(w[3] for w in want.values())
    assert counters.counter_deltas(extra.limit(0), started=started).count() == 0
