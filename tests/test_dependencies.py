"""Broken objects against a plain search: cycles, loops, null references, repeated rows, strangers."""

import random

import pytest

from fleetlens.operators.dependencies import broken_impact, broken_objects

OBJECTS, REFERENCES = "database_name string, object_id long, name string, type_desc string", "database_name string, referencing_id long, referenced_id long"


def plain(objects, references):
    there = {o[:2] for o in objects}
    edges = {r for r in references if r[:2] in there}
    found, step = {r[:2]: 1 for r in edges if (r[0], r[2]) not in there}, 1
    while True:
        new = {r[:2] for r in edges if (r[0], r[2]) in found and r[:2] not in found}
        if not new:
            return {o: (d, min([r[2] for r in edges if r[:2] == o and found.get((r[0], r[2])) == d - 1], default=None) if d > 1 else None) for o, d in found.items()}
        step += 1
        found.update(dict.fromkeys(new, step))


@pytest.mark.parametrize("seed,n_edges", [(1, 120), (2, 300), (3, 60)])
def test_distances(spark, seed, n_edges):
    rng = random.Random(seed)
    objects = [(db, i, f"o{i}", rng.choice(["VIEW", "PROC"])) for db in ("a", "b") for i in range(100)]
    references = [(rng.choice("ab"), rng.randrange(104), rng.randrange(100)) for _ in range(n_edges)]
    references += [("a", 3, 100), ("a", 7, None), ("b", 5, 999), ("a", 9, 9), ("a", 3, 100)]
    got = broken_objects(spark.createDataFrame(references, REFERENCES), spark.createDataFrame(objects, OBJECTS))
    rows = got.collect()
    assert len(rows) == len({(r["database_name"], r["object_id"]) for r in rows})
    assert {(r["database_name"], r["object_id"]): (r["distance"], r["via_id"]) for r in rows} == plain(objects, references)
    assert sum(r["objects"] for r in broken_impact(got).collect()) == len(rows)


def test_a_long_chain_ends_and_whole_objects_stay_out(spark):
    objects = [("a", i, "o", "VIEW") for i in range(20)]
    chain = [("a", i, i + 1) for i in range(11)] + [("a", 11, None), ("a", 12, 13), ("a", 13, 12)]
    got = broken_objects(spark.createDataFrame(chain, REFERENCES), spark.createDataFrame(objects, OBJECTS))
    assert {r["object_id"]: r["distance"] for r in got.collect()} == {i: 12 - i for i in range(12)}


def test_nothing(spark):
    none, objects = spark.createDataFrame([], REFERENCES), spark.createDataFrame([("a", 1, "o", "VIEW")], OBJECTS)
    assert broken_objects(none, objects).count() == 0
    assert broken_objects(spark.createDataFrame([("a", 1, 2)], REFERENCES), objects.limit(0)).count() == 0
