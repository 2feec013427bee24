"""Objects that are broken through what they depend on, however far away.

An object that references a name which resolves to nothing is broken (distance 1); so is
one that references a broken object, and so on.  The search goes backwards along references, one
step a round: only the objects found in the last round meet the references, and objects
that are known already are left out, so cycles end by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.fleet import DATABASE, shared_keys
from fleetlens.session import checkpoint_root


def _fixed(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def broken_objects(references: DataFrame, objects: DataFrame) -> DataFrame:
    """``object_id``, ``name``, ``type_desc``, ``distance``, ``via_id`` of every object that reaches an unresolved name.

    ``references`` has ``referencing_id`` and ``referenced_id``; a null ``referenced_id`` or one that is no
    object is unresolved.  ``distance`` counts references on the shortest way, ``via_id`` is the least object
    that is one step nearer (null at distance 1).  References from what is no object are passed over.
    Repeated references are one.  Only the number of objects of each round reaches the driver; there are as
    many rounds as the greatest distance.
    """
    k = shared_keys(references, objects, scope=DATABASE)
    # names of its own: u references v
    known = objects.select(*k, F.col("object_id").alias("u")).where("u IS NOT NULL").distinct()
    own = references.select(*k, F.col("referencing_id").alias("u"), F.col("referenced_id").alias("v")).distinct().join(known, [*k, "u"], "left_semi")
    marked = _fixed(own.join(known.select(*k, F.col("u").alias("v"), F.lit(True).alias("_there")), [*k, "v"], "left"))
    edges = marked.where("_there AND u <> v").select(*k, "u", "v")
    found = front = _fixed(
        marked.where("_there IS NULL").groupBy(*k, "u").agg(F.lit(1).alias("distance"), F.first(F.lit(None).cast(edges.schema["v"].dataType)).alias("via_id"))
    )
    step, more = 1, front.count()
    while more:
        step += 1
        reached = edges.join(front.select(*k, F.col("u").alias("v")), [*k, "v"]).groupBy(*k, "u").agg(F.min("v").alias("via_id"))
        front = _fixed(reached.join(found.select(*k, "u"), [*k, "u"], "left_anti").withColumn("distance", F.lit(step)).select(*found.columns))
        more = front.count()
        if more:
            found = _fixed(found.unionByName(front))
    names = objects.select(*k, F.col("object_id").alias("u"), "name", "type_desc")
    return names.join(found, [*k, "u"]).select(*k, F.col("u").alias("object_id"), "name", "type_desc", "distance", "via_id")


def broken_impact(broken: DataFrame) -> DataFrame:
    """``type_desc``, ``distance``, ``objects``: how many objects of a kind are broken at each distance."""
    k = shared_keys(broken, scope=DATABASE)
    return broken.groupBy(*k, "type_desc", "distance").agg(F.count(F.lit(1)).alias("objects"))
