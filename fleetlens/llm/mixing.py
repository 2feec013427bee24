"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets the whole copies its source's ratio gives; what is left is a
probability.  Two documents at a time trade probability, weighted by their sizes, until
one of them is whole, so the words of the source stay at their target.  A group of
documents leaves at most one undecided, and those meet again in the next, smaller round:
a reduction tree whose last node rounds the one document left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.ordering import positions
from fleetlens.llm.text import SPACE, fixed, small_side, whole_row

WEIGHTS = (3, 1, 2)
BUDGET = 1.5  # of all sizes
MOST = 2.0  # times its size that a source, and so each document, may give
FAN_IN = 64  # documents that a tree node decides


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(units: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` of the sources of ``units`` (source, size).

    Sources in code-point order, null last, have ``WEIGHTS`` in turn.  The share of a
    unit of weight rises until the targets, each stopped at its source's cap, sum up to
    the budget; a round needs the sums of two columns of the source table.
    """
    sums = fixed(units.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = fixed(positions(sums, [], [F.col("source").asc_nulls_last()]))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("position") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    table = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("cap"))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    budget, share, before = BUDGET * total[0], BUDGET * total[0] / total[1], -1.0
    while share > before:
        above = F.col("cap") < F.col("weight") * share
        full, free = table.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        before, share = share, (budget - full) / free if free else share
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * share).alias("target"))


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _folded(items: Column, seed: int) -> Column:
    """Struct of ``done`` (unit, whole) and ``open``, the unit left with its chance ``p``.

    ``items`` are sorted structs (h, size, p, unit), sizes above zero."""
    first = F.get(items, 0)
    kind = "array<struct<unit:{0},whole:int>>"

    def step(acc: Column, x: Column) -> Column:
        c = acc["open"]
        up = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])  # words that can go to c
        down = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])  # and from it to x
        to_c = _chance(c["h"], x["h"], F.lit(seed)) * (up + down) < down
        # who is whole now: c has risen to 1 or fallen to 0, or x has
        c_whole = F.when(to_c, (1 - c["p"]) * c["size"] <= x["p"] * x["size"]).otherwise(c["p"] * c["size"] <= (1 - x["p"]) * x["size"])
        value = F.when(to_c == c_whole, 1).otherwise(0)
        moved = F.when(to_c, up).otherwise(-down)
        left = F.when(c_whole, x["p"] - moved / x["size"]).otherwise(c["p"] + moved / c["size"])
        stays = lambda name: F.when(c_whole, x[name]).otherwise(c[name]).alias(name)
        kept = F.struct(stays("h"), stays("size"), F.least(F.greatest(left, F.lit(0.0)), F.lit(1.0)).alias("p"), stays("unit"))
        gone = F.struct(F.when(c_whole, c["unit"]).otherwise(x["unit"]).alias("unit"), value.alias("whole"))
        return F.struct(kept.alias("open"), F.concat(acc["done"], F.array(gone)).alias("done"))

    return first, kind, step


def rounded(units: DataFrame, seed: int = 0) -> DataFrame:
    """``units`` (unit struct, source, size > 0, p in (0, 1)) with ``whole`` 0 or 1 each.

    Of every source, the words of the chosen units differ from the expected ones by less
    than one unit.  The outcome depends on the rows and the seed only.
    """
    kind = units.schema["unit"].dataType.simpleString()
    open_ = units.select("source", "size", "p", "unit", F.xxhash64("unit", F.lit(seed)).alias("h"))
    most = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    counts = open_.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    open_ = open_.join(counts, open_.source.eqNullSafe(counts.source)).drop(counts.source)
    out, level = None, 0
    while True:
        nodes = F.greatest(F.ceil(F.col("_n") / FAN_IN), F.lit(1)).cast("long")
        keyed = open_.select("source", nodes.alias("_n"), F.pmod(F.xxhash64("h", F.lit(level)), nodes).alias("node"), F.struct("h", "size", "p", "unit").alias("item"))
        groups = keyed.groupBy("source", "_n", "node").agg(F.sort_array(F.collect_list("item")).alias("items"))
        first, shape, step = _folded(F.col("items"), seed + level)
        start = F.struct(first.alias("open"), F.array().cast(shape.format(kind)).alias("done"))
        folded = groups.select("source", "_n", F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), start, step).alias("r"))
        folded = fixed(folded)
        done = folded.select("source", F.explode("r.done").alias("d")).select("source", "d.unit", "d.whole")
        out = done if out is None else out.unionByName(done)
        level += 1
        open_ = folded.select("source", "_n", "r.open.h", "r.open.size", "r.open.p", "r.open.unit")
        if most <= FAN_IN:
            last = (_chance(F.col("h"), F.lit("last"), F.lit(seed)) < F.col("p")).cast("int")
            return out.unionByName(open_.select("source", "unit", last.alias("whole")))
        most = -(-most // FAN_IN)


def copies(units: DataFrame, seed: int = 0) -> DataFrame:
    """``units`` (unit struct, source, size) with ``source_size``, ``target``, ``copies``.

    Units of size zero give nothing and get no copy.  Sources may be null; units must be
    distinct.  No units give none.
    """
    units = fixed(units)
    goal = fixed(targets(units))
    rated = units.join(goal, units.source.eqNullSafe(goal.source), "left").drop(goal.source)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    rated = rated.withColumn("_base", F.floor(ratio + 1e-12).cast("int")).withColumn("_p", ratio - F.col("_base"))
    undecided = (F.col("size") > 0) & (F.col("_p") > 1e-12)
    whole = F.when(F.col("size") > 0, F.col("_base")).otherwise(0)
    settled = rated.where(~undecided).withColumn("copies", whole)
    trading = rated.where(undecided)
    chosen = rounded(trading.select("unit", "source", "size", F.col("_p").alias("p")), seed)
    decided = chosen.join(goal, chosen.source.eqNullSafe(goal.source)).drop(goal.source)
    base = F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(MOST)) + 1e-12).cast("int")
    decided = decided.select("unit", "source", F.col("unit.size").alias("size"), "source_size", "target", (base + F.col("whole")).alias("copies"))
    return settled.select(decided.columns).unionByName(decided)


def _units(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One unit per row of ``docs``: its columns, and a number ``k`` that tells equal rows apart."""
    counted = docs.select(*[c.alias(n) for n, c in columns.items()]).groupBy(*columns).agg(F.count(F.lit(1)).alias("_m"))
    each = counted.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    return each.select(F.struct(*columns, "k").alias("unit"), "source", "size")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source), each as often as the mix takes it.

    Repeated rows are decided one by one, and only they are numbered; null sources are a
    source, null and empty texts have no words and leave the mix.  Columns keep their names
    and values; any names are allowed."""
    key = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": words_in(F.col("text")), "hash": F.xxhash64("text")}
    units = fixed(_units(docs, key))
    taken = small_side(fixed(copies(units, seed).where("copies > 0").select("unit.*", "copies")))
    keyed = docs.select(whole_row(docs), *[c.alias(n) for n, c in key.items()])
    repeated = fixed(units.where("unit.k = 2").select("unit.*").drop("k"))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    numbered = keyed.withColumn("k", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        repeated = small_side(repeated)
        order = Window.partitionBy(*key).orderBy(F.lit(1))
        again = keyed.join(repeated, same(keyed, repeated, key), "left_semi").withColumn("k", F.row_number().over(order).cast("long"))
        numbered = numbered.join(repeated, same(numbered, repeated, key), "left_anti").unionByName(again)
    both = numbered.join(taken, same(numbered, taken, [*key, "k"]))
    return both.select("row", F.explode(F.sequence(F.lit(1), taken["copies"].cast("int"))).alias("copy")).select("row.*")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    units = _units(docs, {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": words_in(F.col("text"))})
    return copies(units).select(
        "unit.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
