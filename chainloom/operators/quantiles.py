"""Exact quantiles and running sums of many features at once, without a task that holds a feature.

Quantiles are selected by narrowing.  Every wanted rank of every feature has an interval that its value lies in; a pass over
the cells counts them in bins of the intervals, and the bin that holds the rank, with its smallest and largest value, is the next interval.
An interval of few rows is read out in the end.  A pass shuffles a row per bin and map task; what reaches
the driver is a row per rank.  Running sums are two-level: sums of ranges of the order, then rows within a range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators.results import PART_ROWS
from chainloom.storage import settle

BINS = 1 << 10
#: Rows of an interval that are read out rather than narrowed further.
FEW = 1 << 12
PASSES = 200


def _scaled(c):
    """A scale on which values of any size spread: it keeps the order, as logarithms do in the engine's arithmetic."""
    return F.signum(c) * F.log(F.lit(1.0) + F.abs(c))


def exact_quantiles(cells: DataFrame, probabilities: list[float], few: int = FEW, bins: int = BINS) -> DataFrame:
    """``(feature, q0, q1, ...)`` of ``(feature, x)``: a column per probability, interpolated between neighbours as ``percentile`` does.

    Nulls and non-finite values are left out; a feature without any other value has no row.  ``cells`` is read once a pass, two
    to eight passes for doubles in general: pass a settled or cheap table.
    """
    spark = cells.sparkSession
    usable = cells.select("feature", F.col("x").cast("double").alias("x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    whole = usable.groupBy("feature").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # a row per feature
    found: dict[tuple, float] = {}
    open_, kind = {}, cells.select("feature").schema["feature"].dataType.simpleString()
    for r in whole:
        for p in probabilities:
            for rank in {math.floor(p * (r.n - 1)), math.ceil(p * (r.n - 1))}:
                open_[r.feature, rank] = (r.lo, r.hi, 0, r.n)
    schema = f"feature {kind}, rank long, lo double, hi double, below long"
    for _ in range(PASSES):
        found |= {at: lo for at, (lo, hi, _, _) in open_.items() if lo == hi}
        open_ = {at: v for at, v in open_.items() if at not in found}
        if not any(v[3] > few for v in open_.values()):
            break
        wide = spark.createDataFrame([(*at, *v[:3]) for at, v in open_.items() if v[3] > few], schema)
        inside = usable.join(F.broadcast(wide), "feature").where("x >= lo and x <= hi")  # a row per rank
        far = _scaled(F.col("hi")) - _scaled(F.col("lo")) > 1
        part = F.when(far, (_scaled(F.col("x")) - _scaled(F.col("lo"))) / (_scaled(F.col("hi")) - _scaled(F.col("lo")))).otherwise((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        counted = inside.groupBy("feature", "rank", "below", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(W.partitionBy("feature", "rank").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))  # as many rows as bins
        placed = counted.withColumn("before", F.col("below") + F.coalesce(upto, F.lit(0)))
        for r in placed.where("before <= rank and rank < before + n").collect():  # a row per rank
            open_[r["feature"], r["rank"]] = (r["lo"], r["hi"], r["before"], r["n"])
    else:
        raise RuntimeError(f"intervals still hold more than {few} rows after {PASSES} passes")
    if open_:
        narrow = spark.createDataFrame([(*at, *v[:3]) for at, v in open_.items()], schema)
        rows = usable.join(F.broadcast(narrow), "feature").where("x >= lo and x <= hi").groupBy("feature", "rank", "below", "x").agg(F.count("*").alias("n"))
        order = W.partitionBy("feature", "rank").orderBy("x")  # ``few`` rows at most
        ends = rows.withColumn("upto", F.col("below") + F.sum("n").over(order))
        for r in ends.where("rank >= upto - n and rank < upto").select("feature", "rank", "x").collect():  # a row per rank
            found[r["feature"], r["rank"]] = r["x"]

    def value(r, p: float) -> float:
        at = p * (r.n - 1)
        low, high = math.floor(at), math.ceil(at)
        return found[r.feature, low] if low == high else (high - at) * found[r.feature, low] + (at - low) * found[r.feature, high]

    names = [f"q{i}" for i in range(len(probabilities))]
    return spark.createDataFrame([(r.feature, *(value(r, p) for p in probabilities)) for r in whole], f"feature {kind}" + "".join(f", {n} double" for n in names))


def column_quantiles(rows: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """One row ``(q0, q1, ...)`` of one column; without values the row is empty of them."""
    found = exact_quantiles(rows.select(F.lit(0).alias("feature"), F.col(column).alias("x")), probabilities).drop("feature")
    return found if not found.isEmpty() else rows.sparkSession.createDataFrame([(None,) * len(probabilities)], found.schema)


def running_sums(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """``rows`` with ``upto_<v>`` of each value: the sum over all rows of the key up to this one, which must be alone in its place.

    The rows are dealt out by ranges of key and order, so that a range has a bounded number of rows however many a key has.
    """
    part, parts = "__part", max(1, -(-rows.count() // PART_ROWS))
    dealt = settle(rows.repartitionByRange(parts, key, order).withColumn(part, F.spark_partition_id()), "dealt")
    here = W.partitionBy(part, key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = dealt.groupBy(key, part).agg(*(F.sum(v).alias(f"__{v}") for v in values))
    earlier = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = sums.select(key, part, *(F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values))
    inside = dealt.withColumns({f"upto_{v}": F.sum(v).over(here) for v in values})
    return inside.join(starts, [key, part]).select(*rows.columns, *((F.col(f"upto_{v}") + F.col(f"__{v}")).alias(f"upto_{v}") for v in values))
