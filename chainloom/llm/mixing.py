"""Mixing sources to target weights with a low-discrepancy schedule.

The words of a source, its documents in a shuffled order, form a stream that is cut into blocks of
equally many words.  Slot i of the schedule draws the point frac(i * golden ratio) and takes the
source whose interval of cumulative weight holds it; the slot's rank among the slots of its source
is the number of the block it takes, so at any length the mix is within a few blocks of the
weights.  A source's stream runs at most twice and ends exactly at its target.

All running sums are two-level (sums of hash or index ranges, then rows within a range), so no
window sees more than one range of one source and a hot source spreads over as many tasks as it has
ranges.  Texts never travel: the operator reads ids, sources and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions.joins import null_safe_join
from chainloom.storage import settle

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
#: The golden ratio's fractional part over 2**31; odd, so that 2**31 slots pass before a point repeats.
GOLDEN, SPAN = 1327217885, 2**31
RANGE = 1 << 12
BINS = 1 << 12


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words per document; a null text has none."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, words, weight, target)`` from ``(source, words)``: one row per source.

    Sources by code point, null last, weigh 5, 2, 1, repeating.  Targets share ``share`` of all words
    by weight but stop at ``cap`` times the source's words; what that frees goes to the others by
    weight.  In the order of cap per weight the stopped sources come first, so one running sum finds
    the level at which the rest share.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (rank - 1) % len(CYCLE) + 1).cast("double")
    top = sources.withColumn("weight", weight).withColumn("top", F.col("words") * F.lit(cap))
    order = W.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("words").over(everything) * F.lit(share) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    fits = F.col("level") * F.col("weight") <= F.col("top")
    found = top.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first = F.min_by("level", F.when(fits, F.col("place"))).over(everything)
    found = found.withColumn("level", first)
    return found.select("source", "words", "weight", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("top")), F.col("top")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _offsets(rows: DataFrame, keys: list[str], part: str, value: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over all earlier rows of the same ``keys``, parts in order."""
    sums = rows.groupBy(*keys, part).agg(F.sum(value).alias("part_sum"))
    starts = sums.select(*keys, part, F.coalesce(F.sum("part_sum").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    here = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return null_safe_join(inside, starts, [*keys, part]).withColumn("before", F.col("inside") + F.col("part_start")).drop("inside", "part_start")


def schedule(goals: DataFrame, block: int, slots: int) -> DataFrame:
    """``(slot, source, k)``: which block k of which source each slot takes.

    ``goals`` is the output of :func:`targets`.  Blocks that the points leave over at the very end, a
    few per source, follow after the last slot.
    """
    spark = goals.sparkSession
    total = F.sum("target").over(W.partitionBy())
    upto = F.sum("target").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow))
    need = F.ceil(F.round("target") / block)
    edges = goals.where("target >= 0.5").select("source", need.alias("need"), ((upto - F.col("target")) / total).alias("lo"), (upto / total).alias("hi"))
    last = F.least(F.lit(BINS - 1), F.floor(F.col("hi") * BINS))
    bins = edges.select("*", F.explode(F.sequence(F.least(F.lit(BINS - 1), F.floor(F.col("lo") * BINS)), last)).alias("bin"))
    point = (F.col("id") % SPAN * GOLDEN % SPAN) / F.lit(float(SPAN))
    points = spark.range(1, slots + 1).select(F.col("id").alias("slot"), point.alias("u"), F.floor(point * BINS).alias("bin"))
    drawn = points.join(bins, "bin").where("u >= lo and u < hi").select("slot", "source", "need", F.lit(1).alias("one"), F.floor(F.col("slot") / RANGE).alias("part"))
    ranked = _offsets(drawn, ["source"], "part", "one", [F.col("slot")]).where("before < need").select("slot", "source", F.col("before").alias("k"))
    had = drawn.groupBy("source").agg(F.count("*").alias("had"))
    short = null_safe_join(edges, had, ["source"], "left").select("source", "need", F.coalesce("had", F.lit(0)).alias("had")).where("had < need")
    late = short.select(F.lit(slots + 1).cast("long").alias("slot"), "source", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("k"))
    return ranked.unionByName(late)


def mix(sizes: DataFrame, seed: int = 1, most_block: int = 4096, least_slots: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``(slot, source, doc_id, size, words)`` of what each slot takes, and the goals.

    ``sizes`` is ``(doc_id, source, size)`` and is read several times: pass a settled table.  A block
    has ``total / least_slots`` words, ``most_block`` at most.  A document lies in one or more
    blocks; ``words`` sums to what the mix takes of it, twice its size at most.  A null source is a
    source of its own; empty documents take no part; repeated rows are documents of their own.
    """
    goals = settle(targets(sizes.groupBy("source").agg(F.sum("size").alias("words"))), "goals")  # read six times below; its windows would be planned and compiled each time
    wanted = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    block = int(max(1, min(most_block, wanted // least_slots)))
    slots = int(-(-wanted // block))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    shuffled = sizes.where("size > 0").withColumn("shuffle", order).withColumn("part", F.substring("shuffle", 1, 3))
    placed = _offsets(shuffled, ["source"], "part", "size", [F.col("shuffle"), F.col("size")])
    ends = goals.select("source", "words", F.round("target").cast("long").alias("quota"))
    runs = null_safe_join(placed, ends, ["source"]).select("doc_id", "source", "size", "quota", F.explode(F.array(F.col("before"), F.col("before") + F.col("words"))).alias("lo"))
    runs = runs.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota"))).where("hi > lo")
    k = F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("k")
    pieces = runs.select("doc_id", "source", "size", "lo", "hi", k)
    pieces = pieces.withColumn("words", F.least(F.col("hi"), (F.col("k") + 1) * block) - F.greatest(F.col("lo"), F.col("k") * block))
    plan = schedule(goals, block, slots)
    taken = null_safe_join(pieces, plan, ["source", "k"])
    return taken.select("slot", "source", "doc_id", "size", "words"), goals


def mix_totals(sizes: DataFrame, seed: int = 1) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, first_slot)``, one row per row of ``sizes``.

    ``first_slot`` is the slot of the schedule that first draws from the document, null if none does: in its
    order the mix keeps to the weights at any length.  Rows that agree in id, source and size are
    interchangeable: what the mix takes of them together is split evenly, the remainder going to the
    first, and they share the first slot.  Null ids and sources are values like others, an empty table
    gives an empty one.
    """
    each, goals = _shares(sizes, seed)
    spread = each.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    goals = goals.select("source", F.col("words").alias("source_size"), "target")
    return null_safe_join(spread, goals, ["source"]).select("doc_id", "size", "source_size", "target", _share(F.col("n")).alias("taken"), "first_slot")


def _shares(sizes: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, size, copies, all_taken, first_slot)``, a row per distinct key, and the goals."""
    taken, goals = mix(sizes, seed)
    keys = ["doc_id", "source", "size"]
    sums = taken.groupBy(*keys).agg(F.sum("words").alias("all_taken"), F.min("slot").alias("first_slot"))
    copies = sizes.groupBy(*keys).agg(F.count("*").alias("copies"))
    return null_safe_join(copies, sums, keys, "left").select(*keys, "copies", F.coalesce("all_taken", F.lit(0)).alias("all_taken"), "first_slot"), goals


def _share(n: Column) -> Column:
    """What the n-th of the copies gets."""
    return F.expr("all_taken div copies") + F.when(n <= F.col("all_taken") % F.col("copies"), 1).otherwise(0)


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``mix_words``, how many of their words, up to twice their number, and
    ``mix_slot``, the slot of the schedule that first draws from them: read in its order, any beginning of the
    mix has the weights.

    Rows that agree in doc_id, source and size share what the mix takes of them evenly, ties by text.  Columns of
    ``docs`` named ``mix_words`` or ``mix_slot`` are replaced, all others stay.  Null and empty texts are not
    taken; null ids and sources are values like others; an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ("mix_words", "mix_slot")]
    whole = docs.select(F.struct(*rest).alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = settle(whole.select("doc_id", "source", "size"), "sizes")
    each = settle(_shares(sizes, seed)[0].where("all_taken > 0"), "shares")
    keys = ["doc_id", "source", "size"]
    once = null_safe_join(whole, each.where("copies = 1"), keys).withColumn("n", F.lit(1))
    again = null_safe_join(whole, each.where("copies > 1"), keys).withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("row.text")))
    both = once.unionByName(again).withColumn("mix_words", _share(F.col("n"))).where("mix_words > 0")
    return both.select(*(F.col("row").getField(c).alias(c) for c in rest), "mix_words", F.col("first_slot").alias("mix_slot"))


#: The same rows in DuckDB: shuffled streams of the sources, cut at their targets, and the golden-ratio draw of their blocks.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('1:' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words,
             [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
r AS (
  SELECT 0 AS step, source, words, weight, 0.0::DOUBLE AS target, false AS full_ FROM s
  UNION ALL
  SELECT step + 1, source, words, weight,
         CASE WHEN full_ THEN target WHEN share * weight > 2.0 * words THEN 2.0 * words ELSE share * weight END,
         full_ OR share * weight > 2.0 * words
  FROM (SELECT *, (1.5 * sum(words) OVER () - coalesce(sum(target) FILTER (full_) OVER (), 0)) / nullif(sum(weight) FILTER (NOT full_) OVER (), 0) AS share FROM r)
  WHERE step < 60),
g AS (SELECT source, words, target, sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto, sum(target) OVER () AS total FROM r WHERE step = 60),
b AS (SELECT greatest(1, least(4096, floor(max(total) / 131072)))::BIGINT AS block FROM g),
n AS (SELECT block, ceil(max(total) / block)::BIGINT AS slots FROM g, b GROUP BY block),
p AS (SELECT id AS slot, (id % 2147483648 * 1327217885 % 2147483648) / 2147483648.0::DOUBLE AS u FROM n, generate_series(1::BIGINT, slots) t(id)),
k AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k
      FROM p JOIN g ON u >= (upto - target) / total AND u < upto / total WHERE target >= 0.5),
o AS (SELECT d.*, g.words, g.target, round(g.target)::BIGINT AS quota,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT *, (greatest(least(lo + size, quota) - lo, 0) + greatest(least(lo + words + size, quota) - lo - words, 0))::BIGINT AS taken FROM o)
SELECT doc_id, size, words AS source_size, round(target, 6) AS target, taken, CASE WHEN taken > 0 THEN coalesce(k.slot, slots + 1) END AS first_slot
FROM t CROSS JOIN n LEFT JOIN k ON k.source IS NOT DISTINCT FROM t.source AND k.k = t.lo // block
"""
