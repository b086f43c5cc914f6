"""Statistics of a whole capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions.sums import exact_sum
from chainloom.operators.correlate import list_sum
from chainloom.operators.quantiles import column_quantiles

#: Half-open value classes.
SIZE_CLASSES = (("dust (< 0.01 BTC)", 0.0, 0.01), ("small (0.01 - 1 BTC)", 0.01, 1.0), ("medium (1 - 10 BTC)", 1.0, 10.0), ("large (10 - 100 BTC)", 10.0, 100.0), ("very large (>= 100 BTC)", 100.0, float("inf")))


def valued(obs: DataFrame) -> DataFrame:
    """``(timestamp, txid, value)``: what each observation moves."""
    return obs.select("timestamp", "txid", list_sum("output_amounts").alias("value"))


def totals(obs: DataFrame, entities: DataFrame, mapping: DataFrame, seen: DataFrame) -> DataFrame:
    """One row of capture totals; distinct IPs both as a set and as the sum of per-entity counts."""
    parts = [
        valued(obs).agg(F.count("*").alias("records"), F.count_distinct("txid").alias("distinct_tx"), exact_sum("value").alias("value_btc"), (exact_sum("value") / F.count("value")).alias("mean_value"), ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 3.6e9).alias("span_hours")),
        column_quantiles(valued(obs), "value", [0.5]).toDF("median_value"),
        entities.agg(F.count("*").alias("entities"), F.sum("ip_count").alias("entity_ip_pairs")),
        mapping.agg(F.count("*").alias("addresses")),
        seen.agg(F.count_distinct("ip").alias("distinct_ips"), F.count_distinct(F.when(F.col("country") != "", F.col("country"))).alias("countries"), F.count_distinct(F.when(F.col("asn") != "", F.col("asn"))).alias("asns")),
    ]
    whole = parts[0]
    for p in parts[1:]:  # one row each
        whole = whole.crossJoin(p)
    return whole


def value_percentiles(obs: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99, 0.999, 1.0), exact: bool = True) -> DataFrame:
    """``(p, value)``; ``exact`` off uses a mergeable sketch, which reads the values once."""
    at = F.array(*map(F.lit, points))
    if exact:
        found = column_quantiles(valued(obs), "value", list(points))
        found = found.select(F.array(*found.columns).alias("v"))
    else:
        found = valued(obs).agg(F.percentile_approx("value", at, 100_000).alias("v"))
    return found.select(F.explode(F.arrays_zip(at.alias("p"), F.col("v").alias("value"))).alias("z")).select("z.p", "z.value")


def size_classes(obs: DataFrame) -> DataFrame:
    """``(size_class, transactions, tx_share, value_btc, value_share)``, empty classes included."""
    spark = obs.sparkSession
    names = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(SIZE_CLASSES)], "k int, size_class string")
    k = F.coalesce(*(F.when((F.col("value") >= lo) & (F.col("value") < hi), i) for i, (_, lo, hi) in enumerate(SIZE_CLASSES)), F.lit(0))
    sums = valued(obs).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    whole = names.join(sums, "k", "left").select("size_class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0.0)).alias("v"))
    every = W.partitionBy()  # five rows
    return whole.select("size_class", F.col("n").alias("transactions"), (F.col("n") / F.sum("n").over(every)).alias("tx_share"), F.col("v").alias("value_btc"), (F.col("v") / F.sum("v").over(every)).alias("value_share"))


def daily_volume(obs: DataFrame, least_share: float = 0.1) -> DataFrame:
    """``(day, transactions, value_btc)``; a trailing day of under a tenth of the median of the others joins the day before."""
    days = valued(obs).groupBy(F.to_date("timestamp").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return fold_last_day(days, least_share).groupBy("label").agg(F.sum("n").alias("transactions"), F.sum("v").alias("value_btc")).withColumnRenamed("label", "day")


def fold_last_day(days: DataFrame, least_share: float = 0.1) -> DataFrame:
    """``days`` (d, n, ...) with ``label``: the day, or ``a..b`` for the last two if the last is a fragment; needs three days."""
    last = W.orderBy("d")  # a row per day
    marked = days.withColumns({"last": F.lead("d").over(last).isNull(), "next": F.lead("d").over(last), "prev": F.lag("d").over(last)})
    rule = marked.agg(F.count("*").alias("days"), F.percentile("n", F.lit(0.5)).alias("all_mid"), F.percentile(F.when(~F.col("last"), F.col("n")), F.lit(0.5)).alias("mid"), F.max(F.when(F.col("last"), F.col("n"))).alias("tail"), F.max("d").alias("end"))
    rule = rule.select("end", ((F.col("days") >= 3) & (F.col("tail") < least_share * F.col("mid"))).alias("fold"))
    both = lambda a, b: F.concat(a.cast("string"), F.lit(".."), F.substring(b.cast("string"), 6, 5))
    label = F.when(F.col("fold") & F.col("last"), both(F.col("prev"), F.col("d"))).when(F.col("fold") & (F.col("next") == F.col("end")), both(F.col("d"), F.col("next"))).otherwise(F.col("d").cast("string"))
    return marked.crossJoin(F.broadcast(rule)).withColumn("label", label).drop("last", "next", "prev", "fold", "end")


def hourly_profile(obs: DataFrame) -> DataFrame:
    """``(hour, transactions, value_btc)``: all 24 hours, quiet ones too."""
    hours = obs.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    sums = valued(obs).groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return hours.join(sums, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("transactions"), F.coalesce("v", F.lit(0.0)).alias("value_btc"))


def peaks(obs: DataFrame) -> DataFrame:
    """One row: busiest hour of the day and busiest day (after the fold), earliest on ties."""
    hours = hourly_profile(obs).agg(F.min_by("hour", F.struct(-F.col("transactions"), F.col("hour"))).alias("peak_hour"), F.max("transactions").alias("peak_hour_transactions"))
    days = daily_volume(obs).agg(F.min_by("day", F.struct(-F.col("transactions"), F.col("day"))).alias("peak_day"))
    return hours.crossJoin(days)


def volume_series(obs: DataFrame, width: str = "3 hours") -> DataFrame:
    """``(start, transactions, value_btc)`` per tumbling window."""
    return valued(obs).groupBy(F.window("timestamp", width).alias("w")).agg(F.count("*").alias("transactions"), F.sum("value").alias("value_btc")).select(F.col("w.start").alias("start"), "transactions", "value_btc")


def top_actors(entities: DataFrame, n: int = 8) -> DataFrame:
    """``(entity_id, value_btc, share)``: the largest by value, with their share of all attributed value."""
    total = entities.agg(F.sum("value_btc").alias("total"))
    return entities.orderBy(F.desc("value_btc"), "entity_id").limit(n).crossJoin(F.broadcast(total)).select("entity_id", "value_btc", (F.col("value_btc") / F.col("total")).alias("share"))


def countries(scored: DataFrame, floor: int = 50, n: int = 10) -> DataFrame:
    """``(country, entities, flagged)``: the ``n`` most common, with how many reach the risk floor."""
    flat = scored.select("risk", F.explode("countries").alias("country"))
    return flat.groupBy("country").agg(F.count("*").alias("entities"), F.count_if(F.col("risk") >= floor).alias("flagged")).orderBy(F.desc("entities"), "country").limit(n)


def geo_breakdown(scored: DataFrame, floor: int = 50, n: int = 6) -> DataFrame:
    """``(country, entities, share)`` of the flagged entities only."""
    flagged = scored.where(F.col("risk") >= floor)
    sums = flagged.select(F.explode("countries").alias("country")).groupBy("country").agg(F.count("*").alias("entities"))
    total = sums.agg(F.sum("entities").alias("total"))
    return sums.crossJoin(F.broadcast(total)).orderBy(F.desc("entities"), "country").limit(n).select("country", "entities", (F.col("entities") / F.col("total")).alias("share"))


def coverage(scored: DataFrame, floor: int = 50) -> DataFrame:
    """One row: entities scored and flagged, flagged share of entities and of value."""
    hit = F.col("risk") >= floor
    return scored.agg(F.count("*").alias("scored"), F.count_if(hit).alias("flagged"), (F.count_if(hit) / F.count("*")).alias("flagged_share"), (F.coalesce(F.sum(F.when(hit, F.col("value_btc"))), F.lit(0.0)) / F.sum("value_btc")).alias("flagged_value_share"))


def summary_sentence(whole: DataFrame, cover: DataFrame) -> DataFrame:
    """One row ``sentence`` from :func:`totals` and :func:`coverage`."""
    text = F.format_string("%d records over %.1f hours: %d addresses in %d entities, controlled from %d IPs in %d countries; %d flagged.", "records", "span_hours", "addresses", "entities", "distinct_ips", "countries", "flagged")
    return whole.crossJoin(cover).select(text.alias("sentence"))


def summary_notes(daily: DataFrame, hourly: DataFrame) -> DataFrame:
    """One row ``notes``: a last day of under half the typical one, and whether the busiest hour stands out.

    ``daily`` has a row per day, ``hourly`` 24.  The typical day is the upper median of all but the last, from three days on; an
    hour stands out from a fifth above an even share on.
    """
    days = daily.agg(F.array_sort(F.collect_list(F.struct("day", "transactions"))).alias("d")).select(F.get("d", F.size("d") - 1)["transactions"].alias("tail"), F.array_sort(F.transform(F.slice("d", 1, F.greatest(F.size("d") - 1, F.lit(0))), lambda x: x["transactions"])).alias("rest"))
    typical = F.when(F.size("rest") >= 2, F.get("rest", F.floor(F.size("rest") / 2).cast("int")))
    busiest = hourly.agg(F.min_by("hour", F.struct(-F.col("transactions"), F.col("hour"))).alias("hour"), (F.max("transactions") / F.sum("transactions")).alias("share"))
    whole = days.select("tail", typical.alias("typical")).crossJoin(busiest)  # one row each
    fragment = F.when((F.col("typical") > 0) & (F.col("tail") < F.col("typical") * 0.5), F.format_string("last day incomplete: %d transactions, a typical day has %d", "tail", "typical"))
    percent = F.format_string("%.1f%%", F.col("share") * 100)
    rhythm = F.when(F.col("share") <= 0.042 * 1.2, F.concat(F.lit("no daily rhythm: the busiest hour ("), "hour", F.lit(") has "), percent)).when(F.col("share").isNotNull(), F.concat(F.lit("hour "), "hour", F.lit(" is the busiest with "), percent))
    return whole.select(F.array_compact(F.array(fragment, rhythm)).alias("notes"))


def profile(obs: DataFrame) -> DataFrame:
    """One row on a data set as it came: rows, distinct transactions, address places on both sides, distinct addresses and IPs."""
    counts = obs.agg(F.count("*").alias("rows"), F.count_distinct("txid").alias("distinct_tx"), F.sum(F.size("input_addresses")).alias("input_places"), F.sum(F.size("output_addresses")).alias("output_places"))
    addresses = obs.select(F.explode(F.concat("input_addresses", "output_addresses")).alias("a")).distinct().agg(F.count("*").alias("addresses"))
    ips = obs.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().agg(F.count("ip").alias("ips"))
    return counts.crossJoin(addresses).crossJoin(ips)  # one row each


#: What :func:`window_sketches` counts.
SKETCHED = ("transactions", "addresses", "ips")
#: Registers of a sketch, as a power of two: the standard error of a count is 1.04 / sqrt(2^14), some 0.8 %.
REGISTERS = 14


def window_sketches(obs: DataFrame) -> DataFrame:
    """``(window_id, rows, transactions, addresses, ips)``: per window how many rows, and sketches of what is different in it.

    Sketches are of one size whatever the window's; those of any windows can be merged, so a union needs no second reading.
    """
    flat = obs.select("window_id", "txid", "src_ip", F.array_union("input_addresses", "output_addresses").alias("addresses"))
    sketch = lambda n: F.hll_sketch_agg(n, F.lit(REGISTERS))
    whole = flat.groupBy("window_id").agg(F.count("*").alias("rows"), sketch("txid").alias("transactions"), sketch("src_ip").alias("ips"))
    listed = flat.select("window_id", F.explode("addresses").alias("a")).groupBy("window_id").agg(sketch("a").alias("addresses"))
    return whole.join(listed, "window_id", "left").select("window_id", "rows", "transactions", "addresses", "ips")


def merged_counts(sketches: DataFrame) -> DataFrame:
    """``(item, estimate)`` over all windows of ``sketches`` (rows are exact); four standard errors are 3.3 %."""
    whole = sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(n)), F.lit(0)).alias(n) for n in SKETCHED))
    return whole.select(F.explode(F.array(*(F.struct(F.lit(n).alias("item"), F.col(n).cast("long").alias("estimate")) for n in ("rows", *SKETCHED)))).alias("i")).select("i.item", "i.estimate")
