"""The quality gate: text records to canonical observations, one reason per rejected row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.arrays import PLACEHOLDERS, amount_error, parse_amounts, parse_array

REQUIRED = ("timestamp", "txid", "src_ip", "dst_ip", "src_port", "dst_port", "input_addresses", "output_addresses", "input_amounts", "output_amounts")
OPTIONAL = ("geo_country", "asn")
#: Fixed value: a dotted quad.
IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+)([eE][+-]?\d+)?$"


@dataclass
class GateResult:
    """``clean``: canonical rows; ``quarantine``: the rejected rows' text and ``reason``; both lazy over one checked frame."""

    checked: DataFrame
    clean: DataFrame
    quarantine: DataFrame

    def rejections(self) -> DataFrame:
        """``(reason, n)``."""
        return self.quarantine.groupBy("reason").agg(F.count("*").alias("n"))

    def totals(self) -> DataFrame:
        """One row: total, accepted, rejected."""
        return self.checked.agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))

    def notes(self) -> DataFrame:
        """``(note, n)``: repeated transaction ids and exact duplicate rows among the accepted; they are kept."""
        again = self.clean.agg((F.count("*") - F.count_distinct("txid")).alias("n")).select(F.lit("duplicate txid observations").alias("note"), "n")
        same = self.clean.groupBy(*(c for c in self.clean.columns if c != "obs_id")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
        return again.unionByName(same.select(F.lit("exact duplicate rows").alias("note"), "n"))


def clean_text(df: DataFrame, name: str) -> Column:
    """Stripped text, null or an absent column as the empty text."""
    if name not in df.columns:
        return F.lit("")
    kind = dict(df.dtypes)[name]
    text = F.array_join(F.col(name).cast("array<string>"), "|") if kind.startswith("array") else F.col(name).cast("string")
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def placeholder(c: Column) -> Column:
    return F.lower(c).isin(*PLACEHOLDERS)


def valid_ip(c: Column) -> Column:
    """A dotted quad, or an IPv6 address: eight groups, or fewer around one ``::``; the last two may be a quad."""
    group = "[0-9A-Fa-f]{1,4}"
    plain = F.regexp_replace(F.regexp_replace(c, "%[^%/]+$", ""), "(?<=:)" + IPV4[1:], "0:0")
    some = f"({group}(:{group})*)?"
    short = plain.rlike(f"^{some}::{some}$") & (F.size(F.filter(F.split(plain, ":"), lambda g: g != "")) <= 7)
    return c.rlike(IPV4) | ((F.instr(c, ":") > 0) & (plain.rlike(f"^({group}:){{7}}{group}$") | short))


def number(c: Column) -> Column:
    """A finite number, or null; Spark's type suffixes are not numbers here."""
    value = F.when(c.rlike(NUMBER), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _once(obs_id: Column) -> Column:
    """The id, made to depend on the partition: so the optimiser cannot copy the parsed columns of its
    projection into every later filter, and each cell is parsed once."""
    return (obs_id + 0 * F.spark_partition_id()).alias("obs_id")


def check(raw: DataFrame) -> DataFrame:
    """Text columns, parsed columns and ``reason``: the first failing check in contract order, null if none fails.

    One narrow pass without Python.
    """
    if "obs_id" in raw.columns:
        keep = [F.col("obs_id")]
    else:  # a stream has no positions: there the id is a hash of the record
        keep = [(F.xxhash64(*raw.columns) if raw.isStreaming else F.monotonically_increasing_id()).alias("obs_id")]
    text = raw.select(*keep, *(clean_text(raw, n).alias(n) for n in REQUIRED + OPTIONAL))
    lists = {f"{n}_l": parse_array(F.col(n)) for n in ("input_addresses", "output_addresses", "input_amounts", "output_amounts")}
    parsed = text.select(
        _once(F.col("obs_id")),
        *REQUIRED,
        *OPTIONAL,
        F.try_to_timestamp("timestamp").alias("at"),
        number(F.col("src_port")).alias("src_p"),
        number(F.col("dst_port")).alias("dst_p"),
        *(valid_ip(F.col(n)).alias(f"{n}_ok") for n in ("src_ip", "dst_ip")),
        *(c.alias(n) for n, c in lists.items()),
    )
    reason = [F.when(placeholder(F.col(n)), f"missing field '{n}'") for n in REQUIRED]
    reason += [F.when(F.col("at").isNull(), "unparseable timestamp"), F.when(F.col("txid") == "", "empty txid")]
    reason += [F.when(~F.col(f"{n}_ok"), f"invalid {n}") for n in ("src_ip", "dst_ip")]
    for n in ("src", "dst"):
        reason += [F.when(F.col(f"{n}_p").isNull(), f"unparseable {n}_port"), F.when(~F.col(f"{n}_p").between(0, 65535), f"{n}_port out of range")]
    reason += [F.when(F.size(f"{n}_addresses_l") == 0, f"empty {n}_addresses") for n in ("input", "output")]
    for n in ("input", "output"):
        reason += [amount_error(F.col(f"{n}_amounts_l")), F.when(F.size(f"{n}_amounts_l") == 0, f"empty {n}_amounts")]
    reason += [F.when(F.size(f"{n}_addresses_l") != F.size(f"{n}_amounts_l"), f"{n} addresses/amounts length mismatch") for n in ("input", "output")]
    return parsed.select(_once(F.col("obs_id")), *(c for c in parsed.columns if c != "obs_id"), F.coalesce(*reason).alias("reason"))


def gate(raw: DataFrame) -> GateResult:
    """``raw`` has text columns (lists are joined); unknown columns are ignored, absent ones count as missing."""
    checked = check(raw)
    blank = lambda n: F.when(placeholder(F.col(n)), "").otherwise(F.col(n)).alias(n)
    clean = checked.where("reason is null").select(
        "obs_id",
        F.col("at").alias("timestamp"),
        "txid",
        "src_ip",
        "dst_ip",
        F.col("src_p").cast("int").alias("src_port"),
        F.col("dst_p").cast("int").alias("dst_port"),
        F.col("input_addresses_l").alias("input_addresses"),
        F.col("output_addresses_l").alias("output_addresses"),
        parse_amounts(F.col("input_amounts_l")).alias("input_amounts"),
        parse_amounts(F.col("output_amounts_l")).alias("output_amounts"),
        *map(blank, OPTIONAL),
    )
    return GateResult(checked, clean, checked.where("reason is not null").select("obs_id", *REQUIRED, *OPTIONAL, "reason"))


def reports(checked: DataFrame, window: Column) -> DataFrame:
    """``(window, reason, n)``: the report of each window; reason null counts what was accepted."""
    return checked.groupBy(window.alias("window"), "reason").agg(F.count("*").alias("n"))


def union_report(reports: DataFrame) -> DataFrame:
    """``(item, n)``: the reports of all windows added up: total, accepted, rejected, and every reason."""
    sums = reports.groupBy("reason").agg(F.sum("n").alias("n"))
    whole = sums.agg(*(F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)).alias(n) for n, t in (("total", F.lit(True)), ("accepted", F.col("reason").isNull()), ("rejected", F.col("reason").isNotNull()))))
    items = whole.select(F.explode(F.array(*(F.struct(F.lit(n).alias("item"), F.col(n).alias("n")) for n in whole.columns))).alias("i")).select("i.item", "i.n")
    return items.unionByName(sums.where("reason is not null").select(F.col("reason").alias("item"), "n"))
