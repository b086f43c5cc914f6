"""List columns: parsing, encoding, merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for nothing.
PLACEHOLDERS = ("", "na", "n/a", "null", "none", "nan", "nil", "unknown", "?", "-", "--")
_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+)([eE][+-]?\d+)?$"
_ODD = r"(?i)^[+-]?(inf|infinity|nan)$"


def parse_array(text: Column) -> Column:
    """Items of the first separator present, of ``|``, ``;``, ``,`` in this order; placeholders give no items."""
    split = F.when(F.instr(text, "|") > 0, F.split(text, r"\|")).when(F.instr(text, ";") > 0, F.split(text, ";")).when(F.instr(text, ",") > 0, F.split(text, ",")).otherwise(F.array(text))
    items = F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(text).isin(*PLACEHOLDERS), F.array().cast("array<string>")).otherwise(items)


def _amount(item: Column) -> Column:
    return F.replace(item, F.lit("_"), F.lit("")).try_cast("double")


def amount_error(items: Column) -> Column:
    """What is wrong with the first bad amount of a list, or null."""

    def error(x: Column) -> Column:
        huge = x.rlike(_NUMBER) & (F.abs(_amount(x)) == float("inf"))
        return (
            F.when(x.rlike(_ODD) | huge, F.concat(F.lit("non-finite amount '"), x, F.lit("'")))
            .when(~x.rlike(_NUMBER), F.concat(F.lit("unparseable amount '"), x, F.lit("'")))
            .when(_amount(x) < 0, F.lit("negative amount"))
        )

    return F.get(F.filter(F.transform(items, error), lambda e: e.isNotNull()), F.lit(0))


def parse_amounts(items: Column) -> Column:
    """The amounts of a list without errors."""
    return F.transform(items, _amount)


def encode(items: Column) -> Column:
    """A list as one text cell."""
    return F.array_join(items.cast("array<string>"), "|")
