"""Keys of many graphs in one table: ``graph, mark, name``.

Graphs whose keys differ share no edge, so one job serves all of them; what an operator counts or ranks per graph it asks of
:func:`graph_of`, and what depends on a name alone (hashes, ids) of :func:`name_of`.  With ``many`` off a key is a name and all rows are of one graph.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The unit separator, which no address or id holds.
MARK = "\x1f"


def keyed(graph: Column, name: Column) -> Column:
    """Null where either is null."""
    return F.concat(graph.cast("string"), F.lit(MARK), name.cast("string"))


def _column(key: Column | str) -> Column:
    return F.col(key) if isinstance(key, str) else key


def graph_of(key: Column | str, many: bool = True) -> Column:
    return F.substring_index(_column(key), MARK, 1) if many else F.lit("")


def name_of(key: Column | str, many: bool = True) -> Column:
    return F.substring_index(_column(key), MARK, -1) if many else _column(key)
