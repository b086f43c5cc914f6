"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Stands for a null doc_id inside joins: it sorts after every real one and two nulls are told apart by their text.
NULL_ID = 2**63 - 1


def map_rows(df: DataFrame, rows: Callable[[dict[str, list]], Iterable[tuple]], schema: str | T.StructType, flush: int = 20_000) -> DataFrame:
    """``mapInArrow`` with columns in and tuples out; ``rows`` sees one Arrow batch as ``{column: list}``.

    Output leaves in batches of at most ``flush`` rows, so memory follows the input batch only.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in rows({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}):
                out.append(row)
                if len(out) >= flush:
                    yield as_batch(out, arrow)
                    out = []
            if out:
                yield as_batch(out, arrow)

    return df.mapInArrow(run, kind)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id is in no learning set, so it counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def hash_order_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of smallest key hash: the same rows on every run and partitioning.

    Keys alone are ranked first, so no task gathers the other columns of more than the chosen rows.
    """
    order = [F.xxhash64(F.lit(17), F.col(key)), F.col(key)]
    chosen = df.select(key).where(F.col(key).isNotNull()).orderBy(*order).limit(rows).distinct()  # ``rows`` keys bound the broadcast
    return df.join(F.broadcast(chosen), key, "left_semi").orderBy(*order).limit(rows)
