"""State of a capture that arrives in windows: keyed tables as logs of deltas, and commits that name their files.

A commit is one small file.  It lists, for every keyed table, the folders that together are the table at that point,
and the folders that its window added to the tables that only grow.  Data folders are written before, under
names of their own, and never changed; a step that dies leaves folders that no commit names.  So a window's effect on all tables
is one write, and a step always starts from the commit before it, whatever has been written since.

A keyed table is read by taking the newest row of each key over its deltas.  Deltas are bucketed by key, and when
``fan_in`` of one size stand last in the list they are merged into one of the next size: a list has a logarithmic number of
folders, and a row is rewritten as often, so what a window writes follows the window, not the history.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT, BUCKET = "__at", "__bucket"


@dataclass
class Commit:
    """What holds after a step: ``tables`` has (folder, size) lists, ``added`` the folders of this step alone."""

    seq: int
    window: int
    step: int
    label: str | None = None
    digest: str | None = None
    tables: dict[str, list] = field(default_factory=dict)
    added: dict[str, str] = field(default_factory=dict)
    judged: list[dict] = field(default_factory=list)
    #: Later steps that were committed before this one no longer hold.
    cut: bool = False


class CommitLog:
    """The commits in a folder; ``keyed`` maps a table to its key and schema, ``growing`` a table to its schema."""

    def __init__(self, spark: SparkSession, path: str, keyed: dict[str, tuple[str, str]], growing: dict[str, str], buckets: int = 4, fan_in: int = 4) -> None:
        self.spark, self.path, self.keyed, self.growing, self.buckets, self.fan_in = spark, path.rstrip("/"), keyed, growing, buckets, fan_in

    def _all(self) -> list[Commit]:
        try:
            lines = self.spark.read.text(f"{self.path}/commits/*").collect()  # a line per step
        except AnalysisException:  # nothing committed yet
            return []
        return sorted((Commit(**json.loads(r[0])) for r in lines), key=lambda c: c.seq)

    def commits(self) -> list[Commit]:
        """Those that hold, in order of window and step: of a step that was committed again, the last."""
        held: dict[tuple[int, int], Commit] = {}
        for c in self._all():
            if c.cut:
                held = {at: old for at, old in held.items() if at < (c.window, c.step)}
            held[c.window, c.step] = c
        return [held[at] for at in sorted(held)]

    def begin(self, window: int, step: int) -> Attempt:
        """A step that starts from the last commit before it."""
        every = self._all()
        before = [c for c in self.commits() if (c.window, c.step) < (window, step)]
        return Attempt(self, before[-1] if before else None, Commit((every[-1].seq if every else 0) + 1, window, step))

    def read(self, table: str, at: Commit | None) -> DataFrame:
        """A keyed table as of a commit."""
        return self._newest(table, [self._part(table, f) for f, _ in (at.tables.get(table, []) if at else [])])

    def lookup(self, table: str, at: Commit | None, keys: DataFrame) -> DataFrame:
        """Its rows of the given keys (one column, named as the key): reads the buckets that these lie in."""
        folders = at.tables.get(table, []) if at else []
        if not folders:
            return self._newest(table, [])
        key = self.keyed[table][0]
        met = [r[0] for r in keys.select(self._bucket(key)).distinct().collect()]  # as many numbers as buckets at most
        parts = [self._part(table, f).where(F.col(BUCKET).isin(met)).join(keys.distinct(), key, "left_semi") for f, _ in folders]
        return self._newest(table, parts)

    def grown(self, table: str, commits: list[Commit]) -> DataFrame:
        """All rows that the given commits added to a growing table."""
        folders = [c.added[table] for c in commits if table in c.added]
        schema = self.growing[table]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _part(self, table: str, folder: str) -> DataFrame:
        key, schema = self.keyed[table]
        return self.spark.read.schema(f"{schema}, {AT} long, {BUCKET} int").parquet(f"{self.path}/{folder}")

    def _newest(self, table: str, parts: list[DataFrame], whole: bool = False) -> DataFrame:
        key, schema = self.keyed[table]
        if not parts:
            return self.spark.createDataFrame([], schema)
        names = self.spark.createDataFrame([], schema).columns
        keep = [*names, AT] if whole else names
        rows = parts[0].select(*names, AT)
        if len(parts) == 1:
            return rows.select(*keep)
        for p in parts[1:]:
            rows = rows.unionByName(p.select(*names, AT))
        return rows.groupBy(key).agg(F.max_by(F.struct(*keep), AT).alias("r")).select("r.*")

    def _write(self, rows: DataFrame, folder: str, key: str) -> None:
        placed = rows.withColumn(BUCKET, self._bucket(key)).repartition(self.buckets, BUCKET)
        placed.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")

    def _merge(self, table: str, parts: list) -> list:
        while len(parts) >= self.fan_in and len({size for _, size in parts[-self.fan_in :]}) == 1:
            last = parts[-self.fan_in :]
            folder = f"data/{table}-{uuid.uuid4().hex}"
            self._write(self._newest(table, [self._part(table, f) for f, _ in last], whole=True), folder, self.keyed[table][0])
            parts = [*parts[: -self.fan_in], [folder, sum(size for _, size in last)]]
        return parts


class Attempt:
    """A step in the making: nothing of it holds before :meth:`commit`."""

    def __init__(self, log: CommitLog, base: Commit | None, mine: Commit) -> None:
        self.log, self.base, self.mine = log, base, mine
        mine.tables = {t: list(parts) for t, parts in base.tables.items()} if base else {}

    def put(self, table: str, rows: DataFrame) -> DataFrame:
        """New rows of a keyed table, at most one a key; returns them as written."""
        folder = f"data/{table}-{uuid.uuid4().hex}"
        key, schema = self.log.keyed[table]
        names = self.log.spark.createDataFrame([], schema).columns
        self.log._write(rows.select(*names).withColumn(AT, F.lit(self.mine.seq).cast("long")), folder, key)
        self.mine.tables[table] = self.log._merge(table, [*self.mine.tables.get(table, []), [folder, 1]])
        return self.log._part(table, folder).select(*names)

    def add(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows of a growing table; returns them as written."""
        folder = f"data/{table}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.log.path}/{folder}")
        self.mine.added[table] = folder
        return self.log.spark.read.schema(self.log.growing[table] or rows.schema).parquet(f"{self.log.path}/{folder}")

    def commit(self) -> Commit:
        line = json.dumps(asdict(self.mine))
        at = f"{self.mine.window:010d}-{self.mine.step:04d}-{self.mine.seq:08d}"
        self.log.spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.log.path}/commits/{at}")
        return self.mine
