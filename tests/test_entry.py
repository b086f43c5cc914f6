"""Registered queries against their SQL twins at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
PLAIN = ["entity_map", "flows", "entities", "structural_features", "gate_rejections", "corpus_totals", "daily_volume", "events", "auc", "psi", "trace_funds", "robust_z", "neighbourhood",
    "union_report", "summary_notes", "data_profile", "score_distribution", "rules_metrics", "payload_checks", "event_totals", "served_alerts", "rekeyed_controls", "stratified_split", "saved_reference"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(names)
    theirs = sorted(str(plain(r)) for r in con.fetchall())
    assert sorted(str(plain(tuple(r[c] for c in names))) for r in df.collect()) == theirs


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
