from pyspark.sql import functions as F

from chainloom.operators.gate import gate
from chainloom.sources import readers

COLUMNS = ["timestamp", "txid", "src_ip", "dst_ip", "src_port", "dst_port", "input_addresses", "output_addresses", "input_amounts", "output_amounts", "geo_country", "asn"]
GOOD = ["2024-01-01T00:00:00Z", "t", "10.0.0.1", "10.0.0.2", "8333", "443", "a|b", "c", "1.0|2.0", "3", "DE", "AS1"]


def row(**change):
    return [change.get(c, v) for c, v in zip(COLUMNS, GOOD, strict=True)]


def reasons(spark, rows):
    df = spark.createDataFrame([[i, *r] for i, r in enumerate(rows)], "obs_id long, " + ", ".join(f"{c} string" for c in COLUMNS))
    return {r.obs_id: r.reason for r in gate(df).checked.select("obs_id", "reason").collect()}


def test_every_poisoned_row_has_its_own_reason(spark):
    rows = [
        row(),
        row(timestamp="NULL"),
        row(src_port="-1"),
        row(dst_port="999999"),
        row(src_ip="40.52.114"),
        row(input_amounts="1.0|inf"),
        row(input_amounts="1|-1"),
        row(input_amounts="1.0"),
        row(input_amounts="1.0|1d"),
        row(src_ip="::1"),
        row(src_ip="256.1.1.1"),
        row(timestamp="NULL", src_port="-1"),
        row(input_addresses="a;b|c", input_amounts="1e5|2"),
    ]
    found = reasons(spark, rows)
    assert [found[i] for i in range(len(rows))] == [
        None,
        "missing field 'timestamp'",
        "src_port out of range",
        "dst_port out of range",
        "invalid src_ip",
        "non-finite amount 'inf'",
        "negative amount",
        "input addresses/amounts length mismatch",
        "unparseable amount '1d'",
        None,
        "invalid src_ip",
        "missing field 'timestamp'",
        None,
    ]


def test_optional_placeholders_and_notes(spark):
    df = spark.createDataFrame([row(geo_country="-", asn="N/A"), row(src_ip="10.0.0.9", geo_country="-", asn="N/A"), row(src_ip="10.0.0.9", geo_country="-", asn="N/A")], ", ".join(f"{c} string" for c in COLUMNS))
    result = gate(df)
    assert {(r.geo_country, r.asn) for r in result.clean.collect()} == {("", "")}
    assert {r.note: r.n for r in result.notes().collect()} == {"duplicate txid observations": 2, "exact duplicate rows": 1}
    assert result.totals().first().asDict() == {"total": 3, "accepted": 3, "rejected": 0}


def test_absent_column_is_missing(spark):
    df = spark.createDataFrame([row()], ", ".join(f"{c} string" for c in COLUMNS)).drop("dst_ip")
    assert gate(df).rejections().first().reason == "missing field 'dst_ip'"


def test_readers_agree(spark, tmp_path):
    import json
    import sqlite3

    records = [dict(zip(COLUMNS, row(txid=f"t{i}"), strict=True)) for i in range(5)]
    (tmp_path / "a.csv").write_text("﻿" + ";".join(COLUMNS) + "\n" + "\n".join(";".join(r.values()) for r in records) + "\n", encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"n": 1}, "data": {"rows": records}}))
    (tmp_path / "b.json").write_text(json.dumps([{**r, "input_addresses": ["a", "b"], "input_amounts": [1.0, 2.0]} for r in records]))
    tag = lambda r: "".join(f"<{k}>{v}</{k}>" for k, v in r.items() if k != "input_addresses") + "<input_addresses><addr>a</addr><addr>b</addr></input_addresses>"
    (tmp_path / "a.xml").write_text("<all>" + "".join(f"<record>{tag(r)}</record>" for r in records) + "</all>")
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute(f"CREATE TABLE traffic ({', '.join(COLUMNS)})")
    con.execute("CREATE TABLE other (x)")
    con.executemany(f"INSERT INTO traffic VALUES ({', '.join('?' * len(COLUMNS))})", [list(r.values()) for r in records])
    con.commit()
    con.close()
    for name in ("a.csv", "a.json", "b.json", "a.xml", "a.db"):
        clean = readers.scan_any(spark, str(tmp_path / name)).clean
        got = {(r.txid, tuple(r.input_addresses), r.total) for r in clean.select("txid", "input_addresses", F.aggregate("input_amounts", F.lit(0.0), lambda a, x: a + x).alias("total")).collect()}
        assert got == {(f"t{i}", ("a", "b"), 3.0) for i in range(5)}, name


def test_unknown_suffix_is_refused(spark):
    import pytest

    with pytest.raises(ValueError, match="unsupported"):
        readers.scan_any(spark, "/x/y.sql")


def test_ip_rule_matches_the_standard_library(spark):
    import ipaddress

    from chainloom.operators.gate import valid_ip

    texts = ["::1", "::", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "fe80::1%", "12345::", "g::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", ":1", "1:", "1.2.3", "1.2.3.4", "256.1.1.1", "01.2.3.4", "", ":", ":::"]

    def ok(t):
        try:
            ipaddress.ip_address(t)
        except ValueError:
            return False
        return True

    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", valid_ip(F.col("t")).alias("v")).collect()}
    assert got == {t: ok(t) for t in texts}


def test_gate_over_a_stream(spark, tmp_path):
    from chainloom.streaming.replay import gated_stream, run_available

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(",".join(COLUMNS) + "\n" + "\n".join(",".join(row(txid=f"t{i}", src_port="-1" if i == 2 else "1")) for i in range(4)) + "\n")
    stream = gated_stream(spark, str(tmp_path / "in"), ", ".join(f"{c} string" for c in COLUMNS))
    assert sorted(r.txid for r in run_available(stream, "gate").collect()) == ["t0", "t1", "t3"]
